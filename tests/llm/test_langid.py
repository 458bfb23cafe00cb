import zlib

import numpy as np
import pytest

from pixelloom.llm import langid as L


def test_gradients_match_differences():
    rnd = np.random.default_rng(1)
    net = L.Network(["a", "b", "c"], width=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rnd.integers(0, 6, (7, 4)).astype(np.uint8)
    y = rnd.integers(0, 3, (7, 4))
    _, g = net.gradients(x, y)
    for k, v in net.p.items():
        at = tuple(rnd.integers(0, min(n, 6)) for n in v.shape)
        old, eps = v[at], 1e-2
        v[at] = old + eps
        up = net.gradients(x, y)[0]
        v[at] = old - eps
        down = net.gradients(x, y)[0]
        v[at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 * max(0.02, abs(g[k][at])) + 2e-5, k


def words(lang, n, rnd):
    syllables = {"xx": ["ba", "do", "ki"], "yy": ["çe", "üm", "ña"], "zz": ["st", "rk", "pl"]}[lang]
    return " ".join("".join(rnd.choice(syllables, rnd.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(2)
    return [(i, words(lang, int(rnd.integers(3, 90)), rnd), lang) for i in range(240) for lang in (["xx", "yy", "zz"][i % 3],)]


def test_held_out_accuracy_and_cases(spark, rows):
    extra = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", "zz"), (1004, "½ ② Ⅷ ٣ _", "zz"), (1005, "ª", None), (None, rows[0][1], "xx"), (1003, words("yy", 4000, np.random.default_rng(5)), None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double").repartition(3)
    out = L.identify(df).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r.doc_id: r for r in out}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    held = [(lang, got[i].lang_pred) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002, 1004)] == [("und", 0.0)] * 4
    assert got[1005].lang_pred != "und"  # category Lo
    assert got[1003].lang_pred == "yy" and got[None].lang_pred == "xx" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in out)
    again = {r.doc_id: r for r in L.identify(df.repartition(2)).collect()}
    assert all(abs(got[k].score - again[k].score) < 1e-5 for k in got)


def test_positions_and_nothing_labelled(spark, rows):
    net = L.trained([(lang, t) for _, t, lang in rows], steps=150)
    text = "badokiba doba kidoba " * 3 + "çeümña ümçe ñaçe " * 3
    labels = L.position_labels(net, text)
    assert len(labels) == len(text.encode()) and labels[:50].count("xx") > 40 and labels[-50:].count("yy") > 40
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(df).collect()] == [("und", 0.0)]
    assert L.identify(df.limit(0)).count() == 0


def test_whole_table_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [(lang[r.doc_id], r.lang_pred) for r in L.identify(docs).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_characters_across_segments():
    net = L.Network(["a", "b"])
    text = ("x" * (L.SEGMENT - 1) + "é日") * 3
    data = np.frombuffer((text + "tail").encode(), np.uint8)
    both = L.pooled(net, data, np.array([0, len(data) - 4, len(data)]))
    assert np.allclose(both.sum(1), 1, atol=1e-4)
    assert np.allclose(both[1], L.pooled(net, data[-4:], np.array([0, 4]))[0], atol=1e-6)


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"wörd {i} only", "xx" if i % 9 else "yy") for i in range(2000)], "doc_id long, text string, lang string")
    net = L.learned(df, per_language=32)
    assert net.languages == ["xx", "yy"]
