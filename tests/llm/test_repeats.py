import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pixelloom.llm import suffix
from pixelloom.llm.substring import dedup_word_windows
from pixelloom.llm.suffix import dedup_byte_strings, repeat_groups


def corpus(seed=1, sep=" "):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5)))
    passages = [sep.join(word() for _ in range(rnd.randint(8, 30))) for _ in range(8)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else sep.join(word() for _ in range(rnd.randint(1, 20))))
        out.append((i, sep.join(parts)))
    out += [(60, out[3][1]), (61, None), (62, ""), (63, " \t\n"), (64, "a " * 50), (65, out[4][1] + " x"), (66, "é" * 90)]
    return out


def covered(units, starts, window):
    mask = [False] * len(units)
    for s in starts:
        for k in range(s, s + window):
            mask[k] = True
    return mask


def brute(rows, window, split):
    docs = [split(t) for _, t in rows]
    count = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    return [(d, covered(d, [i for i in range(len(d) - window + 1) if count[tuple(d[i : i + window])] > 1], window)) for d in docs]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_word_windows_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rid string").repartition(3)
    got = {r.doc_id: r for r in dedup_word_windows(df, window=9).collect()}
    for (i, _), (units, mask) in zip(rows, brute(rows, 9, words), strict=True):
        kept = b" ".join(u for u, m in zip(units, mask, strict=True) if not m)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(units), sum(mask), hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in got.values()) > 100


@pytest.mark.parametrize(("gram", "group"), [(40, 2048), (6, 2048), (6, 1)])
def test_byte_strings_match_brute_force(spark, gram, group, monkeypatch):
    """Also with anchors so short that many passages share them, and with every such anchor dealt out by longer ones."""
    monkeypatch.setattr(suffix, "GRAM", gram)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in dedup_byte_strings(df, window=45, group=group).collect()}
    for (i, _), (units, mask) in zip(rows, brute(rows, 45, lambda t: list((t or "").encode())), strict=True):
        kept = bytes(u for u, m in zip(units, mask, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and not (k and mask[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(units), sum(mask), spans, hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in got.values()) > 500


def test_repeated_and_null_ids_are_separate_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_word_windows(df).collect()) == [0, 0, 40, 40]
    assert dedup_word_windows(df.limit(0)).count() == 0
    assert dedup_byte_strings(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2048, 1])
def test_groups_hold_all_occurrences(spark, group, monkeypatch):
    monkeypatch.setattr(suffix, "GRAM", 6)
    rows = [(i, t) for i, t in corpus(3) if i < 40]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    data = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in repeat_groups(df, window=45, group=group).collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    covered_bytes = set()
    for (_, n), places in groups.items():
        strings = {data[d][s : s + n] for d, s in places}
        assert len(strings) == 1 and len(places) > 1
        (string,) = strings
        assert places == {(d, s) for d, x in data.items() for s in range(len(x) - n + 1) if x[s : s + n] == string}
        covered_bytes |= {(d, k) for d, s in places for k in range(s, s + n)}
    want = {(i, k) for (i, _), (_, mask) in zip(rows, brute(rows, 45, lambda t: list((t or "").encode())), strict=True) for k, m in enumerate(mask) if m}
    assert groups and covered_bytes == want


def test_common_prefixes_in_bytes():
    rnd = random.Random(4)
    for _ in range(40):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) for _ in range(4)] + ["a" * 30, "a" * 33]
        flat = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.append(0, np.cumsum([len(t) for t in texts]))
        ends = np.repeat(off[1:], np.diff(off))
        order = suffix.suffix_array(flat, ends)
        tails = [flat[i : ends[i]].tobytes() for i in order]
        assert tails == sorted(tails)
        want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(tails, tails[1:], strict=False)]
        assert suffix.common_prefixes(flat, order, ends).tolist() == want


def test_interval_tree_gives_maximal_repeats():
    for seed in range(30):
        rnd = random.Random(seed)
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 25))) for _ in range(3)]
        flat = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.append(0, np.cumsum([len(t) for t in texts]))
        got = {(n, tuple(s.tolist())) for n, s in suffix.passage_repeats(flat, off, 3)}
        occ = {}
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 3, len(t) + 1):
                    occ.setdefault(t[i:j], []).append((int(off[k] + i), t[i - 1] if i else f"^{k}", t[j] if j < len(t) else f"${k}"))
        want = {(len(s), tuple(p for p, _, _ in o)) for s, o in occ.items() if len(o) > 1 and len({x for _, x, _ in o}) > 1 and len({x for _, _, x in o}) > 1}
        assert got == want, seed


def test_runs_are_the_same_in_pieces(monkeypatch):
    """Very long documents are scanned in pieces; every window keeps its key, and none is lost or doubled."""
    from pixelloom.llm import _repeats as R

    rnd = np.random.default_rng(8)
    units, first = rnd.integers(0, 5, 1000).astype(np.uint64), np.array([0, 3, 3, 700, 1000])

    def windows():
        h, _, doc, j0, n = R._runs(units, units, first, 20, 6)
        return [(int(d), int(s), int(k)) for k, d, a, m in zip(h, doc, j0, n, strict=True) for s in range(a, a + m)]

    whole = windows()
    monkeypatch.setattr(R, "_PIECE", 64)
    assert sorted(windows()) == sorted(whole) and len(whole) == (697 - 19) + (300 - 19)


def thue_morse(size, a="a", b="b"):
    """A word over two letters and its mirror: polynomial hashes modulo 2^64 cannot tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


@pytest.mark.parametrize("size", [256, 512, 1024, 4096])
def test_words_that_defeat_polynomial_hashes(spark, size):
    one, two = thue_morse(size)
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(0, f"{same} {one}"), (1, f"{same} {two}"), (2, one), (3, two), (4, " ".join(one[:300])), (5, " ".join(two[:300]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_removed for r in dedup_word_windows(df).collect()}
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, brute(rows, 35, words), strict=True)}
    got = {r.doc_id: r.n_removed for r in dedup_byte_strings(df).collect()}
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, brute(rows, 200, lambda t: list(t.encode())), strict=True)}


def test_word_hashes_tell_words_apart():
    from pixelloom.llm import _common as C

    rnd = random.Random(3)
    text = ["x" * n for n in range(1, 600)] + [w for n in (256, 512, 1024, 4096) for w in thue_morse(n)]
    text += ["".join(rnd.choice("ab\0") for _ in range(rnd.randint(1, 20))) for _ in range(3000)] + ["a", "a\0", "a" * 8, "a" * 8 + "\0"]
    data = np.frombuffer(" ".join(text).encode(), np.uint8)
    starts, ends, _ = C.word_spans(data, np.array([0, len(data)]))
    for which in (0, 1):
        units = C.word_units(data, starts, ends, which)
        assert len({(t, u) for t, u in zip(text, units.tolist(), strict=True)}) == len(set(text)) == len(set(units.tolist()))
    assert not (C.word_units(data, starts, ends) == units).any()


def test_runs_of_single_anchors_are_let_go_at_once(spark, tmp_path):
    """Only runs whose anchor occurs again are kept for the counts; the table of all runs is deleted."""
    import os

    from pixelloom.llm import _common as C
    from pixelloom.llm import _repeats as R

    rnd = random.Random(9)
    fresh = lambda: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(200))
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, fresh()) for i in range(40)] + [(100 + i, f"{fresh()} {common} {fresh()}") for i in range(3)] + [(200, rows_text := fresh()), (201, rows_text)]
    df = spark.createDataFrame(rows, "rid long, text string").repartition(3)
    folder = C.scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    runs = R.scanned(df, "word", 35, 18).collect()
    assert {r.rid for r in runs} == {100, 101, 102, 200, 201}
    assert len(runs) < 60
    assert all(x.startswith("runs-") for x in set(os.listdir(folder)) - before)
    got = {r.doc_id: r.n_removed for r in dedup_word_windows(df.withColumnRenamed("rid", "doc_id")).collect()}
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, brute(rows, 35, words), strict=True)}
