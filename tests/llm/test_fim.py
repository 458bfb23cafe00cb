import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import fim, queries

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def truth(doc_id, text):
    t = text or ""
    u = UNIT.findall(t)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, sha(t), sha(t)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(u), form, len(pre), len(mid), sha(out), sha(t)


TEXTS = [None, "", " ", "one", "Wörter, zwei\n\tdrei\x00vier 😀é", "a<P>b", "x<S>", "<M", "<<S", "a<", "<P<S<M>", "ab<S<S", "1234567890", "日本語 text x", "w " * 50_000, "z" * 200_000, "é \r\n"]


def test_matches_brute_force(spark, tmp_path):
    rows = [(None if i == 40 else i, TEXTS[i % len(TEXTS)], i) for i in range(8 * len(TEXTS))] + [(5, "same", 0), (5, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output int")  # a clashing name
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((truth(i, t) for i, t, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_texts_and_an_empty_table_is_empty(spark):
    docs = spark.createDataFrame([(7, "The quick brown fox. Jumps!")], "doc_id long, text string")
    made = fim.restored(fim.transformed(docs, plain=100, spm=0)).first()
    assert made.form == "psm" and made.output.startswith("<P>") and made.restored == "The quick brown fox. Jumps!"
    assert fim.restored(fim.transformed(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ<PSM> é\n", max_size=30), st.integers(0, 10**6))
def test_round_trip(text, key):
    n, form, low, high = fim.cut(text, str(key), plain=100)
    assert n == len(UNIT.findall(text)) and fim.rebuilt(fim.arranged(text, form, low, high), form) == text
    if form == "plain":
        assert not text or any(s in text for s in fim.SENTINELS)


@pytest.mark.parametrize("size", [1, 200])
def test_batches_cut_by_size(size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fim, "BATCH_CHARS", size)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k for k in range(50)])], ["t"])
    parts = list(fim._sized([batch], 0))
    assert len(parts) > 5 and [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
