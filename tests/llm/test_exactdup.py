import hashlib

import pytest
from pyspark.sql import functions as F

from pixelloom.llm.exactdup import exact_duplicates, sha256, stream_state

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 5000), (5, "b" * 5000), (None, "a"), (None, None), (6, "c"), (7, "a "), (8, "é"), (None, "z")]


def weak(text):
    return F.unhex(F.hex(F.length(text)))


def truth(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out, given = [], set()
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        first = d == keep and (t or "") not in given
        if first:
            given.add(t or "")
        out.append((d, keep, len(ids), first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def constant(text):
    return F.unhex(F.lit("00"))


@pytest.mark.parametrize(("digest", "files"), [(sha256, 1000), (sha256, 1), (weak, 1), (constant, 1000)])
def test_matches_brute_force(spark, digest, files):
    df = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, digest string").repartition(3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(df, digest=digest, files_per_batch=files).collect()]
    assert sorted(got, key=str) == truth(ROWS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(df).collect() == []


def test_state_goes_on_with_later_batches(spark, tmp_path):
    record = lambda rows: spark.createDataFrame([(bytes([d]), i, "f") for d, i in rows], "digest binary, doc long, file string")
    folder = f"file://{tmp_path}/state"
    stream_state(record([(1, 5), (1, 7), (2, 3)]), state=folder)
    got = {bytes(r.digest)[0]: (r.keep.doc, r.group_size) for r in stream_state(record([(2, 9), (3, 4)]), state=folder).collect()}
    assert got == {1: (7, 2), 2: (9, 2), 3: (4, 1)}
