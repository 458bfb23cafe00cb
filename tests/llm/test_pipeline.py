import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from pixelloom.llm import langid
from tests.llm.test_decontam import truth as contaminated
from tests.llm.test_neardup import truth as groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "x", 0), (10_002, "12 34", None, "x", 5), (None, "the only of thing with the and", None, None, None)], docs.schema)
    twice = docs.limit(3)
    steps = stages(spark, docs.unionByName(extra).unionByName(twice), sf)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    for df in steps[:-1]:
        assert df.columns == COLUMNS
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in steps[:-1]]
    assert not {10_001, 10_002} & {d for d, _ in rows[1]} and len(rows[1]) >= 0.97 * len(rows[0])
    last = {}
    for d, t in rows[1]:
        last[t] = max(last.get(t, d), d, key=lambda x: -1 if x is None else x)
    assert sorted(rows[2], key=str) == sorted(((d, t) for t, d in last.items()), key=str)
    want = {d for d, _, c in groups(rows[2], 5, 80) if d == c}
    assert {d for d, _ in rows[3]} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, v in contaminated(rows[3], items, 13).items() if v[4]}
    assert bad and {d for d, _ in rows[4]} == {d for d, _ in rows[3]} - bad
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = steps[-1].collect()
    assert sum(r.length for r in packed) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows[4])
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.1 * sum(used.values()) / 2048 + 1


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert stages(spark, docs, "/root/testdata/sf0.001")[-1].count() == 0


@pytest.mark.parametrize("least", [0.0, 1.1])
def test_threshold(spark, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert langid.accepted(docs, least=least, net=langid.trained([("en", "the and"), ("fr", "le les")], steps=2)).count() == (docs.count() if least == 0 else 0)


def test_extra_columns_of_any_name_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    names = ["kept_id", "bad_id", "kept_sha", "keep_id", "kept", "text_sha256", "contaminated", "id", "rid", "component_id", "_docs", "_ids"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(2)).select("*", *(F.lit(7).alias(n) for n in names))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= 42, name
    assert P.best_fit_packing(spark, docs, sf).count() >= 42
