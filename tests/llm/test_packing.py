import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from pixelloom.llm.packing import Encoder, cuts, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b\n\n c's 's\t", "<|endoftext|>", "<|endoftext|> x", "one  <|endoftext|>\ntwo<|endoftext", "<|endoftext|><|endoftext|>", "é ñ x y\x1cz\x85", "日本 ١٢", "don't we'LL ''s  ", "x" * 3000, "²½ 3²"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    enc = Encoder(PATH)
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc(t) == b"".join(i.to_bytes(4, "little") for i in ids), t[:80]


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)]
    assert cuts(8, 4) == [(0, 4), (4, 4)]
    assert cuts(1, 4) == [(0, 1)]


def fit(histogram, size):
    """Best fit decreasing, one piece at a time."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            ok = [b for b in bins if b[0] >= length]
            if ok:
                min(ok)[0] -= length
            else:
                bins.append([size - length])
    return len(bins)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(2)
    for _ in range(60):
        size = rnd.choice([7, 16, 50])
        histogram = {n: rnd.randint(1, 12) for n in rnd.sample(range(1, size + 1), rnd.randint(1, 6))}
        used = {}
        for length, _, number, first, each, place in plan(histogram, size):
            for r in range(number):
                used.setdefault(first + r // each, []).append((place + r % each * length, length))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        assert len(used) == fit(histogram, size)
        ranks = {}
        for length, rank, number, *_ in plan(histogram, size):
            assert rank == ranks.get(length, 0)
            ranks[length] = rank + number
        assert ranks == histogram


def test_pack(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(1, "word " * 70), (2, None), (2, None), (3, ""), (4, "a b c"), (None, "x y"), (5, "é" * 40), (6, "a<|endoftext|> b")]
    df = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, length int")
    got = pack(df, PATH, size=16).collect()
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, s, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + n]))) for k, (s, n) in enumerate(cuts(len(ids), 16))]
        assert sorted(docs[d]) == sorted(want * (2 if d == 2 else 1))
    assert pack(df.limit(0), PATH).count() == 0
