import hashlib
import random
import re

import pytest

from pixelloom.llm.decontam import Machine, contamination, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def truth(docs, items, window):
    out = {}
    for d, t in docs:
        w = split(t)
        hit, found = [False] * len(w), set()
        for i, x in items:
            p = split(x)
            n = min(window, len(p))
            for k in range(len(p) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == p[k : k + n]:
                        found.add(str(i))
                        hit[s : s + n] = [True] * n
        h = sum(hit)
        out[d] = (len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    return out


def test_words_match_the_pattern():
    t = "Ab-c\x1cd É’x\u0085y z 12_3\x7f"
    assert [w.decode() for w in words(t.encode())] == split(t)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_matches_brute_force(spark, part_bytes):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["aa", "bb", "Cc", "dé", "e1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 12, 20, 0])] + [(77, None), (2, "zz zz zz zz zz"), (10, "q-q")]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 12)))]
        if rnd.random() < 0.5:
            parts.append(rnd.choice(items)[1] or "")
        docs.append((i, "\n ".join([*parts, "x y z"])))
    docs += [(100, None), (101, ""), (102, "zz ZZ zz-zz zz " + "pad " * 94), (103, "zz zz zz zz zz " + "pad " * 96)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, s int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in contamination(df, bench, window=5, part_bytes=part_bytes).collect()}
    assert got == truth(docs, items, 5)
    assert got[102][4] and not got[103][4]


def test_empty_benchmark_and_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in contamination(df, none).collect()] == [(2, 0, 0)]
    assert contamination(df.limit(0), none).count() == 0


def test_jumps_skip_impossible_places():
    item = [b"a", b"b", b"c", b"d"]
    m = Machine([item], [(0, 0, 4)])
    assert m.shift == {(b"a", b"b"): 2, (b"b", b"c"): 1, (b"c", b"d"): 0} and m.jump == 3
    assert list(m.search([b"x"] * 5 + item + [b"a", b"b"])) == [(0, 5, 9)]
