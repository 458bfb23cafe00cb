import random
import re

import numpy as np
import pytest

from pixelloom.llm import neardup as N


def shingles(t, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def truth(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [(d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(copy) // 15))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy) if rnd.random() < 0.8 else "\n".join(copy).upper())
    rows += [None, "", " \n", "one", "ONE", "one two", "é é é é"]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [N.BLOCK, 3])
def test_components_match_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, shingle=2, block=block).collect()}
    want = {d: (n, c, c == d) for d, n, c in truth(rows, 2, 80)}
    assert got == want
    assert 5 < sum(not k for _, _, k in got.values())


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text + " x"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df, shingle=2).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (9, 5, False), (None, None, True)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_sketch_is_a_function_of_the_set_and_estimates_similarity():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.sort(pool[:800]), np.sort(pool[100:900]), pool[:3], pool[:1], pool[5:40]]
    flat, first = np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets]))
    table = N.sketches(flat, first, 512)
    for i, s in enumerate(sets):
        assert (N.sketches(s, np.array([0, len(s)]), 512)[0] == table[i]).all()
    assert abs((table[0] == table[1]).mean() - 700 / 900) < 0.08
    small = [np.sort(pool[:10]), np.sort(pool[1:11])]
    t = N.sketches(np.concatenate(small), np.array([0, 10, 20]), 512)
    assert abs((t[0] == t[1]).mean() - 9 / 11) < 0.08


def test_recall_on_twelve_thousand_documents(spark):
    """Against all linked pairs, found by an inverted index: edited copies about the threshold, and one group of very many."""
    rnd = np.random.default_rng(7)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for i in range(3000):
        base = rnd.choice(vocabulary, int(rnd.integers(30, 60)))
        for _ in range(3 if i else 2500):
            copy = base.copy()
            for _ in range(int(rnd.integers(0, 4))):
                copy[rnd.integers(0, len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = [(int(d), t) for d, t in zip(rnd.permutation(len(texts)), texts, strict=True)]
    sets = {d: shingles(t, 2) for d, t in rows}
    posts = {}
    for d, s in sets.items():
        for x in s:
            posts.setdefault(x, []).append(d)
    linked = set()
    for d, s in sets.items():
        common = {}
        for x in s:
            if len(posts[x]) < 300:  # the great group is judged below
                for o in posts[x]:
                    if o < d:
                        common[o] = common.get(o, 0) + 1
        linked |= {(o, d) for o, n in common.items() if 100 * n >= 80 * (len(s) + len(sets[o]) - n)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = N.near_duplicates(df, shingle=2, block=512).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert len(rows) > 11_000 and len(linked) > 3000
    assert sum(got[a] == got[b] for a, b in linked) >= 0.999 * len(linked)
    great = [d for d, _ in rows[:2500]]
    first = sets[great[0]]
    near = [d for d in great if 100 * len(sets[d] & first) >= 80 * len(sets[d] | first)]
    assert len(near) > 500 and len({got[d] for d in near}) == 1


def test_words_that_defeat_polynomial_hashes(spark):
    """Two texts of different words throughout, which polynomial hashes modulo 2^64 cannot tell apart, are not linked."""
    from tests.llm.test_repeats import thue_morse

    rows = []
    for k, size in enumerate((512, 1024, 4096)):
        one, two = thue_morse(size)
        rows += [(10 * k, f"{one} {k}x {one}"), (10 * k + 1, f"{two} {k}y {two}"), (10 * k + 2, f"{one} {k}x {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, shingle=2).collect()}
    assert got == {i: i - 2 if i % 10 == 2 else i for i, _ in rows}


def test_components_of_long_chains_in_few_rounds(spark, monkeypatch):
    """Chains in random order, two chains that meet at their ends only, stars and trees."""
    rnd = random.Random(2)
    ids = list(range(-1000, 1000))
    rnd.shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(i, i + 2) for i in range(3000, 3400)] + [(3400, 3401)]
    links += [(5000, 5000 + i) for i in range(1, 200)] + [(5999, 5500 + i) for i in range(200)] + [(7, 7), (8000, 8000)]
    links += [(6000 + i, 6000 + rnd.randrange(i)) for i in range(1, 500)]
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    tables, written = [], N.C.written
    monkeypatch.setattr(N.C, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    got = N.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert sorted((r.id, r.component) for r in got) == sorted((x, root(x)) for x in up if x != 8000)
    assert len(tables) < 20


def test_rounds_join_about_one_link_for_each_member(spark, monkeypatch):
    """Each of 64 bands links the members of a group to another first one; the rounds do not carry these links along."""
    rnd = random.Random(6)
    members = range(600)
    links = set()
    for _ in range(64):
        band = [m for m in members if rnd.random() < 0.3]
        links |= {(m, band[0]) for m in band[1:]}
    tables, written = [], N.C.written
    monkeypatch.setattr(N.C, "written", lambda df, name: tables.append((name, written(df, name))) or tables[-1][1])
    got = N.components(spark.createDataFrame(sorted(links), "a long, b long").repartition(4)).collect()
    linked = {x for link in links for x in link}
    assert sorted((r.id, r.component) for r in got) == [(m, 0) for m in sorted(linked)] and 0 in linked
    sizes = [t.count() for _, t in tables]
    assert sizes[0] == len(links) > 4 * len(members) and sum(sizes[1:]) < 5 * len(members)
