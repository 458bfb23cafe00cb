import numpy as np
import pytest

from pixelloom.llm import hnsw, queries, vectordup

NAN, INF = float("nan"), float("inf")


def truth(rows, least=0.93):
    """Rows (id, vector, label) by brute force; the position is the row's identity."""
    ok = [bool(v) and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    units = [np.array(v, np.float64) / np.abs(v).max() if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    n = len(rows)
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, work = {i}, [i]
        while work:
            for j in near[work.pop()]:
                if j not in seen:
                    seen.add(j)
                    work.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, low == rows[i][0]))
    return sorted(out, key=repr)


def table(seed, n=500, dim=12):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i and rng.random() < 0.5:
            base = np.array(out[int(rng.integers(0, i))][1])
            base = base / np.abs(base).max()
            v = base + rng.normal(size=dim) * rng.choice([0, 0.05, 0.15, 0.3]) * np.linalg.norm(base) / np.sqrt(dim)
        if i % 7 == 0:
            v = np.array(out[0][1] if out else v) * float(rng.choice([1, 2.0, 1e-150, 1e150])) + (rng.normal(size=dim) * 0.001 if i % 2 else 0)
        out.append((i, v.tolist(), int(rng.integers(0, 3))))
    return out


ODD = [
    (None, [1.0, 0.0], 1), (901, [2.0, 0.0], 1), (902, [1.0, 0.0, 0.0], 1), (903, None, 1), (904, [], 1), (905, [0.0, 0.0], 1), (906, [1.0, NAN], 1), (907, [INF, 1.0], 1),
    (908, [1.0, None], 1), (909, [1.0, 0.0], None), (910, [1.0, 0.01], 1), (910, [1.0, 0.01], 1), (911, [-1.0, 0.0], 1), (912, [1.0, 0.0], 2),
]


@pytest.mark.parametrize(("seed", "shard"), [(1, 4096), (2, 60)])
def test_matches_brute_force(spark, seed, shard):
    rows = table(seed) + ODD
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, space int").repartition(5)
    got = sorted((tuple(r) for r in vectordup.near_duplicates(df, shard_rows=shard).collect()), key=repr)
    assert got == truth(rows)


def test_query_on_floats_and_an_empty_table(spark, tmp_path):
    rows = [(i, np.array(v, np.float32).tolist(), lab) for i, v, lab in table(3, 200) if max(map(abs, v)) < 1e30 and max(map(abs, v)) > 1e-30]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted((tuple(r) for r in queries.op11_embedding_near_dedup(spark, str(tmp_path)).collect()), key=repr) == truth(rows)
    assert vectordup.near_duplicates(df.limit(0)).count() == 0


def test_one_group_of_copies_larger_than_any_beam():
    """Beams widen past a group of copies; every link is found, in both directions, and pairs at the threshold are exact."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=64)
    x = hnsw.unit_rows(np.concatenate([base + 0.2 * rng.normal(size=(900, 64)), rng.normal(size=(1500, 64)), base + 0.27 * rng.normal(size=(300, 64))]))
    x = x[rng.permutation(len(x))]
    a, b = vectordup.searched(x, hnsw.Graph(x), x, 0.93)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(c.tolist() for c in np.nonzero(x @ x.T >= 0.93)), strict=True))


def test_recall_of_plain_beams():
    rng = np.random.default_rng(1)
    x = hnsw.unit_rows(rng.normal(size=(3000, 64)))
    near = hnsw.unit_rows(x + 0.02 * rng.normal(size=x.shape))
    ids, _ = hnsw.Graph(x).search(near, vectordup.BEAM)
    assert (ids == np.arange(len(x))[:, None]).any(1).mean() >= 0.99
    top = np.argsort(-(near @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(t) & set(i)) / 10 for t, i in zip(top.tolist(), ids.tolist(), strict=True)]) >= 0.9


def test_the_audit_widens_beams(monkeypatch):
    """A graph whose links are lost finds nothing but by widening up to a scan."""
    rng = np.random.default_rng(2)
    x = hnsw.unit_rows(np.repeat(rng.normal(size=(100, 16)), 2, axis=0) + 0.01 * rng.normal(size=(200, 16)))
    lost = hnsw.Graph(x)
    lost.layers = [np.full_like(a, -1) for a in lost.layers]
    a, b = vectordup.searched(x, lost, x, 0.93)
    assert len(a) == (x @ x.T >= 0.93).sum()
