"""Near duplicates among embeddings: a small-world graph per shard, every vector searched in every shard of its label.

Equal vectors of a label are one node with a weight. The nodes of a label are dealt to shards of a bounded size; a shard's graph
(`hnsw.Graph`) is built in one task and written. A cell is a pair of shards of one label, a bounded piece of work however large
a label or a group of copies is: both graphs are searched with the vectors of the other, a vector's beam widens until less
than half of what it holds are links, and all beams widen until an audit of every cell passes: of the queries of every AUDIT-th place, each
link and REQUIRED of the nearest vectors must have been found, by a scan of the shard. What is found is verified by its cosine
in double precision, and counts for both sides. A cell gives each of its linked vectors once, with the number of its links and one
vector that it is connected to, never the pairs; components are joined over those.

The number of cells of a label grows with the square of its shards, as every vector meets every shard; each shard travels to as
many cells as its label has shards.

Defined results: labels are equal as values; a null label, a null or empty vector, one with a null, NaN or infinite component
and one of zeros link with nothing, and vectors of different lengths never link. Repeated rows are vectors of their own and
link with each other; rows with a null id count as links, and a component's id is the smallest that is not null. Other columns,
whatever their names, are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C
from pixelloom.llm.hnsw import Graph, unit_rows
from pixelloom.llm.neardup import components

#: Vectors of a shard: at most so many, and so many bytes of doubles.
SHARD_ROWS, SHARD_BYTES = 4096, 8 << 20
#: Width of the first beam; every so many queries are audited; share of nearest vectors that the audit requires.
BEAM, AUDIT, REQUIRED = 48, 16, 0.9
#: How far a similarity in single precision may lie below one in double.
SLACK = 1e-4


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _space(label: str, vector: str) -> Column:
    """What vectors have to share to be compared; null for those that link with nothing."""
    return F.when(F.col(label).isNotNull() & _usable(F.col(vector)), F.concat_ws("/", F.size(vector).cast("string"), F.col(label).cast("string")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _built(table: pa.Table) -> pa.Table:
    """One row of a shard (space, shards, shard, node, weight, vector): its vectors, nodes and graph as bytes."""
    table = table.sort_by("node")
    x = unit_rows(_matrix(table["vector"]))
    g = Graph(x)
    return pa.table(
        {
            "space": table["space"][:1],
            "shards": table["shards"][:1],
            "shard": table["shard"][:1],
            "dim": pa.array([x.shape[1]], pa.int32()),
            "nodes": pa.array([table["node"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "weights": pa.array([table["weight"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([x.tobytes()], pa.binary()),
            "layers": pa.array([[a.tobytes() for a in g.layers]], pa.list_(pa.binary())),
            "sizes": pa.array([[len(a) for a in g.layers]], pa.list_(pa.int32())),
        }
    )


SHARD = "space string, shards int, shard int, dim int, nodes binary, weights binary, vectors binary, layers array<binary>, sizes array<int>"


class _Shard:
    def __init__(self, row: dict):
        self.nodes, self.weights = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        self.graph = Graph(self.x, [np.frombuffer(a, np.int32).reshape(n, -1) for a, n in zip(row["layers"], row["sizes"], strict=True)])


def _scan(queries: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, vector) of a cosine of least or more."""
    parts = [(np.nonzero(queries[lo : lo + 512] @ x.T >= least), lo) for lo in range(0, len(queries), 512)]
    return np.concatenate([p[0] + lo for p, lo in parts]), np.concatenate([p[1] for p, _ in parts])


def searched(queries: np.ndarray, graph: Graph, x: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector of the graph) with a cosine of least or more, verified; beams widen until the audit passes."""
    sample = np.arange(0, len(queries), AUDIT)
    hits = _scan(queries[sample], x, least)
    true = sample[hits[0]] * len(x) + hits[1]
    first = (queries[sample] @ x.T).argmax(1)
    while True:
        found, nearest = _widened(queries, graph, x, least, beam)
        same = (queries[sample] * x[nearest[sample]]).sum(1) >= (queries[sample] * x[first]).sum(1) - SLACK
        if np.isin(true, found).all() and same.mean() >= REQUIRED or beam >= len(x):
            return found // len(x), found % len(x)
        beam *= 2


def _widened(queries: np.ndarray, graph: Graph, x: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes query * len(x) + vector of what is found, nearest vector of each query); beams that are half full of links are widened."""
    rows, codes, nearest = np.arange(len(queries)), [], np.zeros(len(queries), np.int64)
    while len(rows):
        ids, sims = graph.search(queries[rows], beam)
        nearest[rows] = np.take_along_axis(ids, sims.argmax(1)[:, None], 1)[:, 0]
        near = (sims >= least - SLACK) & (ids >= 0)
        full = (2 * near.sum(1) >= beam) & (beam < len(x))
        at, slot = np.nonzero(near & ~full[:, None])
        q, v = rows[at], ids[at, slot].astype(np.int64)
        for lo in range(0, len(q), 1 << 16):
            a, b = q[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)]
            sure = np.einsum("kd,kd->k", queries[a], x[b]) >= least
            codes.append(a[sure] * len(x) + b[sure])
        rows = rows[full]
        beam = beam * 4 if beam * 16 < len(x) else len(x)
    return np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), nearest


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position connected to each of n positions over links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _cell(least: float):
    """(a, b, links) of a pair of shards: node, a node it is connected to, and the weight of what it is linked with."""

    def run(table: pa.Table) -> pa.Table:
        sides = [_Shard(r) for r in table.sort_by("shard").to_pylist()]
        one, two = sides[0], sides[-1]
        a, b = searched(one.x, two.graph, two.x, least)
        if one is not two:
            c, d = searched(two.x, one.graph, one.x, least)
            codes = np.unique(np.concatenate([a * len(two.x) + b, d * len(two.x) + c]))
            a, b = codes // len(two.x), codes % len(two.x) + len(one.x)
            nodes, weights = np.append(one.nodes, two.nodes), np.append(one.weights, two.weights)
        else:
            codes = np.unique(np.minimum(a, b) * len(one.x) + np.maximum(a, b))
            a, b = codes // len(one.x), codes % len(one.x)
            a, b = a[a != b], b[a != b]
            nodes, weights = one.nodes, one.weights
        links = np.bincount(a, weights[b], len(nodes)) + np.bincount(b, weights[a], len(nodes))
        label = _labels(len(nodes), a, b)
        has = np.flatnonzero(links)
        return pa.table({"a": nodes[has], "b": nodes[label[has]], "links": links[has].astype(np.int64)})

    return run


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept (it is that id)."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.select("id", _space("label", "vector").alias("space"), "vector")
    nodes = rows.where("space is not null").groupBy("space", "vector").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    nodes = C.written(nodes.select(F.monotonically_increasing_id().alias("node"), "space", "vector", "low", "weight"), "nodes")
    held = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / 8 / F.max(F.size("vector")))))
    sizes = nodes.groupBy("space").agg(F.ceil(F.count("*") / held).cast("int").alias("shards"))
    dealt = nodes.join(sizes, "space").select("space", "shards", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("shard"), "node", "weight", "vector")
    shards = C.written(dealt.groupBy("space", "shard").applyInArrow(_built, SHARD), "shards")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    cells = shards.select("*", every.alias("other")).withColumns({"lower": F.least("shard", "other"), "upper": F.greatest("shard", "other")})
    found = cells.drop("other").groupBy("space", "lower", "upper").applyInArrow(_cell(least), "a long, b long, links long")
    found = C.written(found, "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).select(F.col("id").alias("node"), "component")
    named = nodes.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select("space", "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = rows.join(named, ["space", "vector"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
