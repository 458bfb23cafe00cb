"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch. A document's shingles are thrown into `coords` bins by a fresh hash in each round; a bin keeps the smallest value
of the first round that reached it, so every coordinate fills after a few rounds instead of after coords passes, and the
share of equal coordinates is concentrated around the Jaccard similarity as for independent minima. Bins still empty after
coords rounds take, in round coords + b, the minimum over all shingles, which ends the filling for any document.

Banding. Equal sets are one class. Classes that share a band meet in a bucket; there an estimate from the whole sketches
removes chance meetings, and what remains is joined to a forest, so a bucket gives fewer links than it has members.
Estimates lie ESTIMATE_SLACK (over five standard deviations) below the threshold.

Verification. Candidate groups, the components of those forests, fetch their documents' full shingle sets and are linked
exactly. Components of exact links are final. No pair list is ever written. In a group of more than BLOCK members, of a band
or of candidates, each member is first compared with one pivot, in tasks that share no state; only those that are not linked
to it are then compared with the others, block by block. A group of near copies of one text thus costs a comparison for
each member, and only what differs from its pivot costs more.

Missing a link needs all bands to differ: below 1e-5 at similarity 0.8 with the default 64 bands of 8.

Texts are lower-cased in A-Z, words are maximal runs of characters other than space and \\t \\n \\v \\f \\r. With fewer words
than `shingle`, the whole sequence is the only shingle. Null, empty and wordless texts have no shingles and stay alone.
Repeated rows give repeated results. A null id is never the smallest while the component has another. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C
from pixelloom.llm._common import U64

BANDS, ROWS = 64, 8
#: Coordinates kept, a byte each, to estimate a similarity.
ESTIMATE_BYTES = 128
ESTIMATE_SLACK = 0.2
#: Members of a group that one task compares with each other.
BLOCK = 2048


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each document): the distinct shingles of every document of a slice, sorted within it."""
    data = C.LOWER[data]
    starts, ends, first = C.word_spans(data, bounds)
    words = C.word_units(data, starts, ends)
    n = np.diff(first)
    take = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[doc]
    width = np.minimum(n, size)[doc]
    pre = C.prefix(words, 1)
    hashes = C.span_hash(pre, at, at + width, 1) if len(at) else np.zeros(0, U64)
    hashes += width.astype(U64)
    order = np.argsort(hashes)  # by document, then by hash: a stable second sort of small numbers
    order = order[np.argsort(doc[order].astype(np.uint16 if len(n) < 65536 else np.int64), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


_EARLY = 12
_VALUE = U64((1 << 54) - 1)
_EMPTY = np.iinfo(np.uint64).max
_ROUND = np.arange(1, 4097, dtype=U64) * U64(0x9E3779B97F4A7C15)
_LATE = np.arange(1, 4097, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)


def _bins(x: np.ndarray, coords: int) -> np.ndarray:
    return ((x >> U64(40)) * U64(coords) >> U64(24)).astype(np.int64)


def sketches(hashes: np.ndarray, first: np.ndarray, coords: int) -> np.ndarray:
    """A row of coords coordinates for each document; documents without shingles have zeros.

    The first rounds run over all documents at once, later ones over a single document's rounds at once; a set gives the
    same coordinates either way.
    """
    docs = len(first) - 1
    table = np.full((docs, coords), _EMPTY, U64)
    flat = table.reshape(-1)
    count = np.diff(first)
    doc = np.repeat(np.arange(docs), count)
    unfilled = count > 0
    for turn in range(min(_EARLY, coords)):
        if not unfilled.any():
            break
        use = unfilled[doc]
        x = C.mix(hashes[use] + _ROUND[turn])
        cell = doc[use] * coords + _bins(x, coords)
        free = flat[cell] == _EMPTY
        np.minimum.at(flat, cell[free], x[free] >> U64(10))
        unfilled = (table == _EMPTY).any(1) & (count > 0)
    for d in np.flatnonzero(unfilled):
        own, row, lo = hashes[first[d] : first[d + 1]], table[d], _EARLY
        while lo < coords and (row == _EMPTY).any():
            hi = min(coords, lo + min(1000, max(8, 4096 // len(own))))
            x = C.mix((own[None, :] + _ROUND[lo:hi, None]).ravel())
            cell = _bins(x, coords)
            ranked = np.repeat(np.arange(hi - lo, dtype=U64), len(own)) << U64(54) | x >> U64(10)
            free = row[cell] == _EMPTY
            best = np.full(coords, _EMPTY, U64)
            np.minimum.at(best, cell[free], ranked[free])
            got = best != _EMPTY
            row[got] = best[got] & _VALUE
            lo = hi
        left = np.flatnonzero(row == _EMPTY)
        if len(left):
            row[left] = C.mix((own[None, :] + _LATE[left][:, None]).ravel()).reshape(len(left), -1).min(1) >> U64(10)
    table[count == 0] = 0
    return table


def _sketch(shingle: int, bands: int, rows: int):
    coords = bands * rows
    salt = np.random.default_rng(5).integers(1, 2**63, coords, dtype=np.uint64) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            for a, b in C.slices(off):
                hashes, first = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
                n = np.diff(first)
                sums = []
                for k in (0x51, 0xA7):
                    total = np.append(U64(0), np.cumsum(C.mix(hashes ^ U64(k * 0x0101010101010101))))
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                table = sketches(hashes, first, coords)
                keys = C.mix((table * salt).reshape(len(n), bands, rows).sum(2, dtype=U64) + np.arange(bands, dtype=U64))
                # evenly spaced coordinates: any number of them estimates equally well
                small = np.ascontiguousarray((table[:, :: max(1, coords // ESTIMATE_BYTES)][:, :ESTIMATE_BYTES] & U64(255)).astype(np.uint8))
                lists = [pa.array([x.tobytes() if m else None for x, m in zip(t, n, strict=True)], pa.binary()) for t in (keys, small)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), *lists], ["id", "doc", "n", "d1", "d2", "bands", "small"])

    return run


SKETCHED = "id long, doc long, n long, d1 long, d2 long, bands binary, small binary"


def _band_records(buckets: int):
    """Band keys of the classes, packed by bucket."""
    kind = np.dtype([("key", "u8"), ("id", "i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
            if not keys:
                continue
            rec = np.zeros(sum(map(len, keys)), kind)
            rec["key"] = np.concatenate(keys)
            rec["id"] = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            bucket = (rec["key"] >> U64(44)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")
            rec, bucket = rec[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            at = np.append(0, cuts)
            blobs = [x.tobytes() for x in np.split(rec, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "records"])

    return run


def _band_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the bands that at least two classes share. Members beyond a block each stand in several (block, block) cells."""
    kind = np.dtype([("key", "u8"), ("id", "i8")])

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        rec = np.frombuffer(b"".join(blobs), kind)
        rec = rec[np.lexsort((rec["id"], rec["key"]))]
        lead = np.ones(len(rec), bool)
        lead[1:] = rec["key"][1:] != rec["key"][:-1]
        band = np.cumsum(lead) - 1
        rec = rec[(np.bincount(band) > 1)[band]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rec["key"]).view(np.int64)), pa.array(np.ascontiguousarray(rec["id"]))], ["key", "id"])

    bucket, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != bucket and blobs:
                yield settle(blobs)
                blobs = []
            bucket = k
            blobs.append(blob)
    if blobs:
        yield settle(blobs)


class _Forest:
    """Components that keep one link for each joining."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, near: np.ndarray) -> None:
        """Link i with near: one link for each component among them."""
        labels, at = np.unique(self.label[near], return_index=True)
        own = self.label[i]
        labels, at = labels[labels != own], near[at[labels != own]]
        if len(labels):
            self.links += [(i, j) for j in at.tolist()]
            joined = np.isin(self.label, np.append(labels, own))
            self.label[joined] = min(int(own), int(labels.min()))


def _estimated(threshold: float):
    """Links between members of a cell (id, cell, side, small) whose sketches agree well enough, as a forest."""

    def settle(rows: list[tuple]) -> list[tuple[int, int]]:
        rows, across = _sided(rows)
        table = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        need = threshold * table.shape[1]
        forest = _Forest(len(rows))
        for i in range(1, len(rows)):
            near = np.flatnonzero((table[: min(i, across)] == table[i]).sum(1) >= need)
            if len(near):
                forest.join(i, near)
        return [(rows[i][0], rows[j][0]) for i, j in forest.links]

    return _by_cell(settle)


def _sided(rows: list[tuple]) -> tuple[list[tuple], int]:
    """Rows by id, side 0 first, and their number on side 0: pairs with neither on side 0 are not compared in this cell."""
    best: dict[int, tuple] = {}
    for r in rows:
        if r[0] not in best or r[2] < best[r[0]][2]:
            best[r[0]] = r
    out = sorted(best.values(), key=lambda r: r[2])
    return out, sum(r[2] == 0 for r in out)


def _by_cell(settle):
    """Links (a, b) of whole cells; rows (id, cell, side, payload) come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        links: set[tuple[int, int]] = set()

        def out() -> pa.RecordBatch:
            got = list(links)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if r[1] != cell:
                    if len(rows) > 1:
                        links.update(settle(rows))
                    cell, rows = r[1], []
                rows.append(r)
            if len(links) > 50_000:
                yield out()
        if len(rows) > 1:
            links.update(settle(rows))
        yield out()

    return run


def _agree(threshold: float):
    return lambda a, b: (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum() >= threshold * len(a)


def _similar(num: int, den: int):
    def test(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        return den * common >= num * (len(x) + len(y) - common)

    return test


def _with_pivot(test):
    """(key, id, pivot, hit) of rows (key, id, payload, pivot, its payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool(test(a, b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(hit, pa.bool_())], ["key", "id", "pivot", "hit"])

    return run


def _links(members: DataFrame, payloads: DataFrame, settle, test, block: int) -> DataFrame:
    """Links (a, b) that connect what is linked among the members (key, id) of each key. payloads (id, payload) of all;
    settle: of a cell; test: of two payloads."""
    spark = members.sparkSession
    sizes = C.written(members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")), "sizes")
    small = members.join(sizes.where(F.col("size") <= block).select("key"), "key", "left_semi").select("id", F.col("key").alias("cell"), F.lit(0).alias("side"))
    found = None
    if sizes.where(F.col("size") > block).limit(1).count():
        large = members.join(sizes.where(F.col("size") > block), "key")
        pivots = sizes.where(F.col("size") > block).join(payloads.select(F.col("id").alias("pivot"), F.col("payload").alias("pivot_payload")), "pivot").select("key", "pivot_payload")
        rows = large.join(payloads, "id").join(pivots.hint("merge"), "key").where("id <> pivot")
        tested = C.written(rows.select("key", "id", "payload", "pivot", "pivot_payload").mapInArrow(_with_pivot(test), "key long, id long, pivot long, hit boolean"), "pivots")
        found = tested.where("hit").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        rest = tested.where("not hit").select("key", "id")
        left = rest.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("rest_blocks")).join(sizes.select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "key")
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = rest.join(left, "key").select("id", "key", own("rest_blocks").alias("i"), spread("blocks").alias("j"), F.lit(0).alias("side"))
        two = members.join(left, "key").select("id", "key", spread("rest_blocks").alias("i"), own("blocks").alias("j"), F.lit(1).alias("side"))
        small = small.unionByName(one.unionByName(two).select("id", F.xxhash64("key", "i", "j").alias("cell"), "side"))
    cells = small.join(payloads.hint("merge"), "id").select("id", "cell", "side", "payload")
    links = cells.repartition(C.partitions(spark), "cell").sortWithinPartitions("cell", "id").mapInArrow(settle, "a long, b long")
    return links if found is None else links.unionByName(found)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b); ids without links are left out.

    An id's parent is the smallest of its neighbours below it. In a round its link to the parent goes to the parent's parent
    instead, and its other neighbours below are linked to that one in its place. So a round has no more links than the one
    before: after the first few an id has about one, however many bands have linked it. It ends with a star for each component.
    A table per round.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = C.written(links, "links")  # evaluated once: a second evaluation may find another forest
    for _ in range(rounds):
        low = links.groupBy("a").agg(F.min("b").alias("parent"))
        above = low.select(F.col("a").alias("parent"), F.col("parent").alias("above"))
        up = low.join(above, "parent", "left").select("a", "parent", F.coalesce("above", "parent").alias("above"))
        step = links.join(up, "a").select(F.when(F.col("b") == F.col("parent"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("above").alias("b"), F.expr("b <> above").alias("moved"))
        links = C.written(step.groupBy("a", "b").agg(F.max("moved").alias("moved")), "links")
        if links.where("moved").limit(1).count() == 0:
            break
        links = links.select("a", "b")
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            blobs = []
            for a, b in C.slices(off):
                hashes, first = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
                blobs += [hashes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["id", "payload"])

    return run


def exact_links(sets: list[np.ndarray], num: int, den: int, across: int | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs with den * intersection >= num * union. across: only pairs with at least one before it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(ids) > 1  # a shingle of one document only adds to its size
    keep = shared[ids]
    ids, owner = np.unique(ids[keep], return_inverse=True)[1], owner[keep]
    by = np.argsort(ids, kind="stable")
    ids, owner = ids[by], owner[by]
    forest = _Forest(len(sets))
    width = int(ids.max()) + 1 if len(ids) else 0
    row_start = np.searchsorted(np.sort(owner), np.arange(len(sets) + 1))
    cols = ids[np.argsort(owner, kind="stable")]
    if len(sets) <= 64 or width * len(sets) > 60_000_000:
        post = np.searchsorted(ids, np.arange(width + 1))
        for i in range(1, len(sets)):
            mine = cols[row_start[i] : row_start[i + 1]]
            if not len(mine):
                continue
            hit = np.concatenate([owner[post[c] : post[c + 1]] for c in mine.tolist()])
            common = np.bincount(hit[hit < i], minlength=i)
            _join(forest, common, sizes, i, num, den, across)
        return forest.links
    dense = np.zeros((len(sets), width), np.float32)
    dense[owner, ids] = 1
    for lo in range(0, len(sets), 256):
        common = np.rint(dense[lo : lo + 256] @ dense[: lo + 256].T).astype(np.int64)
        for i in range(max(lo, 1), min(lo + 256, len(sets))):
            _join(forest, common[i - lo][:i], sizes, i, num, den, across)
    return forest.links


def _join(forest: _Forest, common: np.ndarray, sizes: np.ndarray, i: int, num: int, den: int, across: int | None) -> None:
    ok = den * common >= num * (sizes[:i] + sizes[i] - common)
    if across is not None:
        ok[across:] = False
    near = np.flatnonzero(ok)
    if len(near):
        forest.join(i, near)


def _verified(num: int, den: int):
    def settle(rows: list[tuple]) -> list[tuple[int, int]]:
        rows, across = _sided(rows)
        links = exact_links([np.frombuffer(r[3], U64) for r in rows], num, den, across)
        return [(rows[i][0], rows[j][0]) for i, j in links]

    return _by_cell(settle)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links) and kept (it is that id).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    spark = docs.sparkSession
    parts = C.partitions(spark)
    keyed = C.with_row_key(docs, id_col, text_col).select("rid", F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    source = keyed.select(F.col("rid").alias("id"), "text", "doc")
    table = C.written(source.mapInArrow(_sketch(shingle, bands, rows), SKETCHED), "sketches")
    has = table.where("n > 0")
    classes = C.written(has.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min("doc").alias("low")), "classes")
    heads = table.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    heads = C.written(heads.select("id", "bands", "small"), "heads")
    shared = (
        heads.select("id", "bands")
        .mapInArrow(_band_records(4 * parts), "bucket int, records binary")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_band_members, "key long, id long")
    )
    shared = C.written(shared, "bands")
    near = max(0.0, percent / 100 - ESTIMATE_SLACK)
    candidates = _links(shared, heads.select("id", F.col("small").alias("payload")), _estimated(near), _agree(near), block)
    groups = components(candidates).select(F.col("component").alias("key"), "id")
    # grows with the corpus: the same plan at every size
    sets = C.written(source.join(groups.select("id").hint("merge"), "id", "left_semi").select("id", "text").mapInArrow(_sets(shingle), "id long, payload binary"), "sets")
    links = _links(groups, sets, _verified(percent, 100), _similar(percent, 100), block)
    found = components(links)
    linked = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("head", F.coalesce("component", "rep"))
    lowest = linked.where("component is not null").groupBy("head").agg(F.min("low").alias("lowest"))
    named = linked.join(lowest, "head", "left").select("d1", "d2", F.lit(True).alias("has"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    out = table.select(F.col("doc").alias("id"), "n", "d1", "d2", (F.col("n") > 0).alias("has")).join(named, ["d1", "d2", "has"], "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
