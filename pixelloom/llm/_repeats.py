"""Passages that repeat anywhere in a corpus: what word and byte deduplication share.

Every window of `window` units is represented by the smallest hash of the `gram`-unit strings in it, its anchor, so that
equal windows have equal anchors wherever they stand. Neighbouring windows with one anchor form a run (anchor, document,
starts), which is the anchor with all that its windows add to it on both sides.

1. Anchors are counted over the corpus. A run whose anchor occurs once cannot hold a repeated window and ends here.
2. Runs are counted over the corpus by anchor and content, which is a 64-bit BLAKE2b of the run's bytes, or of the second
   hashes of its words: only runs of one anchor are told apart by it. Where it is equal, each window of the run repeats.
3. What remains shares an anchor with runs of other content. substring counts its windows, suffix sorts its suffixes.

Both counts are partial before their shuffles, and joins on them have a side that is unique by key, so a key of very many
runs is never gathered: it is split by adaptive execution. Within an Arrow batch, runs of one content are sent once.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C
from pixelloom.llm._common import U64

_PLACE = U64((1 << 20) - 1)
_PIECE = 1 << 20


def units_of(unit: str, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit hashes, what tells units apart by other means, first unit of each document) of a slice of documents: bytes are told
    apart by themselves, words by a second hash of their bytes."""
    if unit == "byte":
        return C.byte_units(data), data, bounds
    starts, ends, first = C.word_spans(data, bounds)
    return C.word_units(data, starts, ends), C.word_units(data, starts, ends, 1), first


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _runs(units: np.ndarray, others: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, content digest, document, first start, number of starts) of every run; starts count from the document's first unit."""
    empty = tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "i8", "i8"))
    if len(units) < window:
        return empty
    pre = C.prefix(units)
    at = np.arange(len(units) - gram + 1)
    keys = C.span_hash(pre, at, at + gram)
    ends = np.repeat(first[1:], np.diff(first))
    out = []
    for lo in range(0, max(1, len(keys) - (window - gram)), _PIECE - window):
        part = keys[lo : lo + _PIECE]
        if len(part) < window - gram + 1:
            break
        least = _sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=U64), window - gram + 1)
        least = least[: _PIECE - window]
        start = np.arange(lo, lo + len(least))
        fits = start + window <= ends[start]
        turn = np.empty(len(least), bool)
        turn[:1] = True
        turn[1:] = (least[1:] != least[:-1]) | (fits[1:] != fits[:-1]) | (ends[start[1:]] != ends[start[:-1]])
        begins = np.flatnonzero(turn)
        stops = np.append(begins[1:], len(least))
        keep = fits[begins]
        begins, stops = begins[keep], stops[keep]
        out.append((part[(least[begins] & _PLACE).astype(np.int64)], begins + lo, stops - begins))
    if not out:
        return empty
    h, j0, n = (np.concatenate(x) for x in zip(*out, strict=True))
    doc = np.searchsorted(first, j0, "right") - 1
    return h, C.digests(others, j0, j0 + n - 1 + window), doc, j0 - first[doc], n


RUNS = "h long, c long, rid long, j0 int, n int, times int"


def _runs_out(h: np.ndarray, c: np.ndarray, rid: np.ndarray, j0: np.ndarray, n: np.ndarray, weight: np.ndarray | None = None, keys: bool = False) -> pa.RecordBatch:
    """RUNS of a batch: the first of each content says how often (1, or 2 for more) the batch holds it; the others, which are
    thereby known to repeat, have 0, and no key unless keys are asked for."""
    order = np.lexsort((c, h))
    lead = np.ones(len(h), bool)
    lead[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    content = np.cumsum(lead) - 1
    times, first = np.empty(len(h), np.int32), np.empty(len(h), bool)
    first[order] = lead
    times[order] = np.minimum(np.bincount(content, None if weight is None else weight[order])[content], 2) * lead
    hide = None if keys else ~first
    cols = [pa.array(h.view(np.int64), mask=hide), pa.array(c.view(np.int64), mask=hide), *map(pa.array, (rid, j0.astype(np.int32), n.astype(np.int32), times))]
    return pa.RecordBatch.from_arrays(cols, ["h", "c", "rid", "j0", "n", "times"])


def _scan(unit: str, window: int, gram: int, keys: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for a, b in C.slices(off):
                units, others, first = units_of(unit, data[off[a] : off[b]], off[a : b + 1] - off[a])
                h, c, doc, j0, n = _runs(units, others, first, window, gram)
                found.append((h, c, rid[a:b][doc], j0, n))
            if found:
                yield _runs_out(*(np.concatenate(x) for x in zip(*found, strict=True)), keys=keys)

    return run


def _again(unit: str, window: int, gram: int, keys: bool) -> Callable:
    """Runs with longer anchors, of the windows of given runs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "i8", "i8", "i8"))]
            for rid, units, others, runs in with_units(unit, batch):
                begin, weight = (np.array([r[k] for r in runs], np.int64) for k in ("j0", "weight"))
                one, two = ([x[r["j0"] : r["j0"] + r["n"] - 1 + window] for r in runs] for x in (units, others))
                h, c, part, j0, n = _runs(np.concatenate(one), np.concatenate(two), np.append(0, np.cumsum([len(p) for p in one])), window, gram)
                found.append((h, c, np.full(len(h), rid, np.int64), j0 + begin[part], n, weight[part]))
            yield _runs_out(*(np.concatenate(x) for x in zip(*found, strict=True)), keys=keys)

    return run


def with_units(unit: str, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[dict]]]:
    """(rid, unit hashes, what else tells units apart, runs) of a batch (rid, text, runs: array of structs)."""
    data, off = C.utf8_parts(batch.column(1))
    for i, (rid, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
        part = data[off[i] : off[i + 1]]
        yield rid, *units_of(unit, part, np.array([0, len(part)]))[:2], runs.as_py()


def _repeating(runs: DataFrame) -> DataFrame:
    """RUNS, as a table, without those whose anchor occurs once. Most end here, before any shuffle of more than their anchors
    and one of their own; the table of all of them is deleted."""
    spark, path = runs.sparkSession, C.scratch_path(runs.sparkSession, "scan")
    runs.write.parquet(path)
    runs = spark.read.schema(RUNS).parquet(path)
    again = runs.where("times > 0").groupBy("h").agg(F.sum("times").alias("all")).where("all > 1").select("h")
    # rows without a key repeat one of their batch
    kept = C.written(runs.where("h is not null").join(again.hint("merge"), "h", "left_semi").unionByName(runs.where("h is null")), "runs")
    C.dropped(spark, path)
    return kept


def scanned(keyed: DataFrame, unit: str, window: int, gram: int, keys: bool = False) -> DataFrame:
    """RUNS of keyed (rid, text) whose anchor occurs again, as a table."""
    return _repeating(keyed.select("rid", "text").mapInArrow(_scan(unit, window, gram, keys), RUNS))


def anchored_again(keyed: DataFrame, runs: DataFrame, unit: str, window: int, gram: int, keys: bool = False) -> DataFrame:
    """RUNS, as a table, of the windows of runs (rid, j0, n, weight) by other anchors, where these occur again."""
    return _repeating(with_text(keyed, runs).mapInArrow(_again(unit, window, gram, keys), RUNS))


def counted(runs: DataFrame) -> DataFrame:
    """(h, c, times, rep, different) of the contents of runs whose anchors occur again, as a table: how often the content
    occurs, one of its runs (rid, j0, n), and how many contents the anchor has."""
    contents = runs.where("times > 0").groupBy("h", "c").agg(F.sum("times").alias("times"), F.min(F.struct("rid", "j0", "n")).alias("rep"))
    anchors = contents.groupBy("h").agg(F.count("*").alias("different"))
    return C.written(contents.join(anchors, "h"), "contents")


def whole_spans(runs: DataFrame, contents: DataFrame, window: int) -> DataFrame:
    """(rid, s, e) of the runs whose content repeats."""
    again = contents.where("times > 1").select("h", "c")
    members = runs.where("times > 0").join(again.hint("merge"), ["h", "c"], "left_semi").unionByName(runs.where("times = 0"))
    return members.select("rid", F.col("j0").cast("long").alias("s"), (F.col("j0") + F.col("n") - 1 + window).cast("long").alias("e"))


def unclear(contents: DataFrame, all_repeated: bool = False) -> DataFrame:
    """(rid, j0, n, weight, h, c, different) of one run of each content whose anchor has others too, or of all contents that
    repeat as well. weight: 1 for a content that occurs once, else 2: its windows are known to repeat and only meet those
    of the others."""
    rows = contents.where("different > 1 or times > 1" if all_repeated else "different > 1")
    return rows.select("rep.rid", "rep.j0", "rep.n", F.least("times", F.lit(2)).cast("int").alias("weight"), "h", "c", "different")


def with_text(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """(rid, text, runs: array of the other columns) of the documents that have runs; a document's runs are bounded by it."""
    others = [c for c in runs.columns if c != "rid"]
    per = runs.groupBy("rid").agg(F.collect_list(F.struct(*others)).alias("runs"))
    return keyed.select("rid", "text").join(per.hint("merge"), "rid").select("rid", "text", "runs")


def with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed with its ranges as arrays s and e (null where none)."""
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return keyed.join(per, "rid", "left").select(*keyed.columns, F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))


def list_parts(column: pa.ListArray, i: int) -> np.ndarray:
    return np.asarray(column[i].values, np.int64) if column[i].is_valid else np.zeros(0, np.int64)
