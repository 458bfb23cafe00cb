"""Substring deduplication over bytes with a common-prefix interval tree.

Passages whose content-chosen anchor occurs more than once in the corpus (see _repeats) are dealt out by anchor, so that all
suffixes with a common prefix of `window` bytes meet, whichever passages they stand in. There an enhanced suffix array is
built over them: suffixes in order, and the common prefix of each with the one before, in bytes. One scan with a stack
yields every interval of suffixes with a common prefix of at least `window` bytes; an interval whose members are preceded by
different bytes is a maximal repeat, and all its members are its occurrences. Passages that are equal as a whole are one
weighted entry of the array. An anchor with more than GROUP different passages is dealt out by anchors of twice the length
instead, again and again up to `window` bytes, so that no array has more entries at any size of the corpus.

repeat_groups gives the groups with all their occurrences; dedup_byte_strings removes their union. A passage ends where its
anchor does, so a longer repeat is several groups that overlap.

Bytes are UTF-8; a null text is empty; matches stay inside one row; repeated rows are separate documents. Extra columns
are ignored. An empty table gives an empty result. Removing bytes can cut a character, so the kept part is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C
from pixelloom.llm import _repeats as R

GRAM = 40
#: Different passages of one anchor that one suffix array takes.
GROUP = 2048
#: Bytes of passages that one suffix array takes, more only if a single anchor has more.
CHUNK_BYTES = 1 << 19


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes of text in order, each ending where ends says; a suffix sorts before what it begins.

    Prefix doubling from eight bytes; only classes of equal prefixes are sorted again.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | np.where(at + i < ends, padded[i : n + i], np.uint64(0))
    order = np.argsort(key, kind="stable")
    key = key[order]
    short = np.minimum(ends - at, 8)  # zero bytes and the end look alike in key
    if (text == 0).any():
        order = order[np.lexsort((short[order], key))]
    lead = np.ones(n, bool)
    lead[1:] = (key[1:] != key[:-1]) | (short[order][1:] != short[order][:-1])
    place = np.maximum.accumulate(np.where(lead, at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    slots = np.flatnonzero(~(lead & np.append(lead[1:], True)))
    step = 8
    longest = int((ends - at).max()) if n else 0
    while len(slots) and step < longest:
        own = order[slots]
        nxt = own + step
        second = np.where(nxt < ends[own], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[own] << 32 | second
        by = np.argsort(key, kind="stable")
        key, own = key[by], own[by]
        order[slots] = own
        lead = np.ones(len(slots), bool)
        lead[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(lead, slots, 0))
        alone = lead & np.append(lead[1:], True)
        slots = slots[~alone]
        step *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix, in bytes, of each suffix with the one before it in order.

    Only pairs of suffixes that different bytes precede are compared byte by byte; where the bytes before are equal, the
    prefix is one shorter than that of the suffixes a place to the left.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = ends[1:] != ends[:-1]
    other = np.maximum(before, 0)
    carried = (before >= 0) & ~first & ~first[other] & (text[at - 1] == text[other - 1])
    compare = np.flatnonzero((before >= 0) & ~carried)
    most = np.minimum(ends[compare] - compare, ends[before[compare]] - before[compare])
    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : n + k]
    same, live = np.zeros(len(compare), np.int64), np.arange(len(compare))
    while len(live):
        x, y = compare[live] + same[live], before[compare[live]] + same[live]
        differ = words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)]
        full = (differ == 0) & (same[live] + 8 < most[live])
        rest, part = live[~full], differ[~full]
        equal = np.full(len(rest), 8)
        for k in range(8):  # the first byte that differs, from the left
            equal = np.minimum(equal, np.where((part >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0, k, 8))
        same[rest] = np.minimum(same[rest] + equal, most[rest])
        live = live[full]
        same[live] += 8
    prefix = np.zeros(n, np.int64)
    prefix[compare] = same
    known = np.maximum.accumulate(np.where(carried, 0, at))
    prefix = np.where(before >= 0, prefix[known] - (at - known), 0)
    out[1:] = prefix[order[1:]]
    return out


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) places in order of every maximal repeat of at least `least` units.

    before: for each suffix the unit left of it, or a number of its own where nothing shared can stand there. One pass
    with a stack over the common prefixes; an interval is kept if the units left of its members differ.
    """
    out: list[tuple[int, int, int]] = []
    live = np.flatnonzero((lcp >= least) | np.append(lcp[1:] >= least, False))
    if not len(live):
        return out
    left = before[order[live]].tolist()
    depth = lcp[live].tolist()
    where = live.tolist()
    stack: list[list[int]] = []  # [length, first place, least left unit, greatest left unit]
    for i, place in enumerate(where):
        d = depth[i] if i and where[i - 1] == place - 1 else 0
        first, lo, hi = place, left[i], left[i]
        if d < least:
            d = 0
        last = where[i - 1] if i else place
        carried = None
        while stack and stack[-1][0] > d:
            length, start, a, b = stack.pop()
            if carried:
                a, b = min(a, carried[0]), max(b, carried[1])
            if a != b:
                out.append((length, start, last))
            carried = (a, b)
            begin = start
            if not stack or stack[-1][0] <= d:
                if d and (not stack or stack[-1][0] < d):
                    stack.append([d, begin, a, b])
                elif stack:
                    stack[-1][2], stack[-1][3] = min(stack[-1][2], a), max(stack[-1][3], b)
                break
        if d:
            if not stack or stack[-1][0] < d:
                prev = left[i - 1]
                stack.append([d, place - 1, min(prev, lo), max(prev, hi)])
            else:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], lo), max(stack[-1][3], hi)
    carried = None
    while stack:
        length, start, a, b = stack.pop()
        if carried:
            a, b = min(a, carried[0]), max(b, carried[1])
        if a != b:
            out.append((length, start, where[-1]))
        carried = (a, b)
    return out


def passage_repeats(text: np.ndarray, off: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(length, starts) of the maximal repeats of the passages text[off[i]:off[i+1]], with all occurrences."""
    ends = np.repeat(off[1:], np.diff(off))
    order = suffix_array(text, ends)
    lcp = common_prefixes(text, order, ends)
    before = np.empty(len(text), np.int64)
    before[1:] = text[:-1]
    begin = off[:-1][np.diff(off) > 0]
    before[begin] = 256 + np.arange(len(begin))  # what stands left of a passage belongs to another passage
    return [(length, np.sort(order[a : b + 1])) for length, a, b in maximal_repeats(order, lcp, before, least)]


# ---------------------------------------------------------------- Spark
PASSAGES = "h long, rid long, j0 int, weight int, c long, payload binary"


def _passages(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for rid, _, text, runs in R.with_units("byte", batch):
                for r in runs:
                    for col, v in zip(cols, (r["h"], rid, r["j0"], r["weight"], r["c"], text[r["j0"] : r["j0"] + r["n"] - 1 + window].tobytes()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["h", "rid", "j0", "weight", "c", "payload"])

    return run


def _arrays(window: int, groups: bool):
    """The maximal repeats of whole anchors: with groups, each one's occurrences in the passages; else what they cover."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        if groups:  # a passage that repeats as a whole stands twice, so that the array has an interval for it
            rows = [r for r in rows for _ in range(r[3])]
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        off = np.append(0, np.cumsum([len(r[5]) for r in rows]))
        found = passage_repeats(text, off, window)
        at = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
        length = np.repeat(np.array([n for n, _ in found], np.int64), [len(x) for _, x in found])
        row = np.searchsorted(off, at, "right") - 1
        if groups:
            heads = np.array([x[0] for _, x in found], np.int64)
            key = np.repeat(C.digests(text, heads, heads + np.array([n for n, _ in found], np.int64)), [len(x) for _, x in found]).view(np.int64)
            h, c = (np.array([r[k] for r in rows], np.int64)[row] for k in (0, 4))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, length, h, c, at - off[row])], ["repeat", "length", "h", "c", "at"])
        out = [(np.zeros(0, np.int64),) * 3]
        by = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[by], np.arange(len(rows) + 1))
        for k, r in enumerate(rows):
            mine = by[cuts[k] : cuts[k + 1]]
            if r[3] == 1 and len(mine):
                s, e = C.merged(at[mine], at[mine] + length[mine])
                out.append((np.full(len(s), r[1], np.int64), s - off[k] + r[2], e - off[k] + r[2]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rid", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if r[0] != last and size >= CHUNK_BYTES:
                    yield settle(rows)
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[5])
        if rows:
            yield settle(rows)

    return run


def _levels(keyed: DataFrame, window: int, group: int, groups: bool) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """(runs, contents, what the suffix arrays give) for each length of anchors; all but the first only if an anchor is hot."""
    gram = min(GRAM, window)
    runs = R.scanned(keyed, "byte", window, gram, keys=groups)
    while True:
        contents = R.counted(runs)
        unclear = R.unclear(contents, all_repeated=groups)
        last = gram == window
        rows = R.with_text(keyed, unclear if last else unclear.where(F.col("different") <= group)).mapInArrow(_passages(window), PASSAGES)
        rows = rows.repartition(C.partitions(keyed.sparkSession), "h").sortWithinPartitions("h")
        yield runs, contents, rows.mapInArrow(_arrays(window, groups), "repeat long, length long, h long, c long, at long" if groups else "rid long, s long, e long")
        hot = unclear.where(F.col("different") > group)
        if last or not hot.limit(1).count():
            return
        if groups:  # every occurrence, not one of each content
            hot = runs.join(hot.select("h", "c"), ["h", "c"], "left_semi").select("rid", "j0", "n", F.lit(1).alias("weight"))
        gram = min(2 * gram, window)
        runs = R.anchored_again(keyed, hot, "byte", window, gram, keys=groups)


def repeated_byte_spans(keyed: DataFrame, window: int = 200, group: int = GROUP) -> DataFrame:
    """(rid, s, e): byte ranges covered by strings of window bytes that occur again."""
    parts = [x for runs, contents, found in _levels(keyed, window, group, False) for x in (R.whole_spans(runs, contents, window), found)]
    return reduce(DataFrame.unionByName, parts)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, group: int = GROUP) -> DataFrame:
    """(repeat, length, id, start): the maximal repeats of at least window bytes with all their occurrences; see the module."""
    keyed = C.with_row_key(docs, id_col, text_col).select("rid", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = []
    for runs, _, found in _levels(keyed, window, group, True):
        members = found.join(runs.select("h", "c", "rid", "j0"), ["h", "c"])
        parts.append(members.select("repeat", "length", "rid", (F.col("j0") + F.col("at")).alias("start")))
    out = reduce(DataFrame.unionByName, parts).distinct()
    return out.join(keyed.select("rid", "id"), "rid").select("repeat", "length", F.col("id").alias(id_col), "start")


def _kept(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                part = data[off[i] : off[i + 1]]
                s, e = C.merged(R.list_parts(batch.column(2), i), R.list_parts(batch.column(3), i))
                kept = part
                if len(s):
                    keep = np.ones(len(part), bool)
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        keep[a:b] = False
                    kept = part[keep]
                kept = kept.tobytes()
                rows.append((len(part), len(part) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return run


def dedup_byte_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, with_bytes: bool = True, group: int = GROUP) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    keyed = C.with_row_key(docs, id_col, text_col).select("rid", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = R.with_spans(keyed, repeated_byte_spans(keyed, window, group)).select("id", "text", "s", "e")
    out = out.mapInArrow(_kept(with_bytes), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return out if with_bytes else out.drop("kept")
