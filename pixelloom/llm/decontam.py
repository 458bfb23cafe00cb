"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` words of every benchmark item, and a shorter item as a whole. A table over blocks of
two words says how far the search may jump; where it says zero, the bucket of that block holds the windows that end their
first words with it, and the words themselves are compared. Items shorter than `window` have a machine of their own, so
that they don't shorten the jumps of the others.

Words are lower-cased in A-Z and consist of digits, a-z and everything outside ASCII. Null texts have no words and contain
nothing. Items that repeat an id count once; a null id is written as an empty string. An empty benchmark hits nothing.
Extra columns are ignored; repeated documents give repeated results. The benchmark is read in parts of about PART_BYTES,
each broadcast and searched for in turn within one pass over the documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

#: Benchmark text that is broadcast at once; its size is checked before.
PART_BYTES = 2 << 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Machine:
    """Shift and bucket tables for windows (item, place) of one or several lengths."""

    def __init__(self, items: list[list[bytes]], windows: list[tuple[int, int, int]]):
        """windows: (item, first word, number of words)."""
        self.items = items
        self.m = min(n for _, _, n in windows)
        self.block = min(2, self.m)
        self.jump = self.m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for item, at, n in windows:
            w = items[item]
            for i in range(self.jump):
                key, far = self._key(w, at + i + self.block - 1), self.m - self.block - i
                if far < self.shift.get(key, self.jump):
                    self.shift[key] = far
            self.bucket.setdefault(self._key(w, at + self.m - 1), []).append((item, at, n))

    def _key(self, w: list[bytes], last: int):
        return (w[last - 1], w[last]) if self.block == 2 else w[last]

    def search(self, w: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of every occurrence."""
        m, jump, shift, bucket, items = self.m, self.jump, self.shift, self.bucket, self.items
        i, n, pairs = m - 1, len(w), self.block == 2
        while i < n:
            key = (w[i - 1], w[i]) if pairs else w[i]
            far = shift.get(key, jump)
            if far:
                i += far
                continue
            start = i - m + 1
            for item, at, size in bucket[key]:
                if w[start : start + size] == items[item][at : at + size]:
                    yield item, start, start + size
            i += 1


def machines(texts: list[bytes], window: int) -> list[Machine]:
    items = [words(t) for t in texts]
    long = [(k, i, window) for k, w in enumerate(items) for i in range(len(w) - window + 1)]
    short = [(k, 0, len(w)) for k, w in enumerate(items) if 0 < len(w) < window]
    return [Machine(items, x) for x in (long, short) if x]


def _search(shared, window: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        tables = machines(texts, window)
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            before = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            out: list[list] = [[] for _ in range(5 if last else 3)]
            for k in range(batch.num_rows):
                w = words(data[off[k] : off[k + 1]].tobytes())
                hits = [h for t in tables for h in t.search(w)]
                s = before[0][k] + [h[1] for h in hits]
                e = before[1][k] + [h[2] for h in hits]
                found = sorted({*before[2][k], *(ids[h[0]] for h in hits)})
                if last:
                    a, b = C.merged(np.array(s, np.int64), np.array(e, np.int64))
                    n_hit = int((b - a).sum())
                    row = (len(w), n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w))
                else:
                    row = (s, e, found)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            if last:
                cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            else:
                cols = [pa.array(c, t) for c, t in zip(out, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "text", "s", "e", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated (at least one word in twenty is hit)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    none = F.array().cast("array<bigint>")
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), none.alias("s"), none.alias("e"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast(([r.item for r in rows], [bytes(r.text) for r in rows]))
        last = part == parts - 1
        df = df.mapInArrow(_search(shared, window, last), "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else df.schema)
    return df.withColumnRenamed("id", id_col)
