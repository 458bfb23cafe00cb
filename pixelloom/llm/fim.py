"""Fill-in-middle: documents with a span moved behind what follows it, marked by sentinels.

A text is a sequence of units, runs of ASCII letters or single other characters. One `regex` fullmatch of (unit)* keeps every
repetition of its group, so that `m.ends(1)` holds the end of each unit: its length is n, and both cuts are read from it. The
two cuts, whether a document is transformed and which form it takes are drawn from the SHA-256 of seed and id, so that they
depend on nothing else: not on partitions, order or other rows. Rows are independent; nothing is shuffled or collected. A task
holds the text and the unit ends of one document at a time, about 40 bytes a unit, and the texts of one Arrow batch.

Defined results: a null text is empty, and an empty text stays plain with n = 0. A text that holds a sentinel stays plain, as
its output could not be read back. A null id is drawn as an empty one. Repeated rows give the same result each. An empty table
gives an empty one. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters that go through Python at once; a longer document goes alone.
BATCH_CHARS = 1 << 24


def unit_ends(text: str) -> list[int]:
    """The end of each unit of text, in order."""
    return UNITS.fullmatch(text).ends(1)


def draws(seed: int, key: str) -> tuple[int, ...]:
    """Four numbers below 2^32 that depend on seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def cut(text: str, key: str, seed: int = 1, plain: int = 90, spm: int = 20) -> tuple[int, str, int, int]:
    """(n, form, end of prefix, end of middle), ends in code points. plain: the least h3 % 100 that stays plain; spm: h4 % 100
    below it gives suffix-prefix-middle."""
    h1, h2, h3, h4 = draws(seed, key)
    ends = unit_ends(text)
    n = len(ends)
    low, high = (ends[i - 1] if i else 0 for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= plain:
        return n, "plain", low, high
    return n, "spm" if h4 % 100 < spm else "psm", low, high


def arranged(text: str, form: str, low: int, high: int) -> str:
    if form == "plain":
        return text
    p, s, m = SENTINELS
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that was arranged. A sentinel cannot begin before its place: texts hold none, and '<' is only their start."""
    if form == "plain":
        return output
    first, second, last = (SENTINELS[i] for i in ((0, 1, 2) if form == "psm" else (1, 0, 2)))
    head, _, rest = output.removeprefix(first).partition(second)
    other, _, middle = rest.partition(last)
    return head + middle + other if form == "psm" else other + middle + head


def _sized(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about BATCH_CHARS bytes of text, or one row."""
    for batch in batches:
        at = 0
        while at < len(batch):
            take = max(1, min(len(batch) - at, int((len(batch) - at) * BATCH_CHARS / max(1, batch.column(text).slice(at).nbytes))))
            yield batch.slice(at, take)
            at += take


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every document with its middle moved last, or plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches, 1):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, form, low, high = cut(text, "" if key is None else str(key), seed, plain, spm)
                sizes = (None, None) if form == "plain" else (low, high - low)
                rows.append((n, form, *sizes, arranged(text, form, low, high)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)

    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """made with `restored`: the text, rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("form"), names.index("output")
        for batch in _sized(batches, at[1]):
            texts = [rebuilt(o, f) for f, o in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    names = made.columns
    return made.mapInArrow(run, made.withColumn("restored", F.lit("").cast("string")).schema)
