"""Best-fit packing from a histogram of lengths.

Documents are tokenized once, into pieces of at most `size` tokens; only (id, piece, start, length, checksum) is kept. The
plan is made from the histogram of lengths, at most `size` rows whatever the corpus: best fit, longest first, places all
pieces of one length at once, in ranges of equal sequences. A piece then finds its place by joining the plan on its length
and its rank among the pieces of that length. Ranks are counted within (length, salt) and shifted by the counts of smaller
salts, so that a length that very many pieces share is ranked by many tasks.

A document is its ids and one end id. Longer ones are cut: the first piece takes what is left over, the others are full.
A null text is empty and holds the end id alone; repeated rows are packed as often as they stand there; extra columns are
ignored; an empty table gives an empty result. A special token's string in a text has the id that the tokenizer gives it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

#: Pieces of words, as the byte-level tokenizer splits them (fixed by its vocabulary).
_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters outside of which the tokenizer itself splits the text, as it does where an added token stands.
_OTHER = regex.compile(r"[^\t\n\r -~¡-¬®-ɏ‐-‧‰-⁞€]")
#: Pieces that a worker remembers, about 200 bytes each.
_KNOWN_PIECES = 500_000


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the
    others in order from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_ALPHABET = _byte_alphabet()


class _Known(dict):
    """Little-endian ids of each piece of text met so far; starts again when it gets large."""

    def __init__(self, tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _KNOWN_PIECES:
            self.clear()
        tokens = self.merge(piece.encode().decode("latin-1").translate(_ALPHABET))
        out = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.known = tokenizer, _Known(tokenizer)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole = regex.compile("|".join([_OTHER.pattern, *map(regex.escape, added)]))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. A piece of a text has the ids it has alone."""
        if self.whole.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        return b"".join(map(self.known.__getitem__, _PIECES.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def _pieces(path: str, size: int, end: int):
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                for k, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    for c, v in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number, first sequence, pieces in each sequence, offset) of the best fit, longest first.

    Equal pieces go on into the sequence that just took one while it has room, as best fit would have it, so that each
    step fills whole ranges of equally full sequences.
    """
    out, room, next_seq = [], {}, 0  # room: what is left -> ranges (first sequence, number)
    order: list[int] = []

    def give(left: int, first: int, number: int) -> None:
        if left > 0 and number > 0:
            if left not in room:
                bisect.insort(order, left)
            room.setdefault(left, []).append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                left = order[i]
                first, number = room[left].pop()
                if not room[left]:
                    del room[left], order[i]
            else:
                left, first = size, next_seq
                number = -(-todo // (size // length))
                next_seq += number
            each = left // length
            full = min(number, todo // each)
            if full:
                out.append((length, rank, full * each, first, each, size - left))
                give(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if todo and full < number:  # fewer than fill a sequence
                out.append((length, rank, todo, first + full, todo, size - left))
                give(left - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            give(left, first + full, number - full)
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = C.written(source.mapInArrow(_pieces(tokenizer_path, size, end_id), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    salts = max(16, C.partitions(spark))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = C.written(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    steps = spark.createDataFrame(plan(histogram, size), "length long, first long, number long, sequence long, each long, place long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    shifts = counts.select("length", "salt", before.alias("shift")).hint("merge")  # meets the ranks where they are; grows with salts
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(shifts, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("shift"))
    # steps has a few rows for each length, and no more than size lengths
    placed = ranked.join(F.broadcast(steps), "length").where("rank >= first and rank < first + number")
    nth = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + nth % F.col("each") * F.col("length")).cast("long").alias("offset")
    )
