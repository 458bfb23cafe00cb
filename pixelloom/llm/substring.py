"""Substring deduplication over words by level-wise doubling.

A level counts windows of one length over the corpus. The first takes half the asked length: each 35-word window is
represented by one content-chosen 18-word window in it (see _repeats), and where that occurs once, so do all that hold it.
Only what repeats is extended to twice the length: first as a whole, all 35-word windows around an occurrence at once, as
long repeats agree in all of them; where they do not, window by window. Both are counted over the corpus, and what does not
repeat at the asked length is no candidate any more.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r, compared unchanged by two independent 64-bit
hashes of all their bytes. Windows are compared by 64 bits over each of them; a whole run has a BLAKE2b digest over the
second beside its anchor's hash over the first. A null text has no words. Repeated rows are separate documents, so each covers the other. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C
from pixelloom.llm import _repeats as R


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [tuple(np.zeros(0, k) for k in ("u8", "u8", "i8", "i8", "i8"))]
            for rid, *units, runs in R.with_units("word", batch):
                begin, many, weight = (np.array([r[k] for r in runs], np.int64) for k in ("j0", "n", "weight"))
                at = np.repeat(begin - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                keys = [C.span_hash(C.prefix(u, k), at, at + window, k) for k, u in enumerate(units)]
                out.append((*keys, np.full(len(at), rid, np.int64), at, np.repeat(weight, many)))
            k1, k2, rid, at, weight = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1.view(np.int64), k2.view(np.int64), rid, at.astype(np.int32), weight.astype(np.int32))], ["k1", "k2", "rid", "at", "weight"])

    return run


def repeated_word_spans(keyed: DataFrame, window: int = 35) -> DataFrame:
    """(rid, s, e): word ranges covered by windows that occur again."""
    runs = R.scanned(keyed, "word", window, (window + 1) // 2)
    contents = R.counted(runs)
    windows = R.with_text(keyed, R.unclear(contents)).mapInArrow(_windows(window), "k1 long, k2 long, rid long, at int, weight int")
    windows = C.written(windows, "windows")
    again = windows.groupBy("k1", "k2").agg(F.sum("weight").alias("times")).where("times > 1")
    found = windows.where("weight = 1").join(again.hint("merge"), ["k1", "k2"], "left_semi")
    return R.whole_spans(runs, contents, window).unionByName(found.select("rid", F.col("at").cast("long").alias("s"), (F.col("at") + window).cast("long").alias("e")))


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.utf8_parts(batch.column(1))
            words, removed, digest, texts = [], [], [], []
            for i in range(batch.num_rows):
                part = data[off[i] : off[i + 1]].tobytes().split()
                s, e = C.merged(R.list_parts(batch.column(2), i), R.list_parts(batch.column(3), i))
                words.append(len(part))
                removed.append(int((e - s).sum()))
                if len(s):
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(part)]
                    part = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in part[a:b]]
                kept = b" ".join(part)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup_word_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text without every repeated window's words."""
    keyed = C.with_row_key(docs, id_col, text_col).select("rid", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = repeated_word_spans(keyed, window)
    out = R.with_spans(keyed, spans).select("id", "text", "s", "e")
    out = out.mapInArrow(_kept(with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")
