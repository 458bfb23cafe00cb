"""WARC archives with an index.

Writing. Each task writes one archive into the shared folder and returns an index row for every record: file, offset,
length, URL, digest. Only the rows of tasks that succeeded reach the index, so an archive that a lost executor left
half-written is never referred to. Records with equal payloads of at least `least` bytes are one response, that of the
smallest page id, and revisits of it.

Reading goes by the index alone. The selected rows are dealt out by (file, offset) and sorted; neighbouring ranges, with
gaps of at most GAP bytes, are read at once, up to SPAN bytes, and the records are cut out of what was read.

Records are gzip members of their own, as is usual for WARC, so that each can be read alone; `level` 0 leaves them plain.

A null html is an empty payload; a null URL has no target header; control characters in a URL are percent-encoded. A
null page id is larger than any other. Rows that repeat a page id and its payload are responses alike. Extra columns are
ignored; empty tables give an empty index. Archives lie in a store that pyarrow.fs can open from the folder's URI.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

GAP, SPAN = 64 << 10, 4 << 20
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORDS = "page_id long, url string, record_type string, record_id string, refers_to_id string, header_digest string, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, original: int | None, date: str) -> bytes:
    """One WARC record; original: the page that a revisit refers to, itself without payload."""
    revisit = original is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(original))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, url, record_type, record_id, refers_to_id, header_digest, payload) of one record; a revisit has no payload."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record here: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    kind = fields["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    page = fields.get("x-page-id")
    return int(page) if page else None, fields.get("warc-target-uri"), kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-payload-digest"].removeprefix("sha256:"), payload


def _write(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, at = None, 0
        name = f"{root}/part-{uuid.uuid4().hex}.warc{'.gz' if level else ''}"
        try:
            for batch in batches:
                rows = []
                for page, url, digest, payload, original in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    raw = record(page, url, digest, payload, original, date)
                    raw = gzip.compress(raw, level, mtime=0) if level else raw
                    out.write(raw)
                    rows.append((name, at, len(raw), url, digest, "response" if original is None else "revisit", page))
                    at += len(raw)
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write the pages as WARC files below folder and return their index, a Parquet table beside them."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("head"))
    original = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    marked = rows.join(heads, "digest", "left").select("page_id", "url", "digest", "payload", original.alias("original"))
    index = marked.mapInArrow(_write(f"{folder}/archives", date, level), INDEX)
    index.write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read(folder: str, gap: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        opened: list = [None, None]

        def cut(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            name, start = rows[0][0], rows[0][1]
            if opened[0] != name:
                if opened[1] is not None:
                    opened[1].close()
                opened[:] = [name, store.open_input_file(name)]
            raw = opened[1].read_at(max(o + n for _, o, n in rows) - start, start)
            got = [parse(raw[o - start : o - start + n]) for _, o, n in rows]
            kinds = (pa.int64(), *[pa.string()] * 5, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

        rows: list[tuple[str, int, int]] = []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if rows and (r[0] != rows[0][0] or r[1] - (rows[-1][1] + rows[-1][2]) > gap or r[1] + r[2] - rows[0][1] > span):
                    yield cut(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield cut(rows)
        if opened[1] is not None:
            opened[1].close()

    return run


def read_records(index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records of the selected index rows, by coalesced byte-range reads."""
    spark = index.sparkSession
    places = index.select("file", "offset", "length").repartitionByRange(C.partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(_read(folder, gap, span), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): both of the full payload, which a revisit takes from the response it refers to."""
    records = records.select("page_id", "record_type", "record_id", "refers_to_id", "header_digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    records = C.written(records, "records")
    responses = records.where("record_type = 'response'")
    target = responses.groupBy(F.col("record_id").alias("refers_to_id"), F.col("digest").alias("header_digest")).agg(F.first("bytes").alias("full"), F.first("page_id").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").drop("bytes").join(target, ["refers_to_id", "header_digest"], "left")
    first = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(revisits.select("page_id", F.col("full").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", "refers_to"))
