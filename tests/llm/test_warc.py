import gzip
import hashlib

import pytest

from pixelloom.llm import _common as C
from pixelloom.llm import warc

LONG = "é" * 60
ROWS = [(5, "http://a/x y", LONG), (3, None, LONG), (9, "http://b", "short"), (8, "http://b", "short"), (1, "u\r\nX: y", None), (2, "", ""), (7, "http://c", "z" * 100), (7, "http://c", "z" * 100), (11, "q", "z" * 100), (None, "n", LONG), (12, "w", "z" * 99)]


@pytest.mark.parametrize("level", [0, 1])
def test_round_trip(spark, level):
    pages = spark.createDataFrame([(p, u, h, "x") for p, u, h in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    folder = C.scratch_path(spark, "warc")
    index = warc.write_archives(pages, folder, level=level)
    rows = index.collect()
    assert len(rows) == len(ROWS)
    for r in rows:  # the index alone finds each record
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            raw = f.read(r.length)
        got = warc.parse(raw)
        raw = gzip.decompress(raw) if level else raw
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert (got[0], got[2], got[5]) == (r.page_id, r.record_type, r.digest)
    for gap, span in ((warc.GAP, warc.SPAN), (0, 300), (0, 0)):
        got = [tuple(r) for r in warc.resolved(warc.read_records(index, folder, gap, span)).collect()]
        want = []
        for p, _, h in ROWS:
            b = (h or "").encode()
            same = [q for q, _, x in ROWS if (x or "").encode() == b and q is not None]
            head = min(same) if len(b) >= 100 else None
            revisit = head is not None and p != head
            want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
        assert sorted(got, key=str) == sorted(want, key=str)
    one = warc.read_records(index.where("url = 'http://c'"), folder).collect()
    assert [bytes(r.payload) for r in one] == [b"z" * 100] * 2
    assert all("\n" not in (r.url or "") for r in warc.read_records(index, folder).collect())


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = C.scratch_path(spark, "warc")
    assert warc.resolved(warc.read_records(warc.write_archives(pages, folder), folder)).count() == 0
