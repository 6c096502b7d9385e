import base64
import hashlib
import io
import zlib

import pytest

from quillspark.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], "page_id long, url string, html string, payload string, offset long, same boolean")


ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "z", "long " * 50000), (None, "n", "only"), (7, "r", "twice"), (7, "r", "twice"), (8, "s", "\r\n\r\nWARC/1.1\r\n\r\n")]


def brute(rows, least=0):
    payloads = [(r[2] or "").encode() for r in rows]
    out = []
    for row, p in zip(rows, payloads, strict=True):
        keep = max((r[0] for r, q in zip(rows, payloads, strict=True) if q == p and r[0] is not None), default=None)
        revisit = len(p) >= least and row[0] != keep
        out.append((row[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip_of_awkward_pages(spark, least):
    got = warc.archive_round_trip(pages(spark, ROWS), least, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS, least)
    texts = {(r[2] or "").encode() for r in ROWS}
    assert {bytes(r.payload) for r in got if r.payload is not None} == texts


def test_query_over_whole_pages(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.op2_warc(spark, sf_dir).collect()), key=repr) == brute(rows)


def test_no_pages(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def archive():
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = b"".join(warc.record_bytes(i, "u", b"x" * i * 1000, None, False, i) for i in range(5))
    return squeeze.compress(data) + squeeze.flush()


def test_members_can_be_entered_at_their_offsets():
    out = io.BytesIO()
    index = list(warc.normalise_stream(io.BytesIO(archive()), out))
    data = out.getvalue()
    assert [r["page_id"] for r in index] == list(range(5)) and index[-1]["offset"] + index[-1]["length"] == len(data)
    for r in reversed(index):
        record = warc.parse_member(data[r["offset"] : r["offset"] + r["length"]])
        assert record["payload"] == b"x" * r["page_id"] * 1000
    # a file of many members is read like one stream
    assert len(list(warc.normalise_stream(io.BytesIO(data), io.BytesIO()))) == 5


def test_truncated_archives_raise():
    data = archive()
    with pytest.raises((EOFError, ValueError, zlib.error)):
        list(warc.normalise_stream(io.BytesIO(data[: len(data) // 2]), io.BytesIO()))


@pytest.mark.parametrize("mode", [zlib.Z_FULL_FLUSH, zlib.Z_FINISH])
def test_a_stream_that_ends_after_a_record_without_its_trailer_raises(mode):
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = squeeze.compress(warc.record_bytes(1, "u", b"x" * 1000, None, False, 1)) + squeeze.flush(mode)
    with pytest.raises(EOFError):
        list(warc.normalise_stream(io.BytesIO(data if mode == zlib.Z_FULL_FLUSH else data[:-5]), io.BytesIO()))


def test_revisits_name_what_they_revisit():
    head = warc.parse_fields(warc.record_bytes(1, "u", b"p", 9, True, 1, "http://nine/", "2020-01-02T03:04:05Z").partition(warc.END)[0])
    assert head["warc-refers-to-target-uri"] == "http://nine/" and head["warc-refers-to-date"] == head["warc-date"] == "2020-01-02T03:04:05Z"
    info = warc.parse_fields(warc.info_bytes("a.warc.gz").partition(warc.END)[0])
    assert info["warc-type"] == "warcinfo" and info["warc-filename"] == "a.warc.gz"


def test_damage_is_noticed():
    record = warc.record_bytes(1, "u", b"payload", None, False, 1).replace(b"payload\r\n", b"pAyload\r\n")
    with pytest.raises(ValueError):
        warc.parse_member(zlib.compress(record, wbits=31))
