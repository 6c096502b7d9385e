"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

``write_archives`` writes each partition as files that are one gzip stream each, the form in which archives often come
and which can't be entered in the middle. ``normalise`` inflates such a stream once, from its start to its end in
bounded memory, rewrites every record as a gzip member of its own and writes a sidecar index of the members' offsets;
a stream that ends before its trailer raises.
``read_records`` reads members by that index, so tasks share a file's records freely.

Archives lie in a folder that driver and executors share (by default below the checkpoint folder), opened with
pyarrow's file systems. A task writes to a name of its own attempt; only the names that successful tasks report, kept
in a checkpointed manifest, are read afterwards, so a repeated task or a lost executor does no harm.

Payloads: of the pages with equal payloads of ``least_revisit`` bytes or more, that with the largest page_id is written
as ``response``, the others as ``revisit`` of it (by its target URI and date), without the payload; smaller ones are all
``response``. Every archive begins with a ``warcinfo`` record. Pages carry no time, so ``WARC-Date`` is a parameter.
Defined cases: a null html is an empty payload; a null url is written empty; a null page_id is written without id and
refers, or is referred to, as null; repeated rows (same id, same payload) are all ``response`` if theirs is the
largest id; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import checkpoint_dir, cut, with_columns_of

#: Compressed bytes read at once; deflate makes at most about a thousand times as many of them.
READ_BYTES = 1 << 15
ROLL_BYTES = 256 << 20
#: Bytes of members that a task reads.
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
INDEX = "path string, offset long, length long, record_type string, page_id long, target_uri string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: dict[str, str]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"


def _uri(url: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")


def info_bytes(name: str, date: str = DATE) -> bytes:
    """The ``warcinfo`` record at the start of an archive."""
    block = b"format: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": date, "WARC-Filename": name}
    return _head(fields | {"Content-Type": "application/warc-fields", "Content-Length": str(len(block))}) + block + END


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, number: int, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One WARC record: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = head if revisit else head + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{number}:{page_id}")
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date}
    fields["WARC-Target-URI"] = _uri(url)
    fields["WARC-Payload-Digest"] = f"sha1:{sha1_base32(payload)}"
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Target-URI": _uri(refers_url), "WARC-Refers-To-Date": date}
        fields["X-Refers-To-Page"] = "" if refers_to is None else str(refers_to)
    fields["X-Page"] = "" if page_id is None else str(page_id)
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return _head(fields) + block + END


def parse_fields(head: bytes) -> dict[str, str]:
    """The named fields of a WARC record's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class Inflated:
    """Reads a gzip file once from start to end, of one member or many, holding a chunk at a time."""

    def __init__(self, source) -> None:
        self.source, self.inflater, self.data, self.begun = source, zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while True:
            raw = self.inflater.unused_data or self.source.read(READ_BYTES)
            if self.inflater.eof:
                self.inflater, self.begun = zlib.decompressobj(31), False
            if not raw:
                if self.begun:
                    raise EOFError("the archive ends within a gzip member")
                return False
            found, self.begun = self.inflater.decompress(raw), True
            if found:
                self.data += found
                return True

    def head(self) -> bytes | None:
        """Up to and without the next empty line; None at the end of the file."""
        while (at := self.data.find(END)) < 0:
            if not self._more():
                if self.data.strip():
                    raise EOFError("the archive ends within a record's head")
                return None
        found, self.data = self.data[:at], self.data[at + len(END) :]
        return found

    def blocks(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self._more():
                raise EOFError("the archive ends within a record")
            found, self.data = self.data[:n], self.data[n:]
            n -= len(found)
            yield found


def planned(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to, refers_url for each row of ``pages`` (page_id, url, html)."""
    rows = with_columns_of(pages, page_id="bigint", url="string", html="string")
    rows = rows.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("same", F.sha2("payload", 256))
    large = F.length("payload") >= least_revisit
    groups = cut(rows.where(large).groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("keep")).select("same", F.col("keep.page_id").alias("keep"), F.col("keep.url").alias("keep_url")))
    joined = rows.join(groups, "same", "left")
    revisit = large & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("keep")).alias("refers_to"), F.when(revisit, F.col("keep_url")).alias("refers_url"))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes ``records`` (as ``planned`` makes them) as gzip streams; returns the manifest: path, n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, n, size, done = TaskContext.get().partitionId(), None, 0, 0, []
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit", "refers_url")], strict=True):
                page_id, url, payload, refers_to, revisit, refers_url = (x.as_py() for x in row)
                if out is None:
                    path = f"{folder}/raw-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    where, name = _open(path)
                    out, squeeze, n, size = where.open_output_stream(name, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    out.write(squeeze.compress(info_bytes(path.rsplit("/", 1)[1], date)))
                data = record_bytes(page_id, url, payload, refers_to, revisit, (part << 40) + (len(done) << 32) + n, refers_url, date)
                out.write(squeeze.compress(data))
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    _make(folder)
    return cut(records.mapInArrow(write, "path string, n_records long"))


def _make(folder: str) -> None:
    where, name = _open(folder)
    where.create_dir(name, recursive=True)


def normalise_stream(source, out) -> Iterator[dict]:
    """Copies a gzip stream's records from ``source`` to ``out`` as members of their own; yields their index rows."""
    stream, offset = Inflated(source), 0
    while (head := stream.head()) is not None:
        head = head.lstrip(b"\r\n")
        fields = parse_fields(head)
        squeeze, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        length += put(squeeze.compress(head + END))
        for block in stream.blocks(int(fields["content-length"])):
            length += put(squeeze.compress(block))
        if b"".join(stream.blocks(len(END))) != END:
            raise ValueError("a record is not followed by two line ends")
        length += put(squeeze.compress(END) + squeeze.flush())
        page = fields.get("x-page")
        yield {"offset": offset, "length": length, "record_type": fields["warc-type"], "page_id": int(page) if page else None, "target_uri": fields.get("warc-target-uri")}
        offset += length


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives of ``manifest`` (path) record by record, each with a sidecar ``.idx``; returns the index."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{path.rsplit('/', 1)[1].removesuffix('.warc.gz').replace('raw-', 'records-')}-{uuid.uuid4().hex}.warc.gz"
                (where, name), (to, target_name) = _open(path), _open(target)
                with where.open_input_stream(name, compression=None) as source, to.open_output_stream(target_name, compression=None) as out, to.open_output_stream(f"{target_name}.idx", compression=None) as side:
                    rows = []
                    for row in normalise_stream(source, out):
                        side.write(json.dumps(row).encode() + b"\n")
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _index(target, rows)
                            rows = []
                if rows:
                    yield _index(target, rows)

    _make(folder)
    # a file to a task, dealt by turns: the files are of bounded size
    return cut(manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(rewrite, INDEX))


def _index(path: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row | {"path": path} for row in rows], _INDEX)


_INDEX = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])


def parse_member(member: bytes) -> dict:
    """A record from its gzip member: the fields of ``RECORD``. A payload that is not what its digest says raises."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(END)
    fields = parse_fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(END)
    n = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    revisit, digest = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"damaged payload of record {fields['warc-record-id']}")
    page, refers = fields.get("x-page"), fields.get("x-refers-to-page")
    return {"page_id": int(page) if page else None, "payload_bytes": n, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(refers) if refers else None, "target_uri": fields.get("warc-target-uri"), "payload": None if revisit else payload}


def read_records(index: DataFrame, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The pages' records that ``index`` points to; ``payloads=False`` leaves the payload column out."""
    schema = RECORD if payloads else RECORD.rsplit(", ", 1)[0]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kind = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows, size = [], 0
            for at, offset, length in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True):
                if at != path:
                    if source is not None:
                        source.close()
                    where, name = _open(at)
                    path, source = at, where.open_input_file(name)
                source.seek(offset)
                record = parse_member(source.read(length))
                rows.append(record if payloads else {k: v for k, v in record.items() if k != "payload"})
                size += record["payload_bytes"] * payloads
                if size > 32 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)
        if source is not None:
            source.close()

    rows = index.where("record_type IN ('response', 'revisit')").select("path", "offset", "length")
    # by the bytes of the members, which the small index says nothing of: adaptive execution would put it into one task
    tasks = math.ceil((rows.agg(F.sum("length")).first()[0] or 0) / task_bytes)
    tasks = max(1, tasks, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, least_revisit: int = 0, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` as archives, normalises them, and reads every record back by its offset.

    The monolithic archives are removed once all of them are normalised.
    """
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(planned(pages, least_revisit), f"{folder}/raw")
    index = normalise(manifest, f"{folder}/records")
    where, name = _open(f"{folder}/raw")
    where.delete_dir(name)
    return read_records(index, payloads)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    out = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
