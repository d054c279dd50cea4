"""WARC archives: writing, normalising monolithic gzip files, reading by a sidecar index.

``write_archives`` writes one gzip stream for each task's records, as some crawlers do. ``normalise`` inflates each such file
once, as a stream, writes every record again as a gzip member of its own and lists the members (offset, length, record) in a
sidecar index beside the archive. ``read_records`` cuts each index into ranges of about ``range_bytes`` and reads these
members in parallel, so a large archive is no single task, and begins at a mark in the index near its range. Files go through
pyarrow's file systems, in the shared folder; an attempt of a task has file names of its own, which are in its result only when
it succeeds, so a task that runs twice does no harm.

A response's block is an HTTP response, and its payload the body. Archives of other writers are read as well: without digests
(they are computed), with any record ids, blocks that aren't HTTP, chunked bodies, and records of other types (warcinfo, request,
metadata), which come back as such. The payload length of a foreign revisit is unknown, so null.

Memory: a task holds one record and one read buffer, never a file.

Edge cases: a null payload is an empty one; null ids get records without an id in the result; of records with equal payloads
those with the smallest id are responses (several if that id is repeated), the others revisits that carry no payload but its
length and digest; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

FILE_BYTES, RANGE_BYTES, MARK, CHUNK, SALTS, BROADCAST_DIGESTS = 128 << 20, 16 << 20, 1 << 20, 1 << 20, 16, 1_000_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = StructType([StructField("record_id", StringType()), StructField("record_type", StringType()), StructField("uri", StringType()), StructField("refers_to", StringType()), StructField("payload_digest", StringType()), StructField("payload_bytes", LongType())])


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


OWN_ID = "urn:record:"


def record(rid: str | None, uri: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a response's block is an HTTP response, a revisit has none."""
    line = lambda s: s.replace("\r", " ").replace("\n", " ")
    block = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{OWN_ID}{'' if rid is None else line(rid)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {line(uri)}"] if uri else []), f"WARC-Payload-Digest: sha1:{bare_digest(payload)}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <{OWN_ID}{line(refers_to)}>", f"WARC-Profile: {REVISIT}"] if revisit and refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def body_of(block: bytes) -> bytes:
    """The body of an HTTP message, its chunks joined; all of a block that is none."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not (head.startswith(b"HTTP/") or b" HTTP/" in head.partition(b"\r\n")[0]):
        return block
    lines = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    if not any(k.strip() == b"transfer-encoding" and v.strip().endswith(b"chunked") for k, _, v in lines):
        return body
    out, at = bytearray(), 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:  # some crawlers keep the header of what they have joined
            return body
        if not size:
            break
        out += body[end + 2 : end + 2 + size]
        at = end + 2 + size + 2
    return bytes(out)


class Stream:
    """The inflated bytes of a gzip file, of one member or many, read in order."""

    def __init__(self, raw):
        self.raw, self.inflate, self.held, self.started = raw, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        data = self.inflate.unconsumed_tail or self.inflate.unused_data
        if self.inflate.eof:
            self.inflate, self.started = zlib.decompressobj(31), False
        if not data:
            data = self.raw.read(CHUNK)
            if not data:
                if self.started:
                    raise EOFError("the archive ends inside a gzip member")
                return False
        self.started = True
        self.held += self.inflate.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        """All up to and with mark; empty at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise EOFError("the archive ends inside a record")
                return b""
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise EOFError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def records(self) -> Iterator[bytes]:
        while head := self.until(b"\r\n\r\n"):
            yield head + self.exactly(int(fields(head)["content-length"]) + 4)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def bare_id(uri: str | None) -> str | None:
    """A record's id without its brackets, and without the prefix that ``record`` gives it; null if nothing is left."""
    return (uri or "").strip().removeprefix("<").removesuffix(">").removeprefix(OWN_ID) or None


def parsed(data: bytes) -> tuple:
    """The columns of RECORD; a payload is checked against the digest and length that its record gives."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = fields(head)
    kind, block, given = f.get("warc-type"), rest[: int(f["content-length"])], f.get("warc-payload-digest", "")
    length = int(f["x-payload-length"]) if "x-payload-length" in f else None
    digest = given.rpartition(":")[2] or None
    if kind != "revisit":
        payload = body_of(block) if "http" in f.get("content-type", "") else block
        own = bare_digest(payload)
        if given.startswith("sha1:") and len(digest) == len(own) and own != digest or length not in (None, len(payload)):
            raise ValueError(f"{f.get('warc-record-id')}: its payload doesn't match its digest or length")
        digest, length = own, len(payload)
    return bare_id(f.get("warc-record-id")), kind, f.get("warc-target-uri"), bare_id(f.get("warc-refers-to")), digest, length


class Writer:
    """A file that takes its name when it is closed."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        import uuid

        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri


def marked_revisits(pages: DataFrame, id_col: str, payload_col: str, salts: int = SALTS) -> DataFrame:
    """pages as id, uri, payload and the id that each refers to: the smallest of those with the same payload.

    Digests that occur once need no partner. The others, if they are counted to be few, are broadcast, and no payload is shuffled;
    else their smallest ids are joined with salt, as one payload may hold a third of all rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    sha = F.concat(F.sha1(F.col("payload").cast("binary")), F.lit(":"), F.octet_length("payload"))
    first = rows.select("id", sha.alias("sha")).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    first = common.stored(first.hint("rebalance"), "warc_first")
    if common.small_side(first, BROADCAST_DIGESTS) is not first:
        first = F.broadcast(first)
        return rows.withColumn("sha", sha).join(first, "sha", "left").select("id", "uri", "payload", "first")
    first = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("sha", sha).withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"), F.lit(0)))
    return rows.join(first, ["sha", "salt"], "left").select("id", "uri", "payload", "first")


def write_archives(marked: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes id, uri, payload, first as monolithic .warc.gz files under folder; returns a row per file: path, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = f"{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        n, out, plain, count, done = 0, None, 0, 0, []

        def close():
            out.write(squeeze.flush())
            done.append((out.close(), count, out.at))

        for batch in batches:
            for rid, uri, payload, first in zip(*(c for c in map(lambda c: (x.as_py() for x in c), batch.columns)), strict=True):
                if out is None:
                    out, squeeze, plain, count = Writer(f"{folder}/part-{own}-{n:03d}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record(None if rid is None else str(rid), uri, payload.encode(), None if first is None else str(first), first is not None and first != rid)
                out.write(squeeze.compress(data))
                plain, count = plain + len(data), count + 1
                if plain >= file_bytes:
                    close()
                    out, n = None, n + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return marked.mapInArrow(write, "path string, records long, bytes long")


def normalise(files: DataFrame) -> DataFrame:
    """files: path, of WARC files as one gzip stream each (or many). Writes a NAME.norm.warc.gz and its index NAME.norm.idx.jsonl.

    Returns a row per file: path, index, records, bytes, and marks: the index's byte where the record at an offset stands, every ``MARK`` bytes.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().taskAttemptId()
        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                fs, where = pafs.FileSystem.from_uri(path)
                base = f"{path.removesuffix('.gz').removesuffix('.warc')}-{own}"
                out, index, n, marks = Writer(f"{base}.norm.warc.gz"), Writer(f"{base}.norm.idx.jsonl"), 0, []
                with fs.open_input_stream(where, compression=None, buffer_size=CHUNK) as raw:
                    for data in Stream(raw).records():
                        f, at, n = fields(data.partition(b"\r\n\r\n")[0]), out.at, n + 1
                        if not marks or at - marks[-1]["offset"] >= MARK:
                            marks.append({"offset": at, "at": index.at})
                        out.write(gzip.compress(data, 6, mtime=0))
                        entry = {"offset": at, "length": out.at - at, "type": f.get("warc-type"), "id": f.get("warc-record-id"), "digest": f.get("warc-payload-digest")}
                        index.write(json.dumps(entry).encode() + b"\n")
                done.append((out.close(), index.close(), n, out.at, marks))
            if done:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("at", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["path", "index", "records", "bytes", "marks"])

    return files.select("path").mapInArrow(rewrite, "path string, index string, records long, bytes long, marks array<struct<offset:long,at:long>>")


def read_records(archives: DataFrame, range_bytes: int = RANGE_BYTES, parallel: int | None = None) -> DataFrame:
    """archives: path, index, bytes, marks. A row per record, found through the indexes: see RECORD."""
    spark = archives.sparkSession
    cut = archives.select("path", "index", "marks", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(range_bytes))).alias("start"))
    near = F.array_max(F.transform(F.filter("marks", lambda m: m["offset"] <= F.col("start")), lambda m: m["at"]))
    cut = cut.select("path", "index", "start", (F.col("start") + range_bytes).alias("end"), F.coalesce(near, F.lit(0)).alias("from"))
    cut = cut.repartition(parallel or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, start, end, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, where = pafs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_file(where) as raw, fs.open_input_file(pafs.FileSystem.from_uri(index)[1]) as lines:
                    lines.seek(begin)
                    for entry in map(json.loads, text_lines(lines)):
                        if entry["offset"] >= end:
                            break
                        if entry["offset"] >= start:
                            raw.seek(entry["offset"])
                            rows.append(parsed(gzip.decompress(raw.read(entry["length"]))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 5 else pa.string()) for k, x in enumerate(zip(*rows, strict=True))], RECORD.names)

    return cut.mapInArrow(read, RECORD)


def text_lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(CHUNK):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Writes pages as WARC, normalises the archives and reads them back."""
    spark = pages.sparkSession
    folder = common.new_path(spark, "warc")
    files = common.stored(write_archives(marked_revisits(pages, id_col, payload_col), folder), "warc_files")
    done = common.stored(normalise(files.repartitionByRange(max(1, files.count()), "path")), "warc_index")
    return read_records(done)


def typed_id(text: Column, kind: str) -> Column:
    return text.cast(kind)


def op1(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    back = archive_round_trip(pages)
    return back.select(typed_id(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", typed_id(F.col("refers_to"), kind).alias("refers_to"))


_BASE32 = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INT) >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, ''{_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h
"""
