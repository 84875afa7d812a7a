r"""WARC archives: writing, normalising monolithic gzip, and reading by offset.

Records are written by Spark itself: a row is a record, the record trailer is the
line separator, so a part file is one gzip stream over a whole archive, committed
as any output is.  Such a file can only be read from its start.

``normalise`` mends that: a task streams one archive through inflate once, and
each record goes out again as a gzip member of its own.  The members' places make
the offset index, a table beside the archives.  What a task holds is a buffer,
not a record: members are deflated as they are inflated.  An archive appears
under its name when it is complete, and a task run again makes the same bytes, so
lost executors leave nothing but a hidden file.  Archives that are plain, or hold
a member for each record or for several, are taken too.

``read_records`` deals the index to tasks by key ranges; each seeks to its members.
Payloads are hashed as they are read; one that isn't what its record says is an
error, as is an archive that ends inside a record.

Equal payloads of ``LEAST`` bytes or more are stored once: the record with the
smallest key is a response, others revisit it and keep its HTTP header, so length
and digest of the payload are known of both.

Defined cases: a null text is an empty payload; short payloads are all responses;
rows that repeat the smallest key of a payload are responses; null keys are never
the smallest (if all are null, all are responses) and are read back as null; line
ends, tabs and blanks of a URL are percent-encoded in its header; payloads of any
length and content stay as they are, blank lines included; an empty table makes
an archive without records; other columns, whatever their names, stay outside.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, join_hot, new_folder, settle

LEAST = 100
RESPONSE, REVISIT = "response", "revisit"
DATE = "1970-01-01T00:00:00Z"
TRAILER = "\r\n\r\n"
#: Profile of a revisit record (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: Compressed bytes that a reading task is dealt, about.
SPLIT = 1 << 24
LEVEL = 6


def with_types(pages: DataFrame, key: str, text: str, url: str | None, least: int = LEAST) -> DataFrame:
    """(_key, _url, _text, _size, digest, _first) of each row; ``_first`` is the key it revisits, or null.

    Texts are shuffled only if the table of repeated payloads is too large to be sent to all.
    """
    payload = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cols = [F.col(key).alias("_key"), (F.col(url) if url else F.lit(None)).cast("string").alias("_url"), payload.alias("_text")]
    rows = pages.select(*cols).withColumns({"_size": F.octet_length("_text").cast("long"), "digest": F.sha2(F.col("_text").cast("binary"), 256)})
    repeated = rows.where(F.col("_size") >= least).groupBy("digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = join_hot(rows, settle(repeated), ["digest"], "_n", "left")
    return found.withColumn("_first", F.when(~F.col("_key").eqNullSafe(F.col("_first")), F.col("_first")))


def record(scheme: str = "page", date: str = DATE) -> Column:
    """A row of ``with_types`` as a WARC record without its trailer."""
    name = lambda c: F.concat(F.lit(f"<urn:{scheme}:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.col("_url")
    for sign, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(sign), F.lit(code))
    again = F.col("_first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("_size"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, REVISIT).otherwise(RESPONSE)),
        line("WARC-Record-ID", name("_key")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", name("_first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    ]
    return F.concat(*head, http, F.when(again, "").otherwise(F.col("_text"))).alias("value")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", text: str = "html", url: str | None = "url", least: int = LEAST) -> None:
    """A record of each row, in archives of one gzip stream each."""
    with_types(pages, key, text, url, least).select(record()).write.option("lineSep", TRAILER).option("compression", "gzip").text(folder)


def store(uri: str):
    """File system and path of a URI as Spark writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def heads(stream: BinaryIO) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """Each record's header as it is, its fields, and the length of the block that is to be read next."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        raw, fields = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends inside a record's header")
            raw.append(line)
            field, _, value = line.decode("utf-8", "replace").partition(":")
            fields[field.strip().lower()] = value.strip()
        yield b"".join([*raw, line]), fields, int(fields["content-length"])


def chunks(stream: BinaryIO, length: int) -> Iterator[bytes]:
    while length:
        part = stream.read(min(CHUNK, length))
        if not part:
            raise ValueError("the archive ends inside a record")
        length -= len(part)
        yield part


def inflated(raw: BinaryIO) -> BinaryIO:
    """The archive's bytes, whether it is one gzip stream, many members or plain."""
    raw = io.BufferedReader(raw, CHUNK)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), CHUNK) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


INDEX = "archive string, offset long, length long, record_id string, record_type string"


def rewrite(source: BinaryIO, sink: BinaryIO) -> Iterator[tuple[int, int, str, str]]:
    """Writes each record of ``source`` as a gzip member; (offset, length, record id, type) of each."""
    stream, at = inflated(source), 0
    for head, fields, length in heads(stream):
        deflate, begun = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at
        for part in (head, *(() if not length else chunks(stream, length)), TRAILER.encode()):
            at += sink.write(deflate.compress(part))
        at += sink.write(deflate.flush())
        yield begun, at - begun, fields.get("warc-record-id", ""), fields.get("warc-type", "")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Archives of folder ``source`` with a member for each record in ``target``; returns the index, kept beside them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path")  # contents aren't read
    n_files = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name = uri.rpartition("/")[2].split(".")[0] + ".warc.gz"
                (here, path), (there, folder) = store(uri), store(target)
                there.create_dir(folder, recursive=True)
                hidden, out = f"{folder}/.{name}.{uuid.uuid4().hex}", []
                with here.open_input_stream(path) as raw, there.open_output_stream(hidden, compression=None) as sink:
                    for row in rewrite(raw, sink):
                        out.append(row)
                        if len(out) == 10_000:
                            yield table_of(f"{target}/{name}", out)
                            out = []
                there.move(hidden, f"{folder}/{name}")
                if out:
                    yield table_of(f"{target}/{name}", out)

    def table_of(archive: str, rows: list[tuple]) -> pa.RecordBatch:
        offset, length, ids, types = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(ids), pa.array(types)], names=["archive", "offset", "length", "record_id", "record_type"])

    files.repartition(n_files).mapInArrow(run, INDEX).write.parquet(f"{target}/_index.parquet")
    return spark.read.schema(INDEX).parquet(f"{target}/_index.parquet")


class Member(io.RawIOBase):
    """The gzip member of ``length`` bytes from here on, inflated as it is read."""

    def __init__(self, raw: BinaryIO, length: int):
        self.raw, self.left, self.deflated = raw, length, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.deflated.eof:
            fed = self.deflated.unconsumed_tail
            if not fed and self.left:
                fed = self.raw.read(min(CHUNK, self.left))
                self.left -= len(fed)
            out = self.deflated.decompress(fed, len(into))
            if out:
                into[: len(out)] = out
                return len(out)
            if not fed:
                raise ValueError("a member isn't whole")
        return 0


def http_header(stream: BinaryIO, length: int) -> tuple[int, dict[str, str]]:
    """Size and fields of the HTTP header that a block of ``length`` bytes starts with."""
    size, fields = 0, {}
    while size < length:
        line = stream.readline(length - size)
        size += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        field, mark, value = line.decode("utf-8", "replace").partition(":")
        if mark:
            fields[field.strip().lower()] = value.strip()
    return size, fields


def parsed(stream: BinaryIO, payload: bool) -> tuple:
    """(record id, type, uri, refers to, payload bytes, payload digest, payload or None) of the record in ``stream``.

    The payload of an HTTP block follows its header, that of any other is the block.
    """
    _, fields, length = next(heads(stream))
    http = fields.get("content-type", "").startswith("application/http")
    before, header = http_header(stream, length) if http else (0, {})
    said, kind = fields.get("warc-payload-digest", ""), fields.get("warc-type")
    common = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"))
    if kind == REVISIT:
        size = header.get("content-length")
        return *common, None if size is None else int(size), said.rpartition(":")[2] or None, None
    found, kept, size = hashlib.sha256(), [], 0
    for part in chunks(stream, length - before):
        found.update(part)
        size += len(part)
        if payload:
            kept.append(part)
    if said.startswith("sha256:") and found.hexdigest() != said[7:]:
        raise ValueError(f"the payload of {common[0]} isn't what its record says")
    return *common, size, found.hexdigest(), b"".join(kept) if payload else None


RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of an index (see ``normalise``), read at its offset; payloads of revisits are null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw = None, None
        for batch in batches:
            out, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != now:
                    files, path = store(archive)
                    now, raw = archive, io.BufferedReader(files.open_input_file(path), CHUNK)
                raw.seek(offset)
                out.append(parsed(io.BufferedReader(Member(raw, length), 1 << 16), payload))
                size += len(out[-1][-1] or b"")
                if size > CHUNK * 8:
                    yield rows_of(out)
                    out, size = [], 0
            if out:
                yield rows_of(out)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    places = index.select("archive", "offset", "length").repartitionByRange(int(size // SPLIT) + 1, "archive", "offset").sortWithinPartitions("archive", "offset")
    found = places.mapInArrow(read, RECORDS)
    return found if payload else found.drop("payload")


def archive_pages(pages: DataFrame) -> DataFrame:
    """The ``op12`` digest: written in monolithic archives, normalised, and read back by the index."""
    spark = pages.sparkSession
    written, folder = new_folder(spark), new_folder(spark)
    write_archives(pages, written)
    index = normalise(spark, written, folder)
    delete(spark, written)
    key = lambda c: F.try_to_number(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("S9999999999999999999")).cast("long")
    return read_records(index, payload=False).select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"), "target_uri")
