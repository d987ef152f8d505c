"""WARC archives: writing with revisits, and a reader that salvages damaged ones."""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agestrata.llm.store import in_small_batches, new_folder, written

VERSION = b"WARC/1.1"
#: A file is closed when it holds so many bytes; readers hold one whole file.
FILE_BYTES = 16 << 20
LEVEL = 4
FEED = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, html: str | None, refers_to, date: str) -> bytes:
    """One record: a response with HTTP header and payload, or, where ``refers_to`` names
    the page with the same payload, a revisit with the HTTP header only."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    )
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    fields.append(("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    fields += [("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Refers-To", f"<{PAGE}{refers_to}>"), ("WARC-Profile", REVISIT)]
    fields += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, block)


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def with_originals(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: of pages with equal payloads the largest page_id is
    the original, the others refer to it. Only digests are shuffled, with map-side combine;
    the digests met more than once are stored, so that the planner knows whether they
    can be broadcast. Rows with the original's page_id, or with none, if all lack one, are
    originals too."""
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    keyed = pages.select("page_id", "url", "html", digest.alias("_digest"))
    met = keyed.groupBy("_digest").agg(F.count("*").alias("_n"), F.max("page_id").alias("_first"))
    met = written(met.where("_n > 1").drop("_n"), "warc-originals")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return keyed.join(met, "_digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``page_id, url, html, refers_to`` as gzipped WARC files under
    ``folder/archives`` and list the files in ``folder/manifest``.

    ``folder`` is a shared one that pyarrow can open (local or mounted, HDFS, S3, GCS).
    Every attempt of a task writes under names of its own and the manifest, written by
    Spark's committer, lists those of the attempts that counted, so retries and lost
    executors leave no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(f"{base}/archives", recursive=True)
        made, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, size = store.open_output_stream(f"{base}/archives/{name}", compression=None), 0
                    made.append(name)
                data = member(page_record(row["page_id"], row["url"], row["html"], row["refers_to"], date))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["file"])

    in_small_batches(pages.select("page_id", "url", "html", "refers_to")).mapInArrow(run, "file string").write.parquet(f"{folder}/manifest")


@dataclass
class Entry:
    """A record, or with ``reason`` a gap that holds none, at bytes ``start`` to ``stop``."""

    start: int
    stop: int
    fields: dict[str, str] | None = None
    block: bytes = b""
    reason: str | None = None


class Damaged(ValueError):
    pass


def _digest_holds(field: str | None, data: bytes) -> bool:
    if field is None:
        return True
    name, _, value = field.partition(":")
    if name.lower() != "sha1":
        return True
    return value.upper() in (sha1_base32(data), hashlib.sha1(data).hexdigest().upper())


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return {}, block
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``, all its checks done, and where it ends."""
    if not re.match(rb"WARC/\d+\.\d+\r\n", data[at : at + 16]):
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("header does not end")
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields:
        raise Damaged("header lacks a length or a type")
    start = head + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[start:stop]
    if not _digest_holds(fields.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    if fields["warc-type"] == "response" and not _digest_holds(fields.get("warc-payload-digest"), split_http(block)[1]):
        raise Damaged("payload digest differs")
    return fields, block, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends; its checksum is verified."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            feed = data[pos : pos + FEED]
            if not feed:
                raise Damaged("member does not end")
            out.append(unpack.decompress(feed))
            pos += len(feed)
    except zlib.error as error:
        raise Damaged(f"member: {error}") from None
    return b"".join(out), pos - len(unpack.unused_data)


_START = re.compile(rb"\x1f\x8b\x08|WARC/\d")


def salvage(data: bytes) -> list[Entry]:
    """All records of an archive that pass their checks, gzipped by member or plain, and
    the byte ranges between them.

    After a failed check the search goes on one byte later for a gzip member or version
    line from which a whole record can be read. Bytes passed over are one gap, with the
    first reason. A member that holds several records, or bytes that are none, gives
    entries at the member's own range.
    """
    entries: list[Entry] = []
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                plain, stop = _inflate(data, at)
                inner = salvage(plain) if plain[:2] != b"\x1f\x8b" else [Entry(0, 0, reason="member in a member")]
                found = [Entry(at, stop, e.fields, e.block, e.reason) for e in inner]
            else:
                fields, block, stop = _parse(data, at)
                found = [Entry(at, stop, fields, block)]
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            seen = _START.search(data, at + 1)
            at = seen.start() if seen else len(data)
            continue
        if gap is not None:
            entries.append(Entry(gap, at, reason=reason))
            gap = None
        entries += found
        at = stop
    if gap is not None:
        entries.append(Entry(gap, len(data), reason=reason))
    return entries


def _name(urn: str | None) -> str | None:
    return urn.strip("<>") if urn else None


SHAPE = (
    "file string, start long, stop long, reason string, type string, record_id string, uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives under ``folder/archives`` that
    ``folder/manifest`` lists, or of all files in ``folder`` if it has no manifest.

    ``file, start, stop`` is the byte range; ``reason`` is NULL for records and says why
    for gaps, which have no other columns. Length and digest are those of the full payload:
    computed for responses, as stated by the record for revisits. With ``payloads`` false
    the payload is checked but not returned. An empty file gives no rows.
    """
    files = spark.read.format("binaryFile")
    try:
        listed = spark.read.schema("file string").parquet(f"{folder}/manifest")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        files = files.load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    else:
        if not listed.head(1):
            return spark.createDataFrame([], SHAPE)
        files = files.load(f"{folder}/archives").withColumn("file", F.element_at(F.split("path", "/"), -1))
        files = files.join(listed, "file", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [_row(name.as_py(), entry, payloads) for entry in salvage(content.as_py())]
                for i in range(0, len(rows), 500):
                    part = list(zip(*rows[i : i + 500]))
                    kinds = [pa.string(), *[pa.int64()] * 2, *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(part, kinds)], [x.split()[0] for x in SHAPE.split(", ")]
                    )

    return files.select("file", "content").mapInArrow(run, SHAPE)


def _row(name: str, entry: Entry, payloads: bool):
    f = entry.fields
    if f is None:
        return (name, entry.start, entry.stop, entry.reason, *[None] * 7)
    http, payload = split_http(entry.block)
    if f["warc-type"] == "revisit":
        stated = http.get("content-length", "")
        n, digest = int(stated) if stated.isdigit() else None, f.get("warc-payload-digest", "").rpartition(":")[2] or None
    else:
        n, digest = len(payload), sha1_base32(payload)
    return (
        name, entry.start, entry.stop, None, f["warc-type"], _name(f.get("warc-record-id")), f.get("warc-target-uri"),
        _name(f.get("warc-refers-to")), n, digest, payload if payloads else None,
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row, after
    writing ``pages`` to archives in the shared folder and reading those back.

    A NULL html is an empty payload, a NULL url leaves its field out, and a NULL page_id
    comes back as NULL. Equal rows are records of their own. Other columns are left out,
    whatever their names. An empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(with_originals(pages), folder)
    read = read_archives(pages.sparkSession, folder, payloads=False).where("reason is null")
    kind = pages.schema["page_id"].dataType

    def page(column: str):
        return F.nullif(F.substring(column, len(PAGE) + 1, 1 << 20), F.lit("")).cast(kind)

    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
