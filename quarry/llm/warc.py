"""WARC archives compressed with Zstandard: one frame a record, a shared dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._store import scratch_path
from quarry.shipping import ship

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Spark holds no longer string, so no longer payload is ever written; a record adds its headers.
_MOST = (1 << 31) + (1 << 20)
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")


class ArchiveError(ValueError):
    """An archive or a record that breaks its format."""


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _escaped(value: str) -> str:
    """An id as a header's value: line ends, blanks and whatever is not ASCII are percent-encoded."""
    return urllib.parse.quote(value, safe="/:")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a qualified URI as Spark names it, and the path in it; s3a and s3n are S3, and file:/x is local."""
    scheme, _, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{scheme}:{urllib.parse.quote(rest, safe='/:@')}")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Spark itself would read it from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit of another page's response, which keeps only the HTTP head."""
    name = lambda page: f"<{uuid.uuid5(_NAMESPACE, page).urn}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = f"{page_id}" if page_id is not None else f"null {digest}"
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {name(own)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {urllib.parse.quote(url, safe='/:?#[]@!$&()*+,;=%~') if url else 'urn:none'}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {_escaped(page_id)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {_escaped(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, block and payload facts of one record; ArchiveError unless all of it is consistent."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise ArchiveError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8").partition(":")
        if not colon or not key.strip():
            raise ArchiveError(f"bad header line {line!r}")
        if key.strip().lower() in headers:
            raise ArchiveError(f"repeated header {key}")
        headers[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise ArchiveError(f"missing header {key}")
    if not headers["content-length"].isdecimal():
        raise ArchiveError("bad content length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"content length {size}, but {len(rest) - 4} bytes before the end of the record")
    block = rest[:size]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + payload_digest(hashlib.sha1(block).digest()):
        raise ArchiveError("block digest does not match")
    out = {"headers": headers, "type": headers["warc-type"], "block": block, "payload": None, "payload_bytes": None, "digest": None}
    if headers["warc-type"] in ("response", "revisit"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep or not http.startswith(b"HTTP/"):
            raise ArchiveError("no HTTP header")
        found = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if len(found) != 1 or not found[0].isdigit():
            raise ArchiveError("no HTTP content length")
        digest = headers.get("warc-payload-digest", "")
        if not digest.startswith("sha1:"):
            raise ArchiveError("no payload digest")
        if headers["warc-type"] == "response":
            if int(found[0]) != len(payload):
                raise ArchiveError("HTTP content length does not match")
            if digest != "sha1:" + payload_digest(hashlib.sha1(payload).digest()):
                raise ArchiveError("payload digest does not match")
            out["payload"] = payload
        elif payload or "warc-refers-to" not in headers:
            raise ArchiveError("a revisit has a payload or refers to nothing")
        out |= {"payload_bytes": int(found[0]), "digest": digest[5:]}
    return out


def frame_end(data: memoryview, start: int) -> int:
    """End of the Zstandard frame at start, from its header and block headers."""
    try:
        parameters = zstandard.get_frame_parameters(data[start : start + 18])
        at = start + zstandard.frame_header_size(data[start : start + 18])
    except zstandard.ZstdError as e:
        raise ArchiveError(f"no frame at byte {start}: {e}") from e
    while True:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise ArchiveError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    at += 4 * bool(parameters.has_checksum)
    if at > len(data):
        raise ArchiveError("a frame is cut off")
    return at


def read_archive(data: bytes, max_record: int = _MOST) -> Iterator[tuple[int, dict]]:
    """Byte offset and parsed record of each frame of an archive."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ArchiveError("the dictionary frame is cut off")
        raw = data[8 : 8 + size]
        if len(raw) >= 4 and struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(view, at)
        size = zstandard.frame_content_size(view[at : at + 18])
        if size < 0 or size > max_record:
            raise ArchiveError(f"a record of unknown size or over {max_record} bytes")
        try:
            yield at, parse_record(reader.decompress(view[at:end]))
        except zstandard.ZstdError as e:
            raise ArchiveError(f"bad frame at byte {at}: {e}") from e
        at = end


def leading_frame(dictionary: bytes, compress: bool = True) -> bytes:
    content = zstandard.ZstdCompressor(level=19).compress(dictionary) if compress else dictionary
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from sample records; their plain bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _writer(out_dir: str, dictionary: bytes, archive_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = filesystem(out_dir)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        head = leading_frame(dictionary) if dictionary else b""
        held, size, count, number = [head], len(head), 0, 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/pages-{context.partitionId():06d}-{number:06d}.warc.zst"
            partial = f"{folder}/_{context.partitionId()}-{number}-{context.taskAttemptId()}.tmp"
            with store.open_output_stream(partial) as f:
                for part in held:
                    f.write(part)
            store.move(partial, name)  # an attempt's file is whole, and every attempt's is the same
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            ids, urls, payloads, refers = batch.columns
            for i in range(batch.num_rows):
                payload = payloads[i].as_buffer().to_pybytes()
                digest = payload_digest(hashlib.sha1(payload).digest())
                data = pack.compress(record(ids[i].as_py(), urls[i].as_py(), payload, digest, refers[i].as_py(), date))
                held.append(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    yield close()
                    held, size, count, number = [head], len(head), 0, number + 1
        if count:
            yield close()

    return run


def _dictionary(rows: DataFrame, date: str, most: int, sample_bytes: int) -> bytes:
    """A dictionary from whole pages with the smallest hashed ids, as far as they keep to both bounds, and from bare headers."""
    record_of = lambda r, payload: record(str(r["id"]), r["url"], payload, payload_digest(hashlib.sha1(payload).digest()), None, date)
    hashed = F.xxhash64(F.col("id").cast("string"))
    order = (hashed, F.col("sha"))
    met = rows.select("id", "sha", "size", "url", hashed.alias("h")).orderBy(*order).limit(most).collect()
    taken, total = [], 0
    for r in met:
        if total + r["size"] <= sample_bytes:
            total += r["size"]
            taken.append(r["sha"])
    samples = [record_of(r, b"") for r in met[:16]]
    if taken:
        samples += [record_of(r, bytes(r["payload"])) for r in rows.where((hashed <= met[-1]["h"]) & F.col("sha").isin(taken)).dropDuplicates(["sha"]).orderBy(*order).select("id", "url", "payload").collect()]
    return train_dictionary(samples) if samples else b""


def write_archives(
    pages: DataFrame, out_dir: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0,
    archive_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z", dictionary_samples: int = 400, sample_bytes: int = 16 << 20, level: int = 3,
) -> int:
    """Write a record for each page into archives of about archive_bytes in out_dir; returns the number of records.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at
    least min_revisit_bytes, the one with the smallest id is a response and the others
    revisit it; smaller payloads are all responses. Equal payloads are found by SHA-256
    and length on ids alone; pages themselves are dealt once, by id. A null id can
    neither refer nor be referred to, so its page is a response; rows that repeat both
    id and payload of a response are responses too; ids may hold any characters; other
    columns are ignored.

    The dictionary is trained on at most dictionary_samples whole pages of sample_bytes in
    all, those with the smallest hashed ids, and on headers; it affects sizes only. A task
    writes its pages in order of id under names that depend on the partition alone, each
    file first under another name, so a repeated task replaces files by equal ones. out_dir
    is on the file system that Spark takes it to be on; archives that Spark does not find
    there afterwards, as when executors do not share that folder, are an error.
    """
    spark = pages.sparkSession
    ship(spark)
    out_dir = qualified(spark, out_dir)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    known = rows.select("id", "sha", "size")
    first = known.groupBy("sha", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes)).select("sha", "size", "first")
    again = known.join(first, ["sha", "size"]).where("id <> first").select("id", "sha", F.col("first").cast("string").alias("refers")).distinct()
    dictionary = _dictionary(rows, date, dictionary_samples, sample_bytes)
    dealt = rows.join(again.hint("shuffle_hash"), ["id", "sha"], "left").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "id", "sha")
    ordered = dealt.sortWithinPartitions("id", "sha", "url").select(F.col("id").cast("string"), "url", "payload", "refers")
    store, folder = filesystem(out_dir)
    store.create_dir(folder, recursive=True)
    done = ordered.mapInArrow(_writer(out_dir, dictionary, archive_bytes, date, level), "path string, records long, bytes long")
    sums = [F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")]
    said = done.agg(*sums).first()
    if said["files"]:
        there = _files(spark, out_dir).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first()
        if (there["files"], there["bytes"]) != (said["files"], said["bytes"]):
            raise ArchiveError(f"{said['files']} archives of {said['bytes']} bytes were written to {out_dir}, but {there['files']} of {there['bytes']} are there: do all executors share it?")
    return said["records"] or 0


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", max_record: int = _MOST) -> DataFrame:
    """The records of all *.warc.zst archives in path, each validated; an archive is read in one task.

    Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to (page id),
    payload (null for revisits), archive, offset. A broken archive fails the job.
    """
    ship(spark)
    kinds = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, archive string, offset long"
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, r in read_archive(content.as_buffer().to_pybytes(), max_record):
                    h = r["headers"]
                    page, other = (None if x is None else urllib.parse.unquote(x) for x in (h.get("x-page-id"), h.get("x-refers-to-page-id")))
                    rows.append((page, h.get("warc-target-uri"), r["type"], r["payload_bytes"], r["digest"], other, r["payload"], path, offset))
                    size += len(r["block"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = _files(spark, path).select("path", "content")
    read = files.mapInArrow(run, kinds)
    return read.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    path = qualified(spark, scratch_path(spark, "warc"))
    id_type = pages.schema[options.get("id_col", "page_id")].dataType
    if not write_archives(pages, path, **options):
        return spark.createDataFrame([], T.StructType()).select(*(F.lit(None).cast(t).alias(c) for c, t in (("page_id", id_type), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", id_type))))
    return read_archives(spark, path, id_type.simpleString())
