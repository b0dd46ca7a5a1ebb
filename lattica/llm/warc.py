"""WARC archives: whole-file gzip streams, their normal form with one gzip member per record, and offset indexes."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cells_for, drop_table, new_path, sketch, spread_join, written
from .words import mix

#: Bytes read or inflated at once.
CHUNK = 1 << 20
#: Uncompressed bytes after which a writer begins a new archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Rows of one Arrow batch: pages are long, and a worker holds a batch.
ROWS = 256


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, local or in a store."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object = None, size: int | None = None, sha1: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (and so the payload's length), not the payload.

    Record ids are unique; the page's id is a field of its own, left out for a null id. The payload's
    length and digest are computed unless they are given, as for a revisit whose payload isn't at hand.
    """
    size, sha1 = len(payload) if size is None else size, sha1 or digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"Page-ID: {quote(str(page_id))}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {quote(str(refers_to))}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Stream:
    """Bytes of a gzip file of one or many members, inflated once and in order."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.inflate, self.buffer, self.ended = file, zlib.decompressobj(31), bytearray(), False
        self.rest = b""

    def _more(self) -> bool:
        while not self.ended:
            data = self.rest or self.file.read(CHUNK)
            self.rest = b""
            if not data:
                self.ended = True
                break
            out = self.inflate.decompress(data, CHUNK)
            self.rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            if out:
                self.buffer += out
                return True
        return False

    def records(self) -> Iterator[bytes]:
        """Whole records, one at a time: memory is that of the longest record."""
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("the archive ends within a record's header")
                    return
            size = end + 4 + int(parse_head(bytes(self.buffer[:end]))["content-length"]) + 4
            while len(self.buffer) < size:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            out = bytes(self.buffer[:size])
            del self.buffer[:size]
            yield out


def normalise(files: fs.FileSystem, path: str, target: str) -> int:
    """Rewrite a gzip archive with one member per record, and a sidecar index (target + ".idx"): offset, length, record id."""
    offset = count = 0
    with files.open_input_stream(path, compression=None) as source, files.open_output_stream(target, compression=None) as out, files.open_output_stream(target + ".idx", compression=None) as index:
        for data in Stream(source).records():
            squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = squeeze.compress(data) + squeeze.flush()
            out.write(member)
            index.write(f"{offset}\t{len(member)}\t{parse_head(data[: data.index(b'\r\n\r\n')])['warc-record-id']}\n".encode())
            offset += len(member)
            count += 1
    return count


def read_indexed(files: fs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every record, each fetched by its index entry."""
    with files.open_input_stream(path + ".idx", compression=None) as index:
        entries = index.read().decode().splitlines()
    with files.open_input_file(path) as source:
        for entry in entries:
            offset, length, _ = entry.split("\t")
            source.seek(int(offset))
            data = zlib.decompress(source.read(int(length)), 31)
            end = data.index(b"\r\n\r\n")
            head = parse_head(data[:end])
            yield head, data[end + 4 : end + 4 + int(head["content-length"])]


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python in short batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_monolithic(rows: DataFrame, folder: str, wanted: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """Archives of one gzip stream each; a row per archive: path, records.

    rows begins with _id, url, html, bytes, sum (SHA-1 in hex), record_type, refers_to; only rows that are `wanted` are
    written. Every task attempt writes files of its own names; only those of attempts that count are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        out, squeeze, size, count, paths = None, None, 0, 0, []
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted(batch)))
            for page, url, html, length, sha1, kind, refers in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if out is None:
                    path = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, size, count = files.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(kind, page, url, (html or "").encode(), refers, length, base64.b32encode(bytes.fromhex(sha1)).decode())
                out.write(squeeze.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.write(squeeze.flush())
                    out.close()
                    paths.append((path, count))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            paths.append((path, count))
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths]), pa.array([c for _, c in paths], pa.int64())], names=["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Normal form of each archive (rows path): path of the new file, records, and the path of the archive it was made from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = path.removesuffix(".warc.gz") + f".{uuid.uuid4().hex[:8]}.records.warc.gz"
                count = normalise(files, path, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([count], pa.int64()), pa.array([path])], names=["path", "records", "source"])

    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInArrow(run, "path string, records long, source string")


def records_of(archives: DataFrame, folder: str) -> DataFrame:
    """Rows page, payload_bytes, payload_digest, record_type, refers, read back by the indexes; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(folder)
        names, kinds = ["page", "payload_bytes", "payload_digest", "record_type", "refers"], (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[list] = [[], [], [], [], []]
                for head, block in read_indexed(files, path):
                    cut = block.index(b"\r\n\r\n") + 4
                    size = int(parse_head(block[: cut - 4])["content-length"])
                    named = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(block) - cut != size or digest(block[cut:]) != named):
                        raise ValueError(f"{path}: a payload does not match its digest")
                    page, refers = head.get("page-id"), head.get("refers-to-page-id")
                    for column, value in zip(out, (None if page is None else unquote(page), size, named, head["warc-type"], None if refers is None else unquote(refers)), strict=True):
                        column.append(value)
                    if len(out[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                        out = [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return archives.select("path").mapInArrow(run, "page string, payload_bytes long, payload_digest string, record_type string, refers string")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield mix(batch.column(0).to_numpy().view(np.uint64))


def archived(df: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html", keep_source: bool = False) -> DataFrame:
    """Write every row as a record, normalise the archives, and read them back.

    Rows: row_id, payload_bytes, payload_digest, record_type, refers_to. Of rows with equal
    payloads (null: empty) that with the largest id is the response; rows that repeat that id and
    payload are responses too, the others revisit it. Rows with a null id revisit the largest id,
    or are responses if there is none. An empty table gives no rows; extra columns, whatever their
    names, are left out; a worker holds at most ROWS pages of any length. Archives before
    normalising are deleted unless keep_source is set.

    A sketch tells which payloads surely occur once: those rows are written where they are read.
    Of the others only the responses' texts are moved.
    """
    spark = df.sparkSession
    folder = new_path(spark, "warc")
    kind = df.schema[row_id].dataType.simpleString()
    pages = df.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    pages = pages.select("_id", "url", "html", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.encode("html", "UTF-8")).alias("sum"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    tagged = pages.withColumn("tag", F.xxhash64("sum")).withColumn("own", F.xxhash64("sum", "_id"))
    narrow = written(tagged.select("_id", "url", "bytes", "sum", "tag"), "payloads")
    rows, bytes_ = narrow.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    repeated, _ = sketch(narrow.select("tag"), _values, cells_for(rows), 2)

    def again(column: pa.Array) -> np.ndarray:
        return repeated.value.holds(mix(column.to_numpy().view(np.uint64)))

    def several_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(again(batch.column(4))))

    several = narrow.mapInArrow(several_rows, narrow.schema)
    last = written(several.groupBy("sum").agg(F.max("_id").alias("_last"), F.count("*").alias("_n")), "repeated-payloads")
    lasts, _ = sketch(last.select(F.xxhash64("sum", "_last")), _values, cells_for(last.count()), 1)
    hot = [r[0] for r in last.filter(F.col("_n") * 1000 > rows).select("sum").collect()]  # fewer than 1000

    def once(batch: pa.RecordBatch) -> np.ndarray:
        return ~again(batch.column(7))

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(again(batch.column(7)) & lasts.value.holds(mix(batch.column(8).to_numpy().view(np.uint64)))))

    with _short_batches(spark):
        archives = int(max(2 * spark.sparkContext.defaultParallelism, bytes_ // ARCHIVE_BYTES))
        first = written(write_monolithic(tagged.coalesce(archives), folder, once), "archives")
        shown = tagged.mapInArrow(responses, tagged.schema).join(last.select(F.col("sum").alias("_sum"), "_last"), F.col("sum") == F.col("_sum")).filter(F.col("_id").eqNullSafe(F.col("_last"))).select(pages.columns)
        others = spread_join(several, last.select(F.col("sum").alias("_sum"), "_last"), "sum", "_sum", hot, "_id").filter(~F.col("_id").eqNullSafe(F.col("_last")))
        others = others.select("_id", "url", F.lit("").alias("html"), "bytes", "sum", F.lit("revisit").alias("record_type"), F.col("_last").alias("refers_to"))
        second = written(write_monolithic(shown.unionByName(others).coalesce(archives), folder), "archives")
        raw = first.unionByName(second)
        clean = written(normalised(raw, folder), "records")
    drop_table(narrow)
    if not keep_source:
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        root = path_of(folder)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for r in clean.select("source").toLocalIterator():  # one name an archive
            files.delete(path_of(root, r[0].rsplit("/", 1)[1]), False)
    found = records_of(clean, folder)
    return found.select(F.col("page").cast(kind).alias(row_id), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
