"""A content-addressed web archive: payloads once in WARC files, exact record headers beside them."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, scratch_folder, slices

#: A payload of fewer bytes is written as a response however often it occurs.
LEAST_SHARED = 1000
#: A payload file is closed once it holds so many bytes, so that reading is dealt over tasks.
FILE_BYTES = 256 << 20
#: Identical rows are dealt over tasks in blocks of so many.
BLOCK = 4096
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "name string, payloads long, bytes long"
END = b"\r\n\r\n"


def addressed(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, sha1, bytes): pages with their payload's digests; null payloads are empty."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})


def named(kind: str, value: Column) -> Column:
    """A header field with its line end; nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{kind}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def headers(rows: DataFrame, least: int = LEAST_SHARED, date: str = EPOCH) -> DataFrame:
    """(page_id, record_id, header, digest), one per row of (page_id, url, digest, sha1, bytes, copies).

    Of rows with one payload of `least` bytes or more, that of the largest page_id (then url; nulls are
    smallest) is a response and all others are revisits of it; so are the second and further copies of
    a row. Smaller payloads are all responses. A header is all that stands before the payload, with the
    head of the HTTP answer; white space and control characters in a URL are written %20, and a null
    URL or page_id has no field.
    """
    shared = F.col("bytes") >= least
    best = rows.where(shared).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"))
    last_block = F.floor((F.col("copies") - 1) / BLOCK)
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    dealt = blocks.join(best, "digest", "left").repartition("digest", "page_id", "url", "block")
    first = F.col("block") * BLOCK
    each = dealt.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("copies"), first + BLOCK) - 1)))

    def record_id(page: Column, url: Column, copy: Column) -> Column:
        h = F.md5(F.to_json(F.struct(page.alias("p"), url.alias("u"), F.col("digest").alias("d"), copy.alias("c"))))
        cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))

    target = F.struct(F.col("page_id"), F.col("url"))
    revisit = F.col("best").isNotNull() & ~(target.eqNullSafe(F.col("best")) & (F.col("copy") == 0))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    whole = F.concat(
        F.lit("WARC/1.1\r\n"),
        named("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        named("WARC-Record-ID", F.col("record_id")),
        named("WARC-Date", F.lit(date)),
        named("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        named("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("best.page_id"), F.col("best.url"), F.lit(0).cast("long")))),
        named("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        named("Page-ID", F.col("page_id")),
        named("Refers-To-Page-ID", F.when(F.col("revisit"), F.col("best.page_id"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        named("Content-Length", block),
        F.lit("\r\n"),
        F.col("http"),
    )
    typed = each.withColumns({"revisit": revisit, "http": http, "record_id": record_id(F.col("page_id"), F.col("url"), F.col("copy"))})
    return typed.select("page_id", "record_id", whole.alias("header"), "digest")


def object_record(digest: str, payload: bytes) -> bytes:
    """One payload as a gzip member that holds a WARC resource record, named by its address."""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:{digest}>\r\nWARC-Date: {EPOCH}\r\nWARC-Target-URI: urn:sha256:{digest}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Type: application/octet-stream\r\nContent-Length: {len(payload)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + payload + END) + packer.flush()


def write_objects(objects: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (digest, payload) rows as WARC files NAME.warc.gz; the files' table.

    A file bears the name of its task's attempt, so one that is lost or runs twice leaves files that
    nothing lists.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        context, out, done = TaskContext.get(), None, []
        for whole in batches:
            for batch in slices(whole, "payload"):
                for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
                    if out is None or done[-1]["bytes"] >= file_bytes:
                        if out:
                            out.close()
                        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        done.append({"name": name, "payloads": 0, "bytes": 0})
                    member = object_record(digest, payload)
                    out.write(member)
                    done[-1]["payloads"] += 1
                    done[-1]["bytes"] += len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(done)
        release()

    return objects.select("digest", "payload").mapInArrow(run, FILES)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_SHARED) -> None:
    """Archive a record per row of pages in a folder that driver and executors share.

    objects/*.warc.gz hold each distinct payload once, under its SHA-256; files and headers are Parquet
    tables of the files and of the exact record headers. Copies are dropped on the map side, so a
    payload that a third of all rows share is one row per task before it is shuffled, once. Identical
    rows meet as one row with a count. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    rows = addressed(pages, key, url, payload)
    narrow = rows.groupBy("page_id", "url", "digest", "sha1", "bytes").agg(F.count("*").alias("copies"))
    narrow.write.parquet(f"{folder}/rows")
    headers(spark.read.parquet(f"{folder}/rows"), least).write.parquet(f"{folder}/headers")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/objects", recursive=True)
    write_objects(rows.select("digest", "payload").dropDuplicates(["digest"]), f"{folder}/objects").write.parquet(f"{folder}/files")


def members(source: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after the other, inflated."""
    data = source.read(chunk)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while True:
            parts.append(inflate.decompress(data))
            if inflate.eof:
                break
            data = source.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)
        data = inflate.unused_data or source.read(chunk)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, names lower-cased, and its block; an error where Content-Length or the end is wrong."""
    head, found, rest = record.partition(END)
    lines = head.decode("utf-8").split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(fields.get("content-length", -1))
    if not found or not lines[0].startswith("WARC/") or rest[size:] != END:
        raise ValueError(f"not a WARC record: {lines[0][:80]}")
    return fields, rest[:size]


def objects(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(digest, bytes, sha1[, payload]) read back from the WARC files, one task per file.

    Every payload is hashed again: one that isn't what its address says raises.
    """
    kinds = "digest string, bytes long, sha1 string" + ", payload binary" * payloads
    schema = pa.schema([("digest", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string())] + [("payload", pa.binary())] * payloads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(f"{folder}/objects")
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as source:
                    for fields, payload in map(parsed, members(source)):
                        digest = hashlib.sha256(payload).hexdigest()
                        if fields["warc-block-digest"] != f"sha256:{digest}":
                            raise ValueError(f"{name}: {fields['warc-block-digest']} holds other bytes")
                        rows.append((digest, len(payload), hashlib.sha1(payload).hexdigest(), payload)[: 3 + payloads])
                        held += len(payload) * payloads + 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        release()

    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    # dealt by number from one partition of a few words per file; a number given isn't coalesced
    return files.coalesce(1).repartition(max(1, files.count())).mapInArrow(run, kinds)


def restore(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The archive's records: (page_id, record_id, header, digest, record_type, payload_digest,
    refers_to, payload_bytes, sha1[, payload, record]), by joining headers with the payloads they name.

    payload is the full one for revisits too; record is the record as it was written: header, payload
    (not that of revisits) and the closing line ends. A header whose payload is missing, or has another
    SHA-1 than the header says, raises.
    """
    rows = spark.read.parquet(f"{folder}/headers")
    end = F.instr("header", "\r\n\r\n")  # what follows is the HTTP head
    warc = F.substring(F.col("header"), F.lit(1), end + 1)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("_warc", f"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))

    fields = {"record_type": field("WARC-Type"), "payload_digest": F.substring_index(field("WARC-Payload-Digest"), ":", -1), "refers_to": field("Refers-To-Page-ID").cast("long"), "_page": field("Page-ID").cast("long")}
    read = rows.withColumn("_warc", warc).withColumns(fields)
    there = objects(spark, folder, payloads).withColumnRenamed("bytes", "payload_bytes")
    # Spark takes what a few file names make for small and would broadcast it
    joined = read.join(there.hint("merge"), "digest", "left")
    sound = (F.col("sha1") == F.col("payload_digest")) & F.col("_page").eqNullSafe(F.col("page_id"))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no sound payload for "), F.col("record_id"))))
    out = joined.withColumn("payload_digest", checked).drop("_warc", "_page")
    if payloads:
        body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        out = out.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit(END)))
    return out


def export(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Write the restored records of an archive as plain WARC files, a gzip member each, in a folder that
    driver and executors share; the files' table, read once so that all files are there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(target)
        context = TaskContext.get()
        name, out, n, total = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", None, 0, 0
        for whole in batches:
            for batch in slices(whole, "record"):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                for record in batch.column("record").to_pylist():
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    out.write(member)
                    n, total = n + 1, total + len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "payloads": n, "bytes": total}])

    store, root = pafs.FileSystem.from_uri(target)
    store.create_dir(root, recursive=True)
    files = sorted(tuple(r) for r in restore(spark, folder).select("record").mapInArrow(run, FILES).collect())
    with store.open_output_stream(f"{root}/files.json") as out:
        out.write(json.dumps([f[0] for f in files]).encode())
    return spark.createDataFrame(files, FILES)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages archived and read back.
    Without a folder it is a new one in the shared folder, which goes with the driver process."""
    folder = folder or scratch_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return restore(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
