"""Token ids in flat binary files with 64-bit document offsets, and reading them back."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, scratch_folder, slices
from .tokens import encoder

PARTS = "part long, name string, docs long, tokens long, null_ids long"
ROWS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, spaces: bool = False) -> DataFrame:
    """Write the ids of every document in ascending doc_id order; returns the files' manifest.

    The documents are range-partitioned by doc_id, so the parts follow each other in order. A part is
    three files: NAME.ids, the ids of its documents one after the other, as little-endian unsigned
    16-bit integers if the vocabulary has at most 65,536 ids and 32-bit ones otherwise; NAME.offsets,
    unsigned 64-bit integers, where each document begins in NAME.ids and at last where the part ends,
    in ids; NAME.docs, the documents' ids as signed 64-bit integers. manifest.json lists the parts
    with their base, the number of ids in all parts before, by a prefix sum over the parts' totals:
    a few numbers per part are all that the driver sees.

    A task writes files under a name of its own attempt and reports that name, so an attempt that is
    lost or runs twice leaves files that no manifest mentions.

    spaces: whether the vocabulary's tokens hold white space (byte-level) or it is dropped.
    Each document's ids end with end_id; a null or empty text is end_id alone. Rows without an id come
    first; the manifest counts them. Rows that share an id follow each other by a hash of their text,
    then by the text, so the files are the same in every run. An empty table gives no part.
    """
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        encode = encoder(vocabulary, spaces)
        kind = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        context = TaskContext.get()
        part, name = context.partitionId(), f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        end, total, offsets, keys, nulls = np.array([end_id], kind), 0, [0], [], 0
        out = None
        for whole in batches:
            for batch in slices(whole):
                out = out or store.open_output_stream(f"{root}/{name}.ids")
                ids = encode(batch.column("text").to_pylist())
                for key, x in zip(batch.column("doc_id").to_pylist(), ids):
                    out.write(x.astype(kind).tobytes() + end.tobytes())
                    total += len(x) + 1
                    offsets.append(total)
                    keys.append(key or 0)
                    nulls += key is None
        encode.end_of_task()
        if out is None:
            return
        out.close()
        for kind_of, values in (("offsets", np.array(offsets, "<u8")), ("docs", np.array(keys, "<i8"))):
            with store.open_output_stream(f"{root}/{name}.{kind_of}") as side:
                side.write(values.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": len(keys), "tokens": total, "null_ids": nulls}])

    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = id_and_text(docs).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    parts = sorted(ordered.mapInArrow(run, PARTS).collect())
    bases = np.concatenate([[0], np.cumsum([p.tokens for p in parts], dtype=np.int64)]).tolist()
    size = encoder(vocabulary, spaces).tokenizer.get_vocab_size()
    manifest = {"dtype": "<u2" if size <= 1 << 16 else "<u4", "end_id": end_id, "parts": [p.asDict() | {"base": b} for p, b in zip(parts, bases)]}
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return part_table(spark, manifest)


def part_table(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(p["part"], p["name"], p["docs"], p["tokens"], p["null_ids"], p["base"], manifest["dtype"]) for p in manifest["parts"]]
    return spark.createDataFrame(rows, PARTS + ", base long, dtype string")


def open_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts that manifest.json in the folder lists."""
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as source:
        return part_table(spark, json.loads(source.read()))


def mapped(store: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is local, else read."""
    if not store.get_file_info(path).size:
        return np.empty(0, kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind)


def read(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, one task per part.

    start counts the ids of all documents before, ids_crc32 is the unsigned CRC-32 of the document's
    ids as little-endian unsigned 32-bit integers, whatever the files hold.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for p in batch.to_pylist():
                ids = mapped(store, f"{root}/{p['name']}.ids", p["dtype"])
                offsets = mapped(store, f"{root}/{p['name']}.offsets", "<u8").astype(np.int64)
                keys = mapped(store, f"{root}/{p['name']}.docs", "<i8")
                for i in range(0, len(keys), 8192):
                    at = offsets[i : i + 8193]
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                    names = [None if i + k < p["null_ids"] else v for k, v in enumerate(keys[i : i + 8192].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, p["base"] + at[:-1], np.diff(at), crc)], schema=ROWS)

    # dealt in turn from one partition of a few numbers per part; a number given isn't coalesced
    spread = parts.coalesce(1).repartition(max(1, parts.count()))
    return spread.mapInArrow(run, ", ".join(f"{n} long" for n in ROWS.names))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, spaces: bool = False, folder: str | None = None) -> DataFrame:
    """Write the documents' ids to a folder, and read the files back. Without one given it is a new one
    in the shared folder, which goes with the driver process or by common.sweep()."""
    folder = folder or scratch_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, vocabulary, end_id, spaces), folder)
