"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that a per-document function is handed at once, by characters: a batch of long
#: documents holds fewer of them.
SLICE_BYTES = 2 << 20
#: The same where what a batch shares (pieces of text) is worth more than memory: a job with no other stage.
WIDE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="caseweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scratch: list[str] = []
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@atexit.register
def sweep() -> None:
    """Delete what materialise wrote for this driver process; its results can't be read any more."""
    while _scratch:
        with contextlib.suppress(OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
            store, path = pafs.FileSystem.from_uri(_scratch.pop())
            store.delete_dir(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one, which sweep() deletes."""
    path = f"{shared_folder(spark)}/caseweave/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files are replicated as that folder's store is, so a lost executor costs only its own tasks.
    They are deleted when the driver process ends, or by sweep().
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what materialise wrote for these once nothing reads them any more."""
    for path in filter(None, (_written.pop(t, None) for t in tables)):
        with contextlib.suppress(OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
            store, folder = pafs.FileSystem.from_uri(path)
            store.delete_dir(folder)
            _scratch.remove(path)


def private(docs: DataFrame, stem: str = "_caseweave_") -> str:
    """A prefix that no column of docs begins with, in whatever case."""
    while any(c.lower().startswith(stem.lower()) for c in docs.columns):
        stem = "_" + stem
    return stem


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about so many bytes of text, one row at least."""
    at, rows = 0, batch.num_rows
    if not rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    yield batch.slice(at)


def release() -> None:
    """Give freed memory back at the end of a task: an idle worker stays alive beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def by_text(schema: pa.Schema, rows: Callable[[list, list], dict]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from rows(ids, texts) -> columns, with one output row per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = rows(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        release()

    return run


def adding_columns(rows: Callable[[list], list[pa.Array]], text: str = "text", done: Callable[[], None] | None = None) -> Callable:
    """A mapInArrow function that keeps every column of its input and appends those of rows(texts).

    done is called at the end of a task, after which a worker should hold nothing large.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                more = rows(batch.column(text).to_pylist())
                names = [*batch.schema.names, *(f"_caseweave_{i}" for i in range(len(more)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)
        if done:
            done()
        release()

    return run


def with_columns(docs: DataFrame, rows: Callable[[list], list[pa.Array]], columns: list[tuple[str, str]], text: str = "text", done: Callable[[], None] | None = None) -> DataFrame:
    """docs with further columns computed from its text column in one pass, without a shuffle.

    columns: (name, DDL type) of what rows returns. Names must not be in docs: callers begin them with
    private(docs).
    """
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in columns)])
    return docs.mapInArrow(adding_columns(rows, text, done), schema)
