"""Tables of one run in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_folders: list[str] = []


@atexit.register
def sweep() -> None:
    """Delete the folders that scratch_folder named for this driver process, with what stands beside
    them under the same name (a stream's state)."""
    while _folders:
        path = _folders.pop()
        for each in (path, f"{path}-state"):
            with contextlib.suppress(OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
                store, folder = pafs.FileSystem.from_uri(each)
                if store.get_file_info(folder).type == pafs.FileType.Directory:
                    store.delete_dir(folder)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and there is one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="caseweave-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one, which goes when the driver process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for wide rows that are read more than once."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
