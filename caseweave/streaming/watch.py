"""A watched folder as a stream: a file is new if its name, size or time is."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "name string, size long, mtime_us long, choice long"


class FolderSource(DataSource):
    """spark.readStream.format("watched_folder").option("path", ...): the PDF files of a folder, all
    that are there at each trigger. Options: suffix; choice, a number that grows when the folder is
    chosen anew; depth, 0 for the files directly in it, 1 for those of its folders too."""

    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(self.options["path"], self.options.get("suffix", ".pdf"), int(self.options.get("choice", 0)), int(self.options.get("depth", 0)))


@dataclass
class Listing(InputPartition):
    """A folder below the watched one, or that itself, whose files one task lists."""

    folder: str


class FolderReader(DataSourceStreamReader):
    """The offset is a version, a number whatever the folder holds. Files are listed by the tasks, one
    per folder, while they read them; what was seen before is for state.unseen to know. A batch that is
    repeated lists what is there by then, and what it lists is seen with it. A file that can't be read
    isn't listed and comes with a later batch."""

    def __init__(self, path: str, suffix: str, choice: int, depth: int):
        self.path, self.suffix, self.choice, self.depth, self.version = path, suffix, choice, depth, 0

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        self.version = max(self.version + 1, time.time_ns() // 1_000_000)
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        below = sorted(e.name for e in os.scandir(self.path) if e.is_dir()) if self.depth else []
        return [Listing(""), *map(Listing, below)]

    def read(self, partition: Listing) -> Iterator[tuple]:
        at = os.path.join(self.path, partition.folder) if partition.folder else self.path
        with os.scandir(at) as entries:
            for entry in entries:
                try:
                    if entry.name.lower().endswith(self.suffix) and entry.is_file():
                        stat = entry.stat()
                        yield f"{partition.folder}/{entry.name}".lstrip("/"), stat.st_size, stat.st_mtime_ns // 1000, self.choice
                except OSError:
                    continue


def watched(spark: SparkSession, path: str, suffix: str = ".pdf", choice: int = 0, depth: int = 0) -> DataFrame:
    """(name, size, mtime_us, choice) of a folder's files at each trigger: see FolderSource."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("watched_folder").options(path=path, suffix=suffix, choice=choice, depth=depth).load()


def closed_sessions(requests: DataFrame, idle_seconds: int = 150) -> DataFrame:
    """(session, first, last, n) of sessions whose last request is over idle_seconds behind the watermark.

    requests: session, ts (event time with a watermark)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "first": [pd.Timestamp(first, unit="us")], "last": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        times = sorted(int(t.value // 1000) for batch in batches for t in batch["ts"])
        out, now = [], state.get if state.exists else None
        for t in times:
            if now and t - now[1] > idle_seconds * 1_000_000:
                out.append((key[0], pd.Timestamp(now[0], unit="us"), pd.Timestamp(now[1], unit="us"), now[2]))
                now = None
            now = (min(now[0], t), max(now[1], t), now[2] + 1) if now else (t, t, 1)
        state.update(now)
        state.setTimeoutTimestamp(max(now[1] // 1000 + idle_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session", "first", "last", "n"])

    return requests.groupBy("session").applyInPandasWithState(step, "session string, first timestamp, last timestamp, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def answers_to(requests: DataFrame, responses: DataFrame, limit: str = "120 seconds") -> DataFrame:
    """Requests and responses of one id within the limit: a stream-stream join with bounded state.

    Both sides have a watermark on ts."""
    r = responses.select(F.col("id").alias("_id"), F.col("ts").alias("answered_at"), "body")
    within = (F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= F.col("ts") + F.expr(f"interval {limit}"))
    return requests.join(r, (F.col("id") == F.col("_id")) & within).drop("_id")
