"""A sink for planned hyperlinks: each is written where the unit still has the expected words."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SUMMARY = "_links.json"


@dataclass
class Part(WriterCommitMessage):
    """What a task reports: the files it wrote, and how many links it wrote and refused."""

    names: list[str] = field(default_factory=list)
    written: int = 0
    refused: int = 0


class LinkWriter(DataSourceArrowWriter):
    """One Parquet file per task with a column `written`; the commit lists the files of the tasks that
    succeeded and sums their counts, so an attempt that is lost or runs twice counts once."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = self.store()
        store.create_dir(root, recursive=True)
        part, out, name = Part(), None, f"{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            same = pc.fill_null(pc.equal(batch.column("expected"), batch.column("found")), False)
            rows = pa.Table.from_batches([batch]).append_column("written", same)
            if out is None:
                out = pq.ParquetWriter(store.open_output_stream(f"{root}/{name}"), rows.schema)
                part.names.append(name)
            out.write_table(rows)
            written = pc.sum(same).as_py() or 0
            part.written += written
            part.refused += batch.num_rows - written
        if out:
            out.close()
        return part

    def listed(self) -> dict:
        store, root = self.store()
        if store.get_file_info(f"{root}/{SUMMARY}").type != pafs.FileType.File:
            return {"files": [], "written": 0, "refused": 0}
        with store.open_input_stream(f"{root}/{SUMMARY}") as source:
            return json.loads(source.read())

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        before = self.listed()
        total = {"files": [], "written": 0, "refused": 0} if self.overwrite else dict(before)
        total["files"] = total["files"] + [n for p in parts for n in p.names]
        total["written"] += sum(p.written for p in parts)
        total["refused"] += sum(p.refused for p in parts)
        store, root = self.store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{SUMMARY}.new") as out:
            out.write(json.dumps(total).encode())
        store.move(f"{root}/{SUMMARY}.new", f"{root}/{SUMMARY}")
        for name in before["files"] if self.overwrite else []:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = self.store()
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{root}/{name}")


class LinkSink(DataSource):
    """df.write.format("linked_units").option("path", folder): rows with expected and found."""

    @classmethod
    def name(cls) -> str:
        return "linked_units"

    def writer(self, schema: StructType, overwrite: bool) -> LinkWriter:
        missing = {"expected", "found"} - set(schema.names)
        if missing or "written" in schema.names:
            raise ValueError("links need expected and found, and get written")
        return LinkWriter(self.options["path"], overwrite)


def write_links(planned: DataFrame, units: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Write planned links (of links.planned) into units (unit_id, text); how many were written and refused.

    Where the unit's text at a link's place isn't the expected one any more, the link is refused and
    stays in the table with written false; so it is where the unit is gone. Only the words at the place
    travel to the writers, and not a long unit once per link. path: a folder that driver and executors
    share, in which files count once the commit has listed them.
    """
    spark = planned.sparkSession
    spark.dataSource.register(LinkSink)
    texts = units.select(F.col("unit_id").alias("_unit"), F.col("text").alias("_text"))
    found = F.expr("substring(_text, int(start) + 1, int(`end` - start))")
    rows = planned.join(texts, F.col("unit_id").eqNullSafe(F.col("_unit")), "left").withColumn("found", found).select(*planned.columns, "found")
    before = LinkWriter(path, False).listed() if mode == "append" else {"written": 0, "refused": 0}
    rows.write.format("linked_units").option("path", path).mode(mode).save()
    after = LinkWriter(path, False).listed()
    return {k: after[k] - before[k] for k in ("written", "refused")}


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The links of a folder with their flags, from the files that its commits list."""
    files = LinkWriter(path, False).listed()["files"]
    if not files:
        raise ValueError(f"no links in {path}")
    return spark.read.parquet(*[f"{path}/{name}" for name in files])
