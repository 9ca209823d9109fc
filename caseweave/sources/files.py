"""Files as rows: alias tables, binary files, word-processor documents, SQLite tables, PDF admission."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.web import is_pdf

MAX_PDF, MAX_DOCX = 100 << 20, 100_000_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def alias_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, key, target) of a tab-separated table; blank lines and # comments are no rows.

    line_no orders the lines of a file; with several files, a later name counts as later."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = lines.where("trim(value) <> '' and not startswith(value, '#')").withColumn("parts", F.split("value", "\t"))
    rows = rows.where(F.size("parts") >= 2).select(F.trim(F.col("parts")[0]).alias("key"), F.trim(F.col("parts")[1]).alias("target"), "file", "block", "id")
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("key").orderBy("file", "block", "id")).cast("long")).select("line_no", "key", "target")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, modified, admitted) of the .pdf files directly in a folder: at most MAX_PDF
    bytes, with the magic at the begin and the end mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "false").load(folder)
    fits = F.col("length") <= MAX_PDF
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), (fits & is_pdf(F.col("content"))).alias("admitted"))


def docx_units(content: bytes) -> list[dict]:
    """The paragraphs of the body and the footnotes of a word-processor file, in order."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for kind, name, container in (("body", "word/document.xml", None), ("footnote", "word/footnotes.xml", f"{WORD}footnote")):
            if name not in archive.namelist():
                continue
            root = ElementTree.fromstring(archive.read(name))
            for n, unit in enumerate(root.iter(container) if container else root.iter(f"{WORD}p")):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in (unit.iter(f"{WORD}p") if container else [unit]))
                if text.strip():
                    out.append({"unit_id": f"{kind}:{n}", "kind": kind, "text": text})
    return out


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, unit_id, kind, text) of word-processor files; a file over MAX_DOCX is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    sound = files.withColumn("content", F.when(F.col("length") > MAX_DOCX, F.raise_error(F.lit("the file is too large"))).otherwise(F.col("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([u | {"path": at} for u in docx_units(content)], columns=["path", "unit_id", "kind", "text"])

    return sound.select("path", "content").mapInPandas(run, "path string, unit_id string, kind string, text string")


class SqliteSource(DataSource):
    """spark.read.format("sqlite_readonly").option("path", ...).option("table", ...): a table of a
    SQLite file that is opened immutable, in ranges of rowid. A file with views is refused."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_readonly"

    def connection(self) -> sqlite3.Connection:
        found = sqlite3.connect(f"file:{quote(self.options['path'])}?mode=ro&immutable=1", uri=True)
        if found.execute("SELECT 1 FROM sqlite_master WHERE type = 'view' LIMIT 1").fetchone():
            raise ValueError("a store with views isn't opened")
        return found

    def table(self) -> str:
        return '"' + self.options["table"].replace('"', '""') + '"'

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        rows = self.connection().execute(f"PRAGMA table_info({self.table()})").fetchall()
        if not rows:
            raise ValueError("there is no such table")
        return T.StructType([T.StructField(r[1], kinds.get(r[2].upper(), T.StringType())) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self)


class SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        low, high = self.source.connection().execute(f"SELECT min(rowid), max(rowid) FROM {self.source.table()}").fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(high - low + 1) // int(self.source.options.get("numPartitions", "8"))))
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.connection().execute(f"SELECT * FROM {self.source.table()} WHERE rowid BETWEEN ? AND ?", partition.value)


def sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_readonly").option("path", path).option("table", table).load()
