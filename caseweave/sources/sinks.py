"""What leaves the engine: marks and links as tables, manifests, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def manifest(files: DataFrame, group: str, path: str = "path", content: str = "content") -> DataFrame:
    """(group, n_files, build_id): the digest of the sorted list of paths, sizes and digests."""
    entry = F.struct(F.col(path).alias("path"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))
    rows = files.select(group, entry.alias("e")).groupBy(group).agg(F.array_sort(F.collect_list("e")).alias("files"))
    return rows.select(group, F.size("files").cast("long").alias("n_files"), F.sha2(F.to_json("files"), 256).alias("build_id"))


def ranged_manifest(files: DataFrame, group: str, key: str, digest: str, size: int = 4096) -> DataFrame:
    """(group, n_files, build_id): a digest in two levels, over the lists of ranges of so many keys and
    then over the list of their digests, so that no list grows with the files of a range's group."""
    listed = lambda a, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))), lambda e: F.concat(e["a"].cast("string"), F.lit(":"), e["b"])), "\n")
    parts = files.groupBy(group, F.floor(F.col(key) / size).alias("part")).agg(F.count("*").alias("n"), F.sha2(listed(key, digest), 256).alias("digest"))
    return parts.groupBy(group).agg(F.sum("n").alias("n_files"), F.sha2(listed("part", "digest"), 256).alias("build_id"))


def archives(files: DataFrame, group: str, most: int = 64 << 20) -> DataFrame:
    """(group, part, archive, crc): each group's files in store-only ZIPs, by name. files: group, name,
    content.

    An archive is one value, so its files meet in one task: a group with more than about `most` bytes
    is dealt over several by a hash of the names.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for name, content in rows.sort_values("name")[["name", "content"]].itertuples(index=False):
                archive.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({group: [rows[group].iloc[0]], "part": [rows["part"].iloc[0]], "archive": [out.getvalue()]})

    parts = files.groupBy(F.col(group).alias("_group")).agg(F.ceil(F.sum(F.octet_length("content")) / most).alias("_parts"))
    dealt = files.join(parts, F.col(group).eqNullSafe(F.col("_group"))).select(group, F.pmod(F.xxhash64("name"), F.greatest("_parts", F.lit(1))).alias("part"), "name", "content")
    built = dealt.groupBy(group, "part").applyInPandas(build, f"{group} {files.schema[group].dataType.simpleString()}, part long, archive binary")
    return built.withColumn("crc", F.crc32("archive"))


def notices(packages: DataFrame, text: str = "license") -> DataFrame:
    """(notices): the licences of the distinct packages, by name, as one text."""
    rows = packages.select("package", text).distinct().agg(F.array_sort(F.collect_list(F.struct("package", text))).alias("p"))
    return rows.select(F.array_join(F.transform("p", lambda p: F.concat(p["package"], F.lit("\n"), p[text])), "\n\n").alias("notices"))
