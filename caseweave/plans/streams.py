"""Queries that run a stream over a table until it is read, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stateful
from ..sources import sinks
from ..sources.scratch import scratch_folder
from ..sources.tables import table
from ..streaming import state
from .registry import Registry

query = Registry()


@query("""SELECT DISTINCT 'f' || user_id AS name, event_id % 5 AS size, user_id * 1000 AS mtime_us FROM events""")
def stream_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as sightings of files, read as a stream; what is new goes to a table."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    files = rows.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name"), (F.col("event_id") % 5).alias("size"), (F.col("user_id") * 1000).alias("mtime_us"), F.lit(1).alias("choice"))
    target = scratch_folder(spark, "seen")
    running = state.unseen(files, ttl_ms=0, buckets=16).writeStream.format("parquet").option("checkpointLocation", target + "-state").outputMode("append").trigger(availableNow=True).start(target)
    running.awaitTermination()
    return spark.read.schema(files.drop("choice").schema).parquet(target)


def in_parts(spark: SparkSession, sf_dir: str, parts: int = 3) -> list[DataFrame]:
    """The events in their order, as so many parts that come one after the other."""
    events = table(spark, sf_dir, "events")
    edges = events.agg(F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("e")).first().e
    return [events.where((F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high)) for low, high in zip([None, *edges], [*edges, None])]


def collected(parts: list[DataFrame], operator: Callable[[DataFrame], DataFrame], name: str, mode: str) -> DataFrame:
    """What a stream puts out over all its triggers, with the batch's number, as a table. Each part is
    written by its tasks when the one before is read, and then read in a trigger of its own: the stream
    is started again from its state."""
    spark = parts[0].sparkSession
    folder, target = scratch_folder(spark, "parts"), scratch_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/{number:06d}")

    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/{i}")
        stream = operator(spark.readStream.schema(part.schema).parquet(f"{folder}/*"))
        running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", target + "-state").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(f"{target}/*")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, from a stream in three triggers that puts out what changes."""
    parts = [p.select("user_id", "event_type", "ts", "event_id", "value") for p in in_parts(spark, sf_dir)]
    found = collected(parts, lambda rows: state.latest(rows, "user_id", "event_type", ["ts", "event_id"], idle_ms=0), "latest", "update")
    return stateful.latest(found, ["user_id", "event_type"], ["batch"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH e AS (SELECT *, event_id % 3 AS run FROM events)
SELECT event_id, user_id, run, coalesce(
  first_value(CASE WHEN event_type = 'error' THEN 'blocked at ' || event_id END IGNORE NULLS) OVER w, CASE WHEN event_type = 'error' THEN 'blocked at ' || event_id END, 'ok') AS outcome,
  first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w IS NOT NULL AS skipped
FROM e WINDOW w AS (PARTITION BY run, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of three runs at users as origins, of which errors block, from a stream in three triggers."""
    parts = [p.select("event_id", "user_id", "event_type", "ts", (F.col("event_id") % 3).alias("run")) for p in in_parts(spark, sf_dir)]
    message = F.concat(F.lit("blocked at "), F.col("event_id").cast("string"))
    found = collected(parts, lambda rows: state.after_block(rows, "run", "user_id", ["ts", "event_id"], F.col("event_type") == "error", message, ttl_ms=0), "breaker", "append")
    return found.select("event_id", "user_id", "run", "outcome", "skipped")


@query()
def crc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    files = docs.select("source", F.format_string("%08d.txt", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return sinks.archives(files, "source", most=4 << 20).select("source", "part", F.octet_length("archive").cast("long").alias("bytes"), "crc")


@query("""SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


QUERIES, ORACLES = query.queries, query.oracles
