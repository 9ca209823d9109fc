"""What a reviewer sees: states, progress, page bindings, marks of targets, pages still to be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up


def opening_pages(pages: DataFrame, page: str = "page", most: int = 2) -> DataFrame:
    """Only the first pages; the predicate is on the page's number, so it reaches the scan."""
    return pages.where(F.col(page) <= most)


def page_lookup(targets: DataFrame, bindings: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, label, first_index, indices): the PDF pages that bear a printed label; the first is
    used, all are told."""
    met = targets.select(document, "label").distinct().join(bindings.select(document, "label", "page_index"), [document, "label"], "left")
    grouped = met.groupBy(document, "label").agg(F.array_sort(F.collect_set("page_index")).alias("i"))
    return grouped.select(document, "label", F.get("i", F.lit(0)).alias("first_index"), F.array_join(F.col("i").cast("array<string>"), ",").alias("indices"))


def printed_pages(pages: DataFrame, document: str = "doc_id") -> DataFrame:
    """pages (document, page_index, label or null) with the printed label that each page must have:
    its own, else counted on from the last one before it, else back from the first one after it."""
    order = Window.partitionBy(document).orderBy("page_index")
    here = F.when(F.col("label").isNotNull(), F.struct("page_index", "label"))
    back = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(here, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    nearest = F.coalesce(back, ahead)
    return pages.withColumn("printed", nearest["label"] + F.col("page_index") - nearest["page_index"])


def marked_targets(targets: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """targets with the first mark of their label, null without one."""
    first = marks.groupBy(*keys).agg(F.min_by("mark_id", "seq").alias("mark_id"))
    return targets.join(first, list(keys), "left")


def record_state(working: Column, document: Column, failed: Column) -> Column:
    """The label of a record in the list: what is being done, then what is there, then what went wrong."""
    return F.when(working, "Fetching").when(document, "PDF ready").when(failed, "Needs PDF").otherwise("No PDF yet")


def progress(done: Column, expected: Column) -> Column:
    """A percentage where the size is known, else megabytes with one decimal."""
    share = F.least(F.lit(100), round_half_up(100 * done / expected)).cast("long").cast("string")
    size = F.format_string("%.1f", F.floor(done / 100000.0 + 0.5) / 10)
    return F.when(expected > 0, F.concat(share, F.lit(" %"))).otherwise(F.concat(size, F.lit(" MB")))


def intact(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """(key, intact) for all that the manifest lists: the file is there, with its size and digest."""
    m = manifest.select(key, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    return m.join(files.select(key, "bytes", "sha256"), key, "left").select(key, F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha256")), F.lit(False)).alias("intact"))


def inked(pixels: DataFrame, page: str, dark: int = 630, more_than: int = 12) -> DataFrame:
    """(page, inked): whether over so many pixels have channels that sum up to less than dark."""
    return pixels.groupBy(page).agg((F.count_if(F.col("r") + F.col("g") + F.col("b") < dark) > more_than).alias("inked"))


def missing_pages(asked: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of pages that are asked for and not kept."""
    return asked.join(cached.select(*keys), list(keys), "left_anti")


def pages_to_read(asked: DataFrame, cached: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The pages that are asked for and not kept, numbered in the order they are read."""
    missing = missing_pages(asked, cached, keys)
    return missing.withColumn("turn", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)).cast("long"))


def extras(found: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key that isn't known already."""
    fresh = found.join(known.select(key).distinct(), key, "left_anti")
    others = [c for c in found.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def queue_counts(queue: DataFrame, source: str) -> DataFrame:
    """(source, running, queued, next_wait): what of each source runs and waits, and the least wait."""
    return queue.groupBy(source).agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "queued").alias("queued"), F.min(F.when(F.col("state") == "queued", F.col("wait"))).alias("next_wait"))
