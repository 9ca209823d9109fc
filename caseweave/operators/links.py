"""Hyperlinks to be written into a document's units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import first_filled
from ..sources.scratch import durable, stored
from .citations import address, anchor
from .folds import TARGET, Disjoint, sorted_pass


#: What a pass says of a span in a stretch of positions: kept before, overlaps a kept one, overlaps
#: no earlier one that is open, overlaps one.
KNOWN, BLOCKED, FREE, OPEN = range(4)


def without_overlaps(spans: DataFrame, key: str, order: str = "seq", target: int = TARGET) -> DataFrame:
    """The spans that overlap no earlier one that was kept, per key: first come, first written.

    A span that is turned down blocks no other, so each depends on all before it. Keys of at most
    `target` spans are one sorted pass each, with what is kept in a sorted list. Where a key has more,
    its positions are cut into stretches of about so many spans, and of eight times their mean length
    at least; a span stands in each stretch that it reaches. Per round and stretch, in a pass of its
    own, a span is decided if no earlier one that is open overlaps it there, which settles chains
    within a stretch at once; one that reaches several stretches is kept if it is free in all of them
    and blocked if it is in any. What is left, with the spans kept last that cross a border, goes into
    the next round; the earliest open span is decided in every round.

    Spans without a begin or end, or that end before they begin, overlap nothing and are kept. Equal
    orders are broken by begin and end. Columns besides key, order, start and end are dropped; order may
    be of any type that has an order, a struct too.
    """
    named = spans.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    sound = F.coalesce(F.col("start") <= F.col("end"), F.lit(False))
    rows, odd = named.where(sound), named.where(~sound)
    largest = rows.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
    kept = first_come(rows) if largest <= target else first_come_in_rounds(rows, target)
    return kept.unionByName(odd).select(F.col("_key").alias(key), F.col("_order").alias(order), "start", "end")


def first_come(rows: DataFrame) -> DataFrame:
    """The fold of without_overlaps, a pass per key."""

    def step(kept: Disjoint, row: tuple) -> list[tuple]:
        _, order, start, end = row
        if kept.meets(start, end):
            return []
        kept.add(start, end)
        return [(order, start, end)]

    return sorted_pass(rows, ["_key"], ["_order", "start", "end"], rows.schema, Disjoint, step)


def first_come_in_rounds(rows: DataFrame, target: int) -> DataFrame:
    """The same, with the positions of each key cut into stretches and decided in rounds."""
    # of equal spans only the first can be kept; empty ones don't overlap each other
    once = rows.where("start < end").groupBy("_key", "start", "end").agg(F.min("_order").alias("_order"))
    once = once.unionByName(rows.where("start = end"))
    once = durable(once.select(F.monotonically_increasing_id().alias("_id"), "_key", "_order", "start", "end"))
    size = once.groupBy(F.col("_key").alias("_k")).agg(F.count("*").alias("_n"), F.min("start").alias("_low"), F.max("end").alias("_high"), F.avg(F.col("end") - F.col("start")).alias("_mean"))
    width = F.greatest(F.lit(1.0), F.ceil(8 * F.col("_mean")), F.ceil((F.col("_high") - F.col("_low") + 1) * F.lit(target) / F.col("_n"))).cast("long")
    first = F.floor((F.col("start") - F.col("_low")) / F.col("_width"))
    last = F.floor((F.greatest(F.col("start"), F.col("end") - 1) - F.col("_low")) / F.col("_width"))
    placed = once.join(size.withColumn("_width", width), F.col("_key").eqNullSafe(F.col("_k"))).select("_id", "_key", "_order", "start", "end", first.alias("_first"), last.alias("_last"), F.lit(False).alias("_known"))
    columns, kept = placed.columns, []

    def judge(state: tuple[Disjoint, Disjoint], row: tuple) -> list[tuple]:
        decided, waiting = state
        start, end, first, last, known = row[4:]
        if known:
            decided.add(start, end)
            return [(*row[2:], KNOWN)]
        if decided.meets(start, end):
            return [(*row[2:], BLOCKED)]
        waits = waiting.meets(start, end)
        if waits or first < last:
            waiting.cover(start, end)
        else:
            decided.add(start, end)
        return [(*row[2:], OPEN if waits else FREE)]

    while True:
        dealt = placed.withColumn("_stretch", F.explode(F.sequence("_first", "_last"))).select("_key", "_stretch", "_id", "_order", "start", "end", "_first", "_last", "_known")
        marked = sorted_pass(dealt, ["_key", "_stretch"], ["_order", "start", "end", "_id"], StructType([*dealt.schema.fields, StructField("_said", IntegerType())]), lambda: (Disjoint(), Disjoint()), judge)
        said = marked.groupBy(*columns).agg(F.max(F.col("_said") == BLOCKED).alias("_blocked"), F.max("_said").alias("_most"))
        said = durable(said.where(~F.col("_known") & ~F.col("_blocked")))
        free = said.where(F.col("_most") == FREE)
        kept.append(free.select(*rows.columns))
        left = said.where(F.col("_most") == OPEN)
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, kept)
        known = free.where("_first < _last").withColumn("_known", F.lit(True))
        placed = left.unionByName(known).select(*columns)


def rebased(occurrences: DataFrame, parts: Column) -> DataFrame:
    """One row per linked part of a pinpoint: absolute begin and end from the pinpoint's own begin.

    occurrences: occ_id, pinpoints (array with start); parts: array of (pinpoint, start, end), the
    first an index into pinpoints and the others relative to it.
    """
    rows = occurrences.select("occ_id", "pinpoints", F.posexplode(parts).alias("part_no", "p"))
    base = F.get("pinpoints", F.col("p.pinpoint"))["start"]
    return rows.select("occ_id", "part_no", (base + F.col("p.start")).cast("long").alias("start"), (base + F.col("p.end")).cast("long").alias("end")).where("start is not null")


def planned(units: DataFrame, found: DataFrame, sources: DataFrame | None = None, body: bool = False, whole_pinpoint: bool = False) -> DataFrame:
    """(unit_id, seq, n, start, end, expected, url): the links of a document, none over another. seq is
    the citation's, n counts its links.

    units: unit_id, kind, text; found: citations.extract over them by unit_id. Footnotes only unless
    body. A citation links to its authority's page: an explicit source of its key if there is one
    (sources: key, link), else the address made from its key. Each number of a pinpoint links to its
    own place, or the whole pinpoint to its first one.
    """
    wanted = units.where(F.lit(body) | (F.col("kind") == "footnote")).select("unit_id", F.col("text").alias("unit_text"))
    rows = found.join(wanted, "unit_id")
    if sources is not None:
        rows = rows.join(sources.select("key", "link"), "key", "left")
    else:
        rows = rows.withColumn("link", F.lit(None).cast("string"))
    rows = rows.withColumn("page", first_filled(F.col("link"), address(F.col("key"))))
    whole = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("page").alias("url"))
    def one(p):
        ends = [p["first"], p["last"]] if not whole_pinpoint else [p["first"]]
        first = F.struct(p["start"].alias("start"), (p["end"] if whole_pinpoint else p["start"] + F.length(p["first"])).alias("end"), F.concat(F.col("page"), anchor(p["kind"], p["first"])).alias("url"))
        if len(ends) == 1:
            return F.array(first)
        last = F.struct((p["end"] - F.length(p["last"])).alias("start"), p["end"].alias("end"), F.concat(F.col("page"), anchor(p["kind"], p["last"])).alias("url"))
        return F.when(p["last"].isNull(), F.array(first)).otherwise(F.array(first, last))

    # a citation without a page has no links; as a filter this would compute the page again
    spans = F.when(F.col("page").isNotNull(), F.concat(F.array(whole), F.flatten(F.transform("pinpoints", one))))
    flat = rows.select("unit_id", "unit_text", "seq", F.posexplode(spans).alias("n", "s")).select("unit_id", "unit_text", F.struct("seq", "n").alias("place"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.url")
    near = Window.partitionBy("unit_id").orderBy("start", "end")
    reached = F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1))
    alone = F.coalesce(F.col("start") >= reached, F.lit(True)) & F.coalesce(F.lead("start").over(near) >= F.col("end"), F.lit(True)) & (F.col("start") <= F.col("end"))
    expected = F.expr("substring(unit_text, int(start) + 1, int(`end` - start))")
    flat = stored(flat.select("unit_id", "place", "start", "end", expected.alias("expected"), "url", alone.alias("_alone")), "planned")
    met = flat.where("not _alone").drop("_alone")
    kept = without_overlaps(met, "unit_id", "place").join(met, ["unit_id", "place", "start", "end"])
    out = flat.where("_alone").drop("_alone").unionByName(kept)
    return out.select("unit_id", "place.seq", "place.n", "start", "end", "expected", "url")
