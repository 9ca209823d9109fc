"""Document structure: subtrees, unique targets, findings, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import durable


def subtree(nodes: DataFrame) -> DataFrame:
    """(root, id, depth): every node with all nodes below it, itself at depth 0.

    nodes: id, parent_id, in any order. One join per level that the tree has; each level is cut off
    from the plan of those above. A level at which a node comes below itself means that the parents
    run in a circle, which raises.
    """
    children = nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("id")).where("id is not null")
    level = durable(nodes.select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("depth")))
    found = level
    while True:
        level = durable(level.join(children, "id").select("root", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth")))
        if level.where("root = id").limit(1).count():
            raise ValueError("a node is below itself")
        if not level.limit(1).count():
            return found
        found = found.unionByName(level)


def bare_label(label: Column) -> Column:
    """A list label without its opening bracket and its closing bracket or stop."""
    return F.regexp_replace(F.regexp_replace(label, "^\\(", ""), "[.)]+$", "")


def item_ends(items: DataFrame, group: str, last: str) -> DataFrame:
    """items with item_end: the least begin of the group that is after their own, else the group's end.

    The different begins are dealt by range, so that a group of any size is many tasks; each range is
    one sorted pass of a window, and its last begin takes the first one of the group's next range, one
    row per group and range. A null group is a group; an item without a begin has none after it.
    """
    begins = items.select(F.col(group).alias("_group"), F.col("start").alias("_start")).where("start is not null").distinct()
    dealt = durable(begins.repartitionByRange("_group", "_start").withColumn("_part", F.spark_partition_id()))
    firsts = dealt.groupBy("_group", "_part").agg(F.min("_start").alias("_first"))
    firsts = firsts.select("_group", "_part", F.lead("_first").over(Window.partitionBy("_group").orderBy("_part")).alias("_after"))
    following = F.lead("_start").over(Window.partitionBy("_group", "_part").orderBy("_start"))
    ends = dealt.select("_group", "_part", "_start", following.alias("_next")).join(firsts.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_after"), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    ends = ends.select("_group", "_start", F.coalesce("_next", "_after").alias("_end"))
    found = items.join(ends, F.col(group).eqNullSafe(F.col("_group")) & (F.col("start") == F.col("_start")), "left")
    return found.withColumn("item_end", F.coalesce("_end", F.col(last))).select(*items.columns, "item_end")


def unique_targets(targets: DataFrame, nodes: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, value, status, node_id): the one node whose label or alias is the value.

    targets: document, value. nodes: document, node_id, label, aliases. missing and ambiguous are told
    apart.
    """
    names = F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))))
    named = nodes.select(document, "node_id", names.alias("value")).where("value is not null")
    hits = targets.select(document, "value").join(named, [document, "value"], "left").groupBy(document, "value")
    counted = hits.agg(F.count("node_id").alias("n"), F.min("node_id").alias("_one"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return counted.select(document, "value", status.alias("status"), F.when(F.col("n") == 1, F.col("_one")).alias("node_id"))


#: Characters of a stretch in which lines and ranges meet.
STRETCH = 1024


def overlapping(lines: DataFrame, ranges: DataFrame, document: str = "doc_id", stretch: int = STRETCH) -> DataFrame:
    """Non-blank lines that overlap a range of their document, each pair once.

    ranges: document, range_id, start, end. A line and a range stand in each stretch of positions that
    they reach, and meet by document and stretch; a pair counts in the stretch in which the later of
    the two begins. So a document of many lines and ranges is many keys, and a line is compared with
    the ranges near it only. A line that only touches a range doesn't overlap it.
    """

    def reached(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / stretch), F.floor(F.greatest(start, end - 1) / stretch)))

    r = ranges.select(F.col(document).alias("_document"), "range_id", F.col("start").cast("long").alias("_from"), F.col("end").cast("long").alias("_to"))
    r = r.withColumn("_there", reached(F.col("_from"), F.col("_to")))
    dealt = lines.where("trim(line) <> ''").withColumn("_here", reached(F.col("start"), F.col("end")))
    once = F.floor(F.greatest(F.col("start"), F.col("_from")) / stretch) == F.col("_here")
    meets = (F.col(document) == F.col("_document")) & (F.col("_here") == F.col("_there")) & (F.col("end") > F.col("_from")) & (F.col("start") < F.col("_to"))
    return dealt.join(r, meets & once).drop("_document", "_from", "_to", "_here", "_there")


def fragments(lines: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, range_id, page, first_line, n_lines, start, end): a finding's lines by page."""
    return lines.groupBy(document, "range_id", "page").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.min("start").alias("start"), F.max("end").alias("end"))


def excerpt(text: Column, most: int = 2000) -> Column:
    """The first so many UTF-16 units without white space at the ends of the text."""
    return T.utf16_prefix(F.btrim(text, F.lit(T.SPACES)), most)


def finding_status(found: Column, targets: Column, by_name: Column) -> Column:
    """What the state of a record with a document says. by_name: its file was matched by name only."""
    located = F.concat(found.cast("string"), F.lit(" of "), targets.cast("string"), F.lit(" requested passages located"), F.when(found < targets, F.lit(" · review needed")).otherwise(F.lit("")))
    return F.when(by_name, "Matched by filename; check the PDF in Review").when(targets > 0, located).otherwise("PDF ready · add highlights in review")
