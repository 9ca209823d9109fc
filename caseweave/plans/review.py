"""Queries of the reviewer's view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, review
from ..sources.tables import table
from .orders import MADE, instructions
from .registry import Registry

query = Registry()


@query("""WITH n AS (SELECT o_custkey, o_orderkey, ['z', chr(65535), chr(128512), 'é', '', 'Z'][o_orderkey % 6 + 1] AS mark FROM orders)
SELECT o_custkey, string_agg(mark, '' ORDER BY CASE WHEN mark = chr(128512) THEN 'd83dde00' WHEN mark = '' THEN '' ELSE lpad(printf('%x', ord(mark)), 4, '0') END, o_orderkey) AS marks FROM n GROUP BY o_custkey""")
def utf16_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of each customer by UTF-16 units: a character above U+FFFF comes before U+FFFF."""
    mark = F.get(F.array(*[F.lit(x) for x in ("z", "\uffff", "\U0001f600", "é", "", "Z")]), (F.col("o_orderkey") % 6).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct(T.utf16_order(mark).alias("order"), "o_orderkey", mark.alias("mark")).alias("m"))
    return rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("m")).alias("m")).select("o_custkey", F.array_join("m.mark", "").alias("marks"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 2""")
def opening_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.opening_pages(table(spark, sf_dir, "lineitem"), "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_index, CAST(l_quantity AS BIGINT) % 5 AS label FROM lineitem),
t AS (SELECT DISTINCT doc_id, v AS label FROM (SELECT o_orderkey AS doc_id, unnest([0, 3]) AS v FROM orders)),
m AS (SELECT DISTINCT t.doc_id, t.label, page_index FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.label = t.label)
SELECT doc_id, CAST(label AS BIGINT) AS label, min(page_index) AS first_index, coalesce(string_agg(CAST(page_index AS VARCHAR), ',' ORDER BY page_index), '') AS indices FROM m GROUP BY doc_id, label""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"), (F.col("l_quantity").cast("long") % 5).alias("label"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(3)).cast("array<long>")).alias("label"))
    return review.page_lookup(targets, bindings)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS i, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN l_orderkey % 500 + l_linenumber END AS label FROM lineitem),
x AS (SELECT *, last_value(CASE WHEN label IS NOT NULL THEN label - i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
  first_value(CASE WHEN label IS NOT NULL THEN label - i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM p)
SELECT doc_id, i AS page_index, CAST(coalesce(back, ahead) + i AS BIGINT) AS printed FROM x""")
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    pages = table(spark, sf_dir, "lineitem").select(k.alias("doc_id"), i.alias("page_index"), F.when((k + i) % 3 == 0, k % 500 + i).alias("label")).distinct()
    return review.printed_pages(pages).select("doc_id", "page_index", "printed")


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS label, arg_min(o_orderkey, o_totalprice) AS mark_id FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT o_orderkey, m.mark_id FROM orders o LEFT JOIN m ON m.o_custkey = o.o_custkey AND m.label = o.o_orderpriority""")
def marked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "label")
    marks = orders.where("o_orderstatus <> 'P'").select("o_custkey", "label", F.col("o_orderkey").alias("mark_id"), F.col("o_totalprice").alias("seq"))
    return review.marked_targets(orders.select("o_orderkey", "o_custkey", "label"), marks, ["o_custkey", "label"]).select("o_orderkey", "mark_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Fetching' WHEN o_orderstatus = 'F' THEN 'PDF ready' WHEN o_orderkey % 7 = 0 THEN 'Needs PDF' ELSE 'No PDF yet' END AS state FROM orders""")
def record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = review.record_state(k % 11 == 0, F.col("o_orderstatus") == "F", k % 7 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(least(100, floor(100.0 * (event_id * 7919 % 5000000) / (event_id % 3 * 2000000) + 0.5)) AS BIGINT) || ' %' ELSE printf('%.1f', floor((event_id * 7919 % 5000000) / 100000.0 + 0.5) / 10) || ' MB' END AS progress FROM events""")
def progress_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", review.progress(k * 7919 % 5000000, k % 3 * 2000000).alias("progress"))


@query("""WITH f AS (SELECT doc_id AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha FROM documents)
SELECT path, path % 10 <> 3 AND path % 10 <> 4 AND path % 10 <> 5 AS intact FROM f""")
def asset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    tail = F.col("path") % 10
    found = there.where(tail != 3).withColumn("bytes", F.col("bytes") + F.when(tail == 4, 1).otherwise(0)).withColumn("sha256", F.when(tail == 5, F.lit("other")).otherwise(F.col("sha256")))
    return review.intact(found, there)


@query("""SELECT l_suppkey AS page, count(*) FILTER (WHERE l_quantity * 5 + l_discount * 2000 + l_tax * 2000 < 200) > 12 AS inked FROM lineitem GROUP BY l_suppkey""")
def inked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2000).alias("g"), (F.col("l_tax") * 2000).alias("b"))
    return review.inked(pixels, "page", dark=200)


@query("""WITH a AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderkey % 4 AS priority FROM orders), c AS (SELECT o_custkey AS doc, o_orderkey AS page FROM orders WHERE o_orderkey % 5 = 1)
SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY priority DESC, page) AS turn FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = a.doc AND c.page = a.page)""")
def pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 4).alias("priority"))
    return review.pages_to_read(asked, asked.where("page % 5 = 1"), ["doc", "page"], [F.desc("priority"), F.col("page")]).select("doc", "page", "turn")


@query(f"""WITH {MADE} SELECT key, arg_min(o_custkey, doc_id) AS o_custkey, min(doc_id) AS doc_id FROM made WHERE doc_id % 3 <> 0 AND key NOT IN (SELECT key FROM made WHERE doc_id % 3 = 0) GROUP BY key""")
def folder_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = instructions(spark, sf_dir).select("key", "o_custkey", "doc_id")
    return review.extras(made.where("doc_id % 3 <> 0"), made.where("doc_id % 3 = 0"), "key", "doc_id")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS running, count(*) FILTER (WHERE event_type <> 'view') AS queued, min(event_id % 1000) FILTER (WHERE event_type <> 'view') AS next_wait FROM events GROUP BY user_id""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", "running").otherwise("queued").alias("state"), (F.col("event_id") % 1000).alias("wait"))
    return review.queue_counts(rows, "user_id")


@query("""SELECT DISTINCT o_custkey, o_orderkey % 900 + 1 AS page FROM orders""")
def reporter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start pages that reporters give, by the grammar, over texts made from columns."""
    text = F.concat(F.lit("["), F.year("o_orderdate").cast("string"), F.lit("] 3 SCR "), (F.col("o_orderkey") % 900 + 1).cast("string"))
    found = citations.extract(table(spark, sf_dir, "orders").select("o_custkey", text.alias("text")), "o_custkey")
    return found.select("o_custkey", F.regexp_extract("key", "SCR (\\d+)$", 1).cast("long").alias("page")).distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Page ' ELSE 'Para ' END || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' · item ' || chr(CAST(97 + o_orderkey % 5 AS INT)) ELSE '' END AS label FROM orders""")
def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = F.when(k % 3 == 0, F.char(97 + k % 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.target_label(F.when(k % 2 == 0, "page").otherwise("paragraph"), F.col("o_custkey").cast("string"), item).alias("label"))


QUERIES, ORACLES = query.queries, query.oracles
