"""Queries over orders, customers and parts: instructions, records, matches, links, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import text as T
from ..operators import citations, layout, links, resolve, review, stateful, structure
from ..sources import linked
from ..sources.scratch import scratch_folder
from ..sources.tables import table
from .registry import Registry

query = Registry()

# The tables hold no citations; instructions are made from columns, on both sides alike.
MADE = """made AS (
  SELECT o_orderkey AS doc_id, o_custkey, o_orderkey % 40 + 1 AS a, o_orderkey % 40 + 1 + o_custkey % 4 AS b,
    year(o_orderdate) || ' SCC ' || o_custkey AS key FROM orders
)"""


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a = F.col("o_orderkey") % 40 + 1
    key = F.concat(F.year("o_orderdate").cast("string"), F.lit(" SCC "), F.col("o_custkey").cast("string"))
    made = orders.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", a.alias("a"), (a + F.col("o_custkey") % 4).alias("b"), key.alias("key"))
    return made.withColumn("text", F.concat(F.col("key"), F.lit(" at paras "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))


@query(f"""WITH {MADE}, targets AS (SELECT doc_id, key, unnest(range(a, b + 1)) AS v FROM made),
firsts AS (SELECT key, v, min(doc_id * 1000 + v) AS o FROM targets GROUP BY key, v),
t AS (SELECT key, string_agg(CAST(v AS VARCHAR), ',' ORDER BY o) AS targets FROM firsts GROUP BY key)
SELECT m.key AS id, min(doc_id) AS first_doc, count(*) AS mentions, any_value(m.key) AS citation, true AS enabled, any_value(t.targets) AS targets
FROM made m JOIN t ON t.key = m.key GROUP BY m.key""")
def parse_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citations.parse_instructions(instructions(spark, sf_dir).select("doc_id", "text"))
    return found.select("id", F.col("seq.doc_id").alias("first_doc"), "mentions", "citation", "enabled", F.array_join(F.col("targets.value"), ",").alias("targets"))


@query(f"""WITH {MADE} SELECT doc_id, unnest(range(a, b + 1)) AS paragraph FROM made""")
def expand_pinpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = instructions(spark, sf_dir)
    return made.select("doc_id", F.explode(T.expand_locator(F.col("a").cast("string"), F.col("b").cast("string")).cast("array<long>")).alias("paragraph"))


TEXTS = f"""{MADE}, parts AS (
  SELECT o_custkey, doc_id, key, key || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '; ' END AS part FROM made
), texts AS (SELECT o_custkey, string_agg(part, '' ORDER BY doc_id) AS text FROM parts GROUP BY o_custkey),
starts AS (
  SELECT p.*, text, CAST(coalesce(sum(length(part)) OVER (PARTITION BY o_custkey ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start"
  FROM parts p JOIN texts USING (o_custkey)
)"""


@query(f"""WITH {TEXTS}, ends AS (SELECT *, "start" + length(key) AS "end", strpos(substr(text, "start" + length(key) + 1), chr(10)) AS feed FROM starts)
SELECT o_custkey, "start", "end", key, least(coalesce(lead("start") OVER (PARTITION BY o_custkey ORDER BY "start"), length(text)),
  CASE WHEN feed > 0 THEN "end" + feed - 1 ELSE length(text) END) AS tail_end FROM ends""")
def citation_tail_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("doc_id", F.concat("key", F.when(F.col("doc_id") % 3 == 0, "\n").otherwise("; ")).alias("p"))
    texts = instructions(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(part)).getField("p"), "").alias("text"))
    found = citations.extract(texts, "o_custkey").select("o_custkey", "start", "end", "full_start", "key").join(texts, "o_custkey")
    return citations.tails(found, "o_custkey").select("o_custkey", F.col("start").cast("long"), F.col("end").cast("long"), "key", "tail_end")


@query(f"""WITH {MADE} SELECT doc_id, key, 'https://www.canlii.org/en/ca/scc/doc/' || replace(k, ' ', '/') || '.html' AS url
FROM (SELECT doc_id, key, left(key, 4) || ' ' || lower(replace(key, ' ', '')) || ' ' || lower(replace(key, ' ', '')) AS k FROM made)""")
def case_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions(spark, sf_dir).select("doc_id", "key", citations.address(F.col("key")).alias("url"))


@query("""WITH alias AS (
  SELECT n_nationkey AS key, n_name AS target, n_nationkey AS line_no FROM nation UNION ALL
  SELECT n_nationkey, 'again ' || n_name, 100 + n_nationkey FROM nation WHERE n_nationkey % 4 = 0
), last AS (SELECT key, arg_max(target, line_no) AS target FROM alias WHERE key % 5 <> 0 GROUP BY key)
SELECT c_custkey, target FROM customer LEFT JOIN last ON key = c_nationkey""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    alias = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("target"), F.col("n_nationkey").alias("line_no"))
    again = alias.where("key % 4 = 0").select("key", F.concat(F.lit("again "), "target").alias("target"), (F.col("line_no") + 100).alias("line_no"))
    lines = alias.unionByName(again).where("key % 5 <> 0")
    return resolve.with_alias(table(spark, sf_dir, "customer"), lines, "c_nationkey").select("c_custkey", "target")


@query("""WITH held AS (
  SELECT DISTINCT p_partkey, v FROM (SELECT p_partkey, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS v FROM part) WHERE v IS NOT NULL
), wanted AS (SELECT DISTINCT v AS key FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_name || ' x' FROM part)),
counted AS (SELECT key, count(p_partkey) AS n_matches, min(p_partkey) AS one FROM wanted LEFT JOIN held ON v = key GROUP BY key)
SELECT key, n_matches, CASE WHEN n_matches = 0 THEN 'none' WHEN n_matches = 1 THEN 'match' ELSE 'many' END AS status, CASE WHEN n_matches = 1 THEN one END AS p_partkey FROM counted""")
def exact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_name").alias("key")).unionByName(part.select(F.col("p_brand").alias("key")))
    wanted = wanted.unionByName(part.select(F.concat("p_name", F.lit(" x")).alias("key")))
    return resolve.exact_matches(wanted, part, ["p_name", "p_brand", "p_type", "p_size"], "p_partkey")


@query("""WITH v AS (
  SELECT o_custkey, o_orderpriority AS v, 0 AS part, o_orderkey FROM orders UNION ALL SELECT o_custkey, o_orderstatus, 1, o_orderkey FROM orders
), firsts AS (SELECT o_custkey, v, min(part * 1000000000 + o_orderkey) AS o FROM v GROUP BY o_custkey, v)
SELECT o_custkey, string_agg(v, '|' ORDER BY o) AS aliases FROM firsts GROUP BY o_custkey""")
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("r")
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordered)
    both = resolve.distinct_in_order(F.col("r.o_orderpriority"), F.col("r.o_orderstatus"))
    return grouped.select("o_custkey", F.array_join(both, "|").alias("aliases"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS t, o_orderkey % 7 = 0 AS manual FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 1),
n AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS t FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN CASE WHEN manual THEN 'retained' ELSE 'dropped' END WHEN o.t = n.t THEN 'keep' ELSE 'relocate' END AS action,
  CASE WHEN n.id IS NOT NULL THEN n.t ELSE o.t END AS targets FROM o FULL JOIN n ON o.id = n.id""")
def previous_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("targets"))
    old = orders.where("id % 3 <> 0 or id % 2 = 1").withColumn("manual", F.col("id") % 7 == 0)
    new = orders.where("id % 2 = 0").withColumn("targets", F.col("targets") + F.when(F.col("id") % 5 == 0, 1).otherwise(0))
    return resolve.merged_state(old, new)


TREE = """nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
)"""


@query(f"""WITH RECURSIVE {TREE}, below(root, id, depth) AS (
  SELECT id, id, CAST(0 AS BIGINT) FROM nodes UNION ALL SELECT b.root, n.id, b.depth + 1 FROM below b JOIN nodes n ON n.parent_id = b.id
) SELECT root, id, depth FROM below""")
def subtree_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nodes = nodes.unionByName(table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("id"), named("r", "n_regionkey").alias("parent_id")))
    nodes = nodes.unionByName(table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("id"), named("n", "c_nationkey").alias("parent_id")))
    return structure.subtree(nodes)


@query("""WITH items AS (SELECT c_nationkey AS parent, c_custkey AS item, c_custkey * 3 // 2 AS "start" FROM customer),
ends AS (SELECT parent, max("start") + 10 AS last FROM items GROUP BY parent)
SELECT i.item, i."start", coalesce((SELECT min(j."start") FROM items j WHERE j.parent = i.parent AND j."start" > i."start"), last) AS item_end FROM items i JOIN ends USING (parent)""")
def item_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("item"), F.floor(F.col("c_custkey") * 3 / 2).alias("start"))
    ends = items.groupBy("parent").agg((F.max("start") + 10).alias("last"))
    return structure.item_ends(items.join(ends, "parent"), "parent", "last").select("item", "start", "item_end")


@query("""WITH RECURSIVE spans AS (
  SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_orderkey AS seq, o_orderkey * 7919 % 400 AS s, o_orderkey * 7919 % 400 + 10 + o_orderkey % 50 AS e FROM orders
), walk(k, rn, kept) AS (
  SELECT k, CAST(0 AS BIGINT), CAST([] AS STRUCT(seq BIGINT, s BIGINT, e BIGINT)[]) FROM spans WHERE rn = 1
  UNION ALL
  SELECT w.k, w.rn + 1, CASE WHEN len(list_filter(w.kept, lambda x: p.s < x.e AND x.s < p.e)) > 0 THEN w.kept ELSE list_append(w.kept, {'seq': p.seq, 's': p.s, 'e': p.e}) END
  FROM walk w JOIN spans p ON p.k = w.k AND p.rn = w.rn + 1
), done AS (SELECT k, arg_max(kept, rn) AS kept FROM walk GROUP BY k)
SELECT k AS o_custkey, x.seq AS seq, x.s AS "start", x.e AS "end" FROM (SELECT k, unnest(kept) AS x FROM done)""")
def link_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") * 7919 % 400
    spans = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), start.alias("start"), (start + 10 + F.col("o_orderkey") % 50).alias("end"))
    return links.without_overlaps(spans, "o_custkey")


@query(f"""WITH {MADE}, parts AS (
  SELECT doc_id, key, a, b, unnest([0, 1, 2]) AS n FROM made
), spans AS (
  SELECT doc_id, n, CASE n WHEN 0 THEN 0 WHEN 1 THEN length(key) + 10 ELSE length(key) + 11 + length(CAST(a AS VARCHAR)) END AS "start", CASE n WHEN 0 THEN key WHEN 1 THEN CAST(a AS VARCHAR) ELSE CAST(b AS VARCHAR) END AS expected FROM parts
) SELECT doc_id, n AS place, CAST("start" AS BIGINT) AS "start", CAST("start" + length(expected) AS BIGINT) AS "end", expected,
  CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN n < 2 ELSE doc_id % 11 <> 3 END AS written FROM spans""")
def link_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links planned in instructions and written into their texts as they are by then: some begin with
    another character, some end with one, some are gone."""
    units = instructions(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.lit("footnote").alias("kind"), "text")
    found = citations.extract(units, "unit_id")
    rows = links.planned(units, found).select("unit_id", F.col("n").alias("place"), "start", "end", "expected", "url")
    k = F.col("unit_id")
    last = F.regexp_replace("text", ".$", "#")
    now = units.withColumn("text", F.when(k % 5 == 0, F.concat(F.lit("#"), "text")).when(k % 5 == 1, last).otherwise(F.col("text"))).where((k % 5 < 2) | (k % 11 != 3))
    folder = scratch_folder(spark, "links")
    linked.write_links(rows, now, folder)
    return linked.read_links(spark, folder).select(F.col("unit_id").alias("doc_id"), F.col("place").cast("long").alias("place"), "start", "end", "expected", "written")


@query("""SELECT o_orderkey AS occ_id, i AS part_no, CASE i % 2 WHEN 0 THEN 100 + o_orderkey % 9 ELSE 200 END + i AS "start", CASE i % 2 WHEN 0 THEN 100 + o_orderkey % 9 ELSE 200 END + i + 2 AS "end"
FROM orders, unnest(range(0, o_orderkey % 4)) t(i)""")
def pinpoint_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("occ_id"))
    n = F.col("occ_id") % 4
    pinpoints = F.array(F.struct((100 + F.col("occ_id") % 9).alias("start")), F.struct(F.lit(200).cast("long").alias("start")))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i % 2).cast("int").alias("pinpoint"), i.alias("start"), (i + 2).alias("end")))).otherwise(F.array())
    return links.rebased(orders.withColumn("pinpoints", pinpoints), parts).withColumn("part_no", F.col("part_no").cast("long"))


@query("""WITH q AS (SELECT o_orderkey AS seq, o_orderpriority AS src, o_custkey % 3 AS priority, o_custkey % 11 AS ord FROM orders WHERE o_custkey % 3 > 0 OR o_orderkey % 2 = 0)
SELECT src, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY priority DESC, ord, seq) AS place FROM q) WHERE place <= 4""")
def priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("src"), (F.col("o_custkey") % 3).alias("priority"), (F.col("o_custkey") % 11).alias("order"))
    return stateful.started(queue, "src", 4, F.col("seq") % 2 == 1).select("src", "seq", "place")


@query("""SELECT o_custkey, o_orderkey FROM orders EXCEPT ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 7 = 3""")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return review.missing_pages(asked, asked.where("o_orderkey % 7 = 3"), ["o_custkey", "o_orderkey"])


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS later FROM orders)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY later, CASE WHEN later = 0 THEN -o_orderkey ELSE o_orderkey END) AS pages FROM p GROUP BY o_custkey""")
def priority_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.array_sort(F.collect_list("o_orderkey"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(pages.alias("pages"))
    asked = F.concat(F.reverse(F.filter("pages", lambda p: p % 5 == 0)), F.array(F.lit(-1).cast("long")))
    return rows.select("o_custkey", F.array_join(resolve.priority_first(asked, F.col("pages")), ",").alias("pages"))


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'F') AS found, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS targets FROM orders GROUP BY o_custkey)
SELECT o_custkey, found, targets, CASE WHEN o_custkey % 10 = 7 THEN 'Matched by filename; check the PDF in Review'
  WHEN targets > 0 THEN found || ' of ' || targets || ' requested passages located' || CASE WHEN found < targets THEN ' · review needed' ELSE '' END
  ELSE 'PDF ready · add highlights in review' END AS status FROM c""")
def finding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.col("o_orderkey") % 4 == 0
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(target & (F.col("o_orderstatus") == "F")).alias("found"), F.count_if(target).alias("targets"))
    return counted.withColumn("status", structure.finding_status(F.col("found"), F.col("targets"), F.col("o_custkey") % 10 == 7))


BOX = """SELECT l_orderkey AS page, l_linenumber AS seq, l_discount * 5 AS x0, l_tax * 5 AS y0, l_discount * 5 + l_quantity / 50 AS x1, l_tax * 5 + 0.5 AS y1 FROM lineitem"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), (F.col("l_discount") * 5).alias("x0"), (F.col("l_tax") * 5).alias("y0"),
        (F.col("l_discount") * 5 + F.col("l_quantity") / 50).alias("x1"), (F.col("l_tax") * 5 + 0.5).alias("y1"),
    )


@query(f"""WITH marks AS ({BOX}), points AS (SELECT o_orderkey AS point_id, (o_orderkey % 10) / 10.0 AS x, (o_custkey % 10) / 10.0 AS y FROM orders)
SELECT point_id, CAST(arg_max(page * 10 + seq, seq) AS BIGINT) AS mark_id FROM points LEFT JOIN marks ON page = point_id AND x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY point_id""")
def point_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = boxes(spark, sf_dir).withColumn("mark_id", F.col("page") * 10 + F.col("seq"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("page"), ((F.col("o_orderkey") % 10) / F.lit(10.0)).alias("x"), ((F.col("o_custkey") % 10) / F.lit(10.0)).alias("y"))
    return layout.topmost_at(points, marks)


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS seq, (l_linenumber * 2 + l_quantity % 3) / 16 AS x0, (l_linenumber * 2 + l_quantity % 3 + 1 + l_quantity % 2) / 16 AS x1, l_linenumber // 3 AS line FROM lineitem),
runs AS (SELECT *, max(x1) OVER (PARTITION BY page, line ORDER BY seq, x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
n AS (SELECT *, sum(CASE WHEN x0 <= reach + 0.012 THEN 0 ELSE 1 END) OVER (PARTITION BY page, line ORDER BY seq, x0, x1 ROWS UNBOUNDED PRECEDING) AS part FROM runs),
r AS (SELECT page, max(x1) - min(x0) AS width FROM n GROUP BY page, line, part)
SELECT page, count(*) AS n_rects, sum(width) AS width FROM r GROUP BY page""")
def rect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, line = F.col("l_linenumber") * 2 + F.col("l_quantity") % 3, F.floor(F.col("l_linenumber") / 3)
    rects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), (x0 / 16).alias("x0"), line.alias("y0"), ((x0 + 1 + F.col("l_quantity") % 2) / 16).alias("x1"), (line + 0.5).alias("y1"))
    return layout.merge_rects(rects, ["page"]).groupBy("page").agg(F.count("*").alias("n_rects"), F.sum(F.col("x1") - F.col("x0")).alias("width"))


@query(f"""SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({BOX}) GROUP BY page""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bounds(boxes(spark, sf_dir), ["page"])


@query("""SELECT l_orderkey, l_linenumber, '#' || printf('%02x', CAST(floor(least(1, l_discount * 10) * 255 + 0.5) AS BIGINT)) || printf('%02x', CAST(floor(least(1, l_tax * 10) * 255 + 0.5) AS BIGINT)) || printf('%02x', CAST(floor(least(1, l_quantity / 50) * 255 + 0.5) AS BIGINT)) AS colour FROM lineitem""")
def rgb_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.rgb_to_hex(rgb).alias("colour"))


QUERIES, ORACLES = query.queries, query.oracles
