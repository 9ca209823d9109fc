"""Queries over the documents: lines, layout, structure, shingles, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, matching, resolve, structure
from ..sources import sinks
from ..sources.tables import table
from .registry import Registry

query = Registry()

TIDY = r"trim(regexp_replace({}, '[\t\n\f\r ]+', ' ', 'g'))"
#: What the made rows hold that NFKC or white space changes, and what it becomes.
MARKS, PLAIN = "\u00a0\ufeff\uff30\uff50\uff0d\uff11\u3000", "  Pp-1 "
NORMAL = rf"trim(regexp_replace(translate({{}}, '{MARKS}', '{PLAIN}'), '[\t\n\f\r ]+', ' ', 'g'))"
LINES = r"""
lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) t(i)
)"""
OFFSETS = (
    LINES
    + """, placed AS (
  SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM lines
), offsets AS (SELECT doc_id, line_no, line, s AS "start", s + length(line) AS "end" FROM placed)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.explode_lines(table(spark, sf_dir, "documents"))


@query(f"""WITH {LINES}, pairs AS (SELECT DISTINCT doc_id, {TIDY.format("line")} AS line FROM lines)
SELECT line, count(*) AS n_pages FROM pairs WHERE line <> '' GROUP BY line HAVING count(*) >= 2""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.running_lines(lines(spark, sf_dir))


@query(f"""WITH {LINES}, tidied AS (SELECT *, {TIDY.format("line")} AS tidy FROM lines),
running AS (SELECT tidy FROM tidied WHERE tidy <> '' GROUP BY tidy HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM tidied
WHERE tidy NOT IN (SELECT tidy FROM running) GROUP BY doc_id""")
def strip_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_lines = lines(spark, sf_dir)
    kept = layout.strip_lines(all_lines, layout.running_lines(all_lines))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


PAGES = r"""heads AS (
  SELECT *, CASE doc_id % 5 WHEN 1 THEN 'Report' || chr(160) || 'of ' WHEN 2 THEN chr(65279) || 'Report of' || chr(12288) ELSE 'Report of ' END || source AS head FROM documents WHERE source IS NOT NULL AND text IS NOT NULL
), pages AS (
  SELECT source, doc_id, string_split(head || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'page ' || doc_id WHEN 3 THEN chr(65328) || 'age' || chr(160) || chr(65297) || doc_id ELSE 'Opening' END || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '[1] ' END || text || chr(10) || head || chr(10) || CASE doc_id % 4 WHEN 0 THEN '- ' || doc_id || ' -' WHEN 2 THEN chr(65293) || ' ' || doc_id ELSE 'Closing' END, chr(10)) AS l
  FROM heads
), lines AS (SELECT source, doc_id, i - 1 AS line_no, l[i] AS line, (i - 1) / len(l) AS top, i / len(l) AS bottom FROM pages, unnest(range(1, len(l) + 1)) t(i)),
tidied AS (SELECT *, """ + NORMAL.format("line") + r""" AS tidy FROM lines),
keyed AS (
  SELECT *, regexp_matches(line, '^\s*(\[\d+\]|\d+[.)])\s+') AS numbered,
    CASE WHEN regexp_matches(tidy, '^(\[\d+\]|\d+[.)])\s+') THEN NULL WHEN regexp_matches(tidy, '^(?i)(page\s+)?[-–—]?\s*\d+\s*[-–—]?$') THEN '#page-number' ELSE tidy END AS key FROM tidied
), counted AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
running AS (
  SELECT k.source, k.key FROM keyed k JOIN counted c ON c.source = k.source WHERE k.key IS NOT NULL AND (top < 0.075 OR bottom > 0.935)
  GROUP BY k.source, k.key, c.n HAVING count(DISTINCT k.doc_id) >= greatest(2, ceil(c.n * 0.1))
)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of its source's report, with a header and a footer, which some pages
    write with no-break or wide spaces, a byte order mark, or full-width letters and digits."""
    k = F.col("doc_id")
    report = F.when(k % 5 == 1, "Report\u00a0of ").when(k % 5 == 2, "\ufeffReport of\u3000").otherwise("Report of ")
    head = F.concat(report, "source")
    opening = F.when(k % 6 == 0, F.concat(F.lit("page "), k.cast("string"))).when(k % 6 == 3, F.concat(F.lit("\uff30age\u00a0\uff11"), k.cast("string"))).otherwise("Opening")
    closing = F.when(k % 4 == 0, F.concat(F.lit("- "), k.cast("string"), F.lit(" -"))).when(k % 4 == 2, F.concat(F.lit("\uff0d "), k.cast("string"))).otherwise("Closing")
    text = F.concat_ws("\n", head, opening, F.concat(F.when(k % 4 == 0, "").otherwise("[1] "), "text"), head, closing)
    pages = table(spark, sf_dir, "documents").where("source is not null and text is not null").select("source", "doc_id", F.split(text, "\n").alias("l"))
    lines = pages.select("source", "doc_id", F.size("l").alias("n"), F.posexplode("l").alias("line_no", "line"))
    return layout.keyed(lines.withColumns({"top": F.col("line_no") / F.col("n"), "bottom": (F.col("line_no") + 1) / F.col("n")}).drop("n"))


@query(f"WITH {PAGES} SELECT source, key FROM running")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.running_headers(reports(spark, sf_dir), "source", "doc_id", share=0.1)


@query(f"""WITH {PAGES}, firsts AS (SELECT source, doc_id, min(line_no) FILTER (WHERE numbered) AS first FROM keyed GROUP BY source, doc_id)
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE contains(line, 'Report')) AS n_reports FROM keyed k JOIN firsts f USING (source, doc_id)
WHERE NOT coalesce(((top < 0.075 AND (key = '#page-number' OR line_no < first)) OR (bottom > 0.935 AND key = '#page-number')) AND EXISTS (SELECT 1 FROM running r WHERE r.source = k.source AND r.key = k.key), false)
GROUP BY doc_id""")
def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports(spark, sf_dir)
    kept = layout.strip_running(lines, layout.running_headers(lines, "source", "doc_id", share=0.1), "source", "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.count_if(F.col("line").contains("Report")).alias("n_reports"))


ITEMS = """words AS (
  SELECT doc_id, i - 1 AS w, l[i] AS text FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) t(i)
), items AS (
  SELECT doc_id, w // 60 AS page, w % 60 AS item_no, text, CASE WHEN w % 17 <> 3 THEN (9 * (w % 10) + (doc_id + w * 13) % 7) / 100 END AS x0,
    (9 * (w % 10) + (doc_id + w * 13) % 7 + length(text) % 9) / 100 AS x1, (w // 10 + w % 3) / 1000 AS y0, (w // 10 + 12) / 1000 AS y1,
    ((w // 10) * 6 + (w * 3 + doc_id) % 4) / 2 AS baseline, (8 + w % 5) / 1 AS height, (200 + 100 * (doc_id % 3)) / 1 AS width, w % 23 = 11 OR contains(text, chr(10)) AS has_eol
  FROM words
)"""


@query(rf"""WITH RECURSIVE {ITEMS}, walk(doc_id, page, i, line_no, open, n, text, x0, y0, x1, y1, baseline) AS (
  SELECT DISTINCT doc_id, page, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), false, CAST(0 AS BIGINT), '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM items
  UNION ALL
  SELECT doc_id, page, item_no, CASE WHEN counts AND NOT joins THEN line_no + 1 ELSE line_no END, CASE WHEN blank THEN open AND NOT has_eol WHEN counts THEN NOT has_eol ELSE open END,
    CASE WHEN NOT counts THEN n WHEN joins THEN n + 1 ELSE 1 END,
    CASE WHEN NOT counts THEN text WHEN joins THEN text || CASE WHEN (ix0 - x1) * width > CAST(0.15 AS DOUBLE) * height AND NOT regexp_matches(text, '\s$') THEN ' ' ELSE '' END || itext ELSE itext END,
    CASE WHEN NOT counts THEN x0 WHEN joins THEN least(x0, ix0) ELSE ix0 END, CASE WHEN NOT counts THEN y0 WHEN joins THEN least(y0, iy0) ELSE iy0 END,
    CASE WHEN NOT counts THEN x1 WHEN joins THEN greatest(x1, ix1) ELSE ix1 END, CASE WHEN NOT counts THEN y1 WHEN joins THEN greatest(y1, iy1) ELSE iy1 END,
    CASE WHEN counts AND NOT joins THEN ibase ELSE baseline END
  FROM (
    SELECT s.*, t.item_no, t.text AS itext, t.x0 AS ix0, t.y0 AS iy0, t.x1 AS ix1, t.y1 AS iy1, t.baseline AS ibase, t.height, t.width, t.has_eol,
      trim(t.text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank, trim(t.text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND t.x0 IS NOT NULL AS counts,
      s.open AND abs(s.baseline - t.baseline) < t.height * CAST(0.25 AS DOUBLE) AND t.x0 >= s.x0 - CAST(0.005 AS DOUBLE) AND (t.x0 - s.x1) * t.width < t.height * 3 AS joins
    FROM walk s JOIN items t ON t.doc_id = s.doc_id AND t.page = s.page AND t.item_no = s.i + 1
  )
), lines AS (SELECT doc_id, page, line_no, max(i) AS i FROM walk WHERE line_no >= 0 GROUP BY doc_id, page, line_no)
SELECT doc_id, page, line_no, n AS n_items, text, x0, y0, x1, y1, baseline FROM lines JOIN walk USING (doc_id, page, line_no, i)""")
def assemble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as items of pages of sixty: overlaps, drifting baselines, gaps, items without a
    box, blank items, ends of lines. A text's words are exploded in their order."""
    words = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("w", "text"))
    w, k = F.col("w").cast("long"), F.col("doc_id")
    left = 9 * (w % 10) + (k + w * 13) % 7
    row = F.floor(w / 10)
    items = words.select(
        "doc_id", F.floor(w / 60).alias("page"), (w % 60).alias("item_no"), "text", F.when(w % 17 != 3, left / 100).alias("x0"), ((row + w % 3) / 1000).alias("y0"), ((left + F.length("text") % 9) / 100).alias("x1"), ((row + 12) / 1000).alias("y1"),
        ((row * 6 + (w * 3 + k) % 4) / 2).alias("baseline"), (8 + w % 5).alias("height"), (200 + 100 * (k % 3)).alias("width"), ((w % 23 == 11) | F.contains("text", F.lit("\n"))).alias("has_eol"),
    )
    return layout.assemble_lines(items, in_order=True).select("doc_id", "page", "line_no", "n_items", "text", "x0", "y0", "x1", "y1", "baseline")


@query(f"""WITH {OFFSETS} SELECT doc_id, line_no, "start", "end" FROM offsets""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.line_offsets(lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long"), "start", "end")
    return found.withColumn("end", F.col("end").cast("long"))


@query(f"""WITH {LINES}, ranked AS (
  SELECT doc_id, line_no // 10 AS page, line_no, length(line) AS n FROM lines
), placed AS (
  SELECT *, CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + page AS s FROM ranked
) SELECT doc_id, page, line_no, s AS "start", s + n AS "end" FROM placed""")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = lines(spark, sf_dir).withColumn("page", F.floor(F.col("line_no") / 10))
    return layout.page_offsets(paged).select("doc_id", F.col("page").cast("long"), F.col("line_no").cast("long"), "start", F.col("end").cast("long"))


@query(f"""WITH {LINES}, xs AS (
  SELECT doc_id, list_sort(list(length(string_split(line, ' ')[1])) FILTER (WHERE trim(line) <> '')) AS x FROM lines GROUP BY doc_id
) SELECT doc_id, CAST(coalesce(x[CAST(floor(len(x) * 0.2) AS INT) + 1], 0) AS BIGINT) AS margin FROM xs""")
def left_margin_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.length(F.split("line", " ")[0])
    return layout.left_margins(lines(spark, sf_dir), first).withColumn("margin", F.col("margin").cast("long"))


@query(f"""WITH {LINES}
SELECT doc_id, line_no, CAST(greatest(0, least(12, floor((x - margin) * 60 + 0.5))) AS BIGINT) AS spaces
FROM (SELECT doc_id, line_no, length(line) / 1000.0 AS x, 0.05 AS margin FROM lines)""")
def line_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.length("line") / F.lit(1000.0)
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long"), T.indent(x, F.lit(0.05)).alias("spaces"))


@query(f"""WITH {LINES}
SELECT doc_id, CAST(coalesce(min(line_no) FILTER (WHERE regexp_matches(line, '^([0-9]+|[A-Z]{{3,}})')), -1) AS BIGINT) AS first_line FROM lines GROUP BY doc_id""")
def first_marker_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.first_marked(lines(spark, sf_dir), "^([0-9]+|[A-Z]{3,})")


@query(r"""WITH counted AS (
  SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS useful, length(text) // 4 AS body, doc_id % 3 = 0 AS has_image FROM documents WHERE text IS NOT NULL
) SELECT doc_id, useful, body, useful < 60 OR (body < 40 AND has_image) AS needs_recognition FROM counted""")
def letters_digits_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    counted = docs.select("doc_id", T.useful_characters(F.col("text")).alias("useful"), F.floor(F.length("text") / 4).alias("body"), (F.col("doc_id") % 3 == 0).alias("has_image"))
    return counted.select("doc_id", "useful", F.col("body").cast("long"), layout.needs_recognition(counted).alias("needs_recognition"))


@query(f"""WITH {LINES}, named AS (
  SELECT doc_id, line_no, lower(string_split(line, ' ')[1]) AS label, lower(string_split(line, ' ')[-1]) AS alias FROM lines
), wanted AS (
  SELECT n.doc_id, n.label AS value FROM named n JOIN (SELECT doc_id, count(*) AS n FROM named GROUP BY doc_id) c ON c.doc_id = n.doc_id AND n.line_no = n.doc_id % c.n
), hits AS (
  SELECT w.doc_id, w.value, count(n.line_no) AS n, min(n.line_no) AS one FROM wanted w LEFT JOIN named n ON n.doc_id = w.doc_id AND (n.label = w.value OR n.alias = w.value) GROUP BY ALL
) SELECT doc_id, value, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS node_id FROM hits""")
def paragraph_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("line", " ")
    nodes = lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("node_id"), F.lower(words[0]).alias("label"), F.array(F.lower(F.element_at(words, -1))).alias("aliases"))
    counts = nodes.groupBy("doc_id").agg(F.count("*").alias("n"))
    wanted = nodes.join(counts, "doc_id").where("node_id = doc_id % n").select("doc_id", F.col("label").alias("value"))
    return structure.unique_targets(wanted, nodes)


RANGES = """ranges AS (SELECT doc_id, 1 AS range_id, n_chars // 3 AS a, n_chars // 2 AS b FROM documents)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("range_id"), F.floor(F.col("n_chars") / 3).alias("start"), F.floor(F.col("n_chars") / 2).alias("end"))


@query(f"""WITH {OFFSETS}, {RANGES}
SELECT o.doc_id, count(*) AS n_lines, min(line_no) AS first_line, max(line_no) AS last_line FROM offsets o JOIN ranges r ON r.doc_id = o.doc_id AND o."end" > r.a AND o."start" < r.b
WHERE trim(line) <> '' GROUP BY o.doc_id""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.overlapping(layout.line_offsets(lines(spark, sf_dir)), ranges(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"), F.max("line_no").cast("long").alias("last_line"))


@query(f"""WITH {OFFSETS}, {RANGES}
SELECT o.doc_id, line_no // 5 AS page, min(line_no) AS first_line, count(*) AS n_lines, min("start") AS "start", max("end") AS "end"
FROM offsets o JOIN ranges r ON r.doc_id = o.doc_id AND o."end" > r.a AND o."start" < r.b WHERE trim(line) <> '' GROUP BY ALL""")
def page_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.overlapping(layout.line_offsets(lines(spark, sf_dir)), ranges(spark, sf_dir)).withColumn("page", F.floor(F.col("line_no") / 5).cast("long"))
    parts = structure.fragments(found)
    return parts.select("doc_id", "page", F.col("first_line").cast("long"), "n_lines", "start", F.col("end").cast("long"))


@query(f"""WITH {LINES}, y AS (SELECT *, (line_no % 40) / 40.0 AS y, {TIDY.format("line")} AS tidy FROM lines),
native AS (SELECT * FROM y WHERE line_no % 2 = 0), ocr AS (SELECT * FROM y WHERE line_no % 2 = 1)
SELECT doc_id, count(*) FILTER (WHERE src = 'native') AS n_native, count(*) FILTER (WHERE src = 'ocr') AS n_ocr FROM (
  SELECT doc_id, 'native' AS src FROM native UNION ALL
  SELECT doc_id, 'ocr' FROM ocr o WHERE NOT EXISTS (SELECT 1 FROM native n WHERE n.doc_id = o.doc_id AND n.tidy = o.tidy AND abs(n.y - o.y) < 0.04)
) GROUP BY doc_id""")
def ocr_antidupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines are recognised ones; every third of them has wide or no-break spaces and a byte order
    mark, which make no difference."""
    placed = lines(spark, sf_dir).withColumn("y", (F.col("line_no") % 40) / F.lit(40.0))
    native, ocr = placed.where("line_no % 2 = 0"), placed.where("line_no % 2 = 1")
    odd = F.concat(F.lit("\ufeff"), F.regexp_replace("line", " ", "\u00a0\u3000"))
    ocr = ocr.withColumn("line", F.when(F.col("line_no") % 3 == 0, odd).otherwise(F.col("line")))
    kept = layout.drop_recognised(native, ocr, ["doc_id"])
    both = native.withColumn("src", F.lit("native")).unionByName(kept.withColumn("src", F.lit("ocr")))
    return both.groupBy("doc_id").agg(F.count_if(F.col("src") == "native").alias("n_native"), F.count_if(F.col("src") == "ocr").alias("n_ocr"))


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\t\n\f\r ]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents)
SELECT array_to_string(w[1:12], ' ') AS phrase, count(*) AS n FROM w WHERE len(w) >= 12 GROUP BY 1 HAVING count(*) > 1""")
def opening_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.shared_openings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
dp AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS phrase FROM d, unnest(range(1, len(w) - 10)) t(i)),
bp AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS phrase FROM b, unnest(range(1, len(w) - 10)) t(i)),
o AS (SELECT phrase, count(*) AS owners FROM bp GROUP BY phrase), n AS (SELECT item_id, count(*) AS phrases FROM bp GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS hits, count(*) FILTER (WHERE owners = 1) AS unique_hits
FROM dp JOIN bp USING (phrase) JOIN o USING (phrase) JOIN n USING (item_id) GROUP BY doc_id, item_id, phrases
HAVING count(*) * 2 > phrases AND count(*) FILTER (WHERE owners = 1) >= 2""")
def shingle_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.majority_matches(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query("""WITH f AS (SELECT doc_id AS file_id, sha256(text) AS k FROM documents WHERE doc_id % 2 = 1),
r AS (SELECT doc_id AS record_id, sha256(text) AS k FROM documents WHERE doc_id % 2 = 0)
SELECT file_id, min(record_id) AS record_id FROM f JOIN r USING (k) GROUP BY file_id HAVING count(DISTINCT record_id) = 1""")
def unique_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.sha2("text", 256)).alias("keys"))
    return resolve.unique_bind(docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "file_id"), docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "record_id"))


@query("""WITH f AS (SELECT source, sha256(coalesce(text, '')) AS digest, doc_id FROM documents),
p AS (SELECT source, doc_id // 4096 AS part, count(*) AS n, sha256(string_agg(doc_id || ':' || digest, chr(10) ORDER BY doc_id, digest)) AS digest FROM f GROUP BY source, doc_id // 4096)
SELECT source, CAST(sum(n) AS BIGINT) AS n_files, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS build_id FROM p GROUP BY source""")
def sha_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return sinks.ranged_manifest(docs, "source", "doc_id", "digest")


@query("""SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS distance, length(a.p_name) > 0 AND levenshtein(a.p_name, b.p_name) * 100 < 12 * length(a.p_name) AS accepted
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def cer_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates, of each part's name read as the next one's."""
    gold = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("gold"))
    read = gold.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("gold").alias("read"))
    return gold.join(read, "p_partkey").select("p_partkey", T.error_distance(F.col("gold"), F.col("read")).alias("distance"), T.recognition_accepted(F.col("gold"), F.col("read")).alias("accepted"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text || ' ' || ['fi', 'A', '1', 'kg', 'é'][doc_id % 5 + 1], '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM d""")
def nfkc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, each followed by a mark that has a compatibility form; SQL appends that form."""
    mark = F.get(F.array(*[F.lit(x) for x in ("\ufb01", "\uff21", "\u2460", "\u338f", "e\u0301")]), (F.col("doc_id") % 5).cast("int"))
    marked = F.concat("text", F.lit("\u3000"), mark)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.nfkc(marked).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, chr(9) || ' ' || chr(128512) || text AS t FROM documents)
SELECT doc_id, length(t) AS code_points, length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) AS utf16_units, substr(trim(t, chr(9) || chr(10) || chr(13) || ' '), 1, 1999) AS excerpt FROM d""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with white space and a character of two units, the only one of that kind."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("\t \U0001f600"), "text"))
    return docs.select("doc_id", F.length("text").cast("long").alias("code_points"), T.utf16_length(F.col("text")).alias("utf16_units"), structure.excerpt(F.col("text")).alias("excerpt"))


@query(r"""WITH d AS (SELECT doc_id, source, n_chars, regexp_split_to_array(lower(text), '[\t\n\f\r ]+')[1] AS name FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY n_chars DESC, doc_id) AS rn FROM d WHERE doc_id // 20 % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY doc_id) AS rn FROM d WHERE doc_id // 20 % 2 = 0)
SELECT f.source, f.doc_id AS file_id, r.doc_id AS record_id FROM f JOIN r ON r.source = f.source AND r.name = f.name AND r.rn = f.rn""")
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.array_join(F.slice(F.split(F.lower("text"), "[\\t\\n\\f\\r ]+"), 1, 1), " ")
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null").withColumn("name", opening)
    files = docs.where("doc_id div 20 % 2 = 1").select("source", F.col("doc_id").alias("file_id"), "name", F.col("n_chars").alias("mtime"))
    records = docs.where("doc_id div 20 % 2 = 0").select("source", F.col("doc_id").alias("record_id"), F.col("doc_id").alias("seq"), "name")
    return matching.greedy_assignment(files, records, "source")


@query(r"""WITH RECURSIVE p AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ') AS w FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM p WHERE p_partkey % 2 = 1),
r AS (SELECT p_brand, w, p_partkey AS record_id FROM p WHERE p_partkey % 2 = 0),
walk(p_brand, rn, file_id, record_id, gone) AS (
  SELECT DISTINCT p_brand, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM f UNION ALL
  SELECT p_brand, rn, file_id, record_id, CASE WHEN record_id IS NULL THEN gone ELSE list_append(gone, record_id) END FROM (
    SELECT k.p_brand, f.rn, f.p_partkey AS file_id, k.gone, min(r.record_id) AS record_id
    FROM walk k JOIN f ON f.p_brand = k.p_brand AND f.rn = k.rn + 1
    LEFT JOIN r ON r.p_brand = k.p_brand AND list_has_any(r.w, f.w) AND NOT list_contains(k.gone, r.record_id)
    GROUP BY k.p_brand, f.rn, f.p_partkey, k.gone) s
) SELECT p_brand, file_id, record_id FROM walk WHERE record_id IS NOT NULL""")
def greedy_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files and as records of their brand; names match that have a word in common."""
    part = table(spark, sf_dir, "part").withColumn("name", F.col("p_name"))
    files = part.where("p_partkey % 2 = 1").select("p_brand", F.col("p_partkey").cast("long").alias("file_id"), "name", F.col("p_size").alias("mtime"))
    records = part.where("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").cast("long").alias("record_id"), F.col("p_partkey").alias("seq"), "name")
    return matching.greedy_assignment(files, records, "p_brand", lambda a, b: not set(a.split()).isdisjoint(b.split()))


QUERIES, ORACLES = query.queries, query.oracles
