"""Queries over web pages: addresses, routing, links, redirects, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..operators import resolve
from ..sources.tables import table
from .registry import Registry

query = Registry()

HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(r"""WITH s AS (SELECT page_id, CASE WHEN regexp_matches(url, '^http://[^/]*\.net(/|$)') THEN regexp_replace(url, '^http://', 'https://') ELSE url END AS u FROM pages),
b AS (SELECT page_id, regexp_replace(u, '[?#].*$', '') AS bare FROM s)
SELECT page_id, CASE WHEN regexp_matches(bare, '^https://[A-Za-z0-9.-]+(/.*)?$') AND NOT regexp_matches(regexp_replace(bare, '^https://[^/]*', ''), '[%\\]') THEN bare END AS admitted FROM b""")
def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    secure = F.when(F.col("url").rlike("^http://[^/]*\\.net(/|$)"), F.regexp_replace("url", "^http://", "https://")).otherwise(F.col("url"))
    return pages.select("page_id", web.admitted(secure).alias("admitted"))


@query(f"""WITH h AS (SELECT page_id, url, {HOST} AS h FROM pages)
SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'refuse' WHEN h IS NULL OR h = '' THEN 'refuse' WHEN h = 'thther.example.org' THEN 'direct' WHEN h IN ('blog.tionsh.example.net', 'blog.ththan.example.net') THEN 'page' WHEN h IN ('www.ththhe.example.com', 'ththed.example.org') THEN 'publisher' ELSE 'foreign' END AS route
FROM h""")
def host_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    direct, over, publishers = ["thther.example.org"], ["blog.tionsh.example.net", "blog.ththan.example.net"], ["www.ththhe.example.com", "ththed.example.org"]
    route = web.route(F.col("url"), F.col("page_id") % 13 == 0, direct, over, publishers)
    return pages.select("page_id", route.alias("route"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages),
f AS (SELECT page_id, link, min(i) AS i FROM (SELECT page_id, unnest(l) AS link, unnest(range(1, len(l) + 1)) AS i FROM l) GROUP BY page_id, link)
SELECT page_id, rank, link FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rank FROM f) WHERE rank <= 4""")
def href_ranked_limit4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ranked_links(table(spark, sf_dir, "pages"), 'href="([^"]+)"')


EDGES = """edges AS (SELECT 'p' || page_id AS source, 'p' || (page_id * 7 + 3) % 250 AS target FROM pages WHERE page_id % 4 <> 1)"""


@query(f"""WITH RECURSIVE {EDGES}, walk(url, final, n_hops) AS (
  SELECT 'p' || page_id, 'p' || page_id, CAST(0 AS BIGINT) FROM pages UNION ALL
  SELECT w.url, e.target, w.n_hops + 1 FROM walk w JOIN edges e ON e.source = w.final WHERE w.n_hops < 5
), last AS (SELECT url, arg_max(final, n_hops) AS final, max(n_hops) AS n_hops FROM walk GROUP BY url)
SELECT url, final, n_hops, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE source = final) THEN 'too_many' ELSE 'done' END AS status FROM last""")
def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    edges = pages.where("page_id % 4 <> 1").select(name(F.col("page_id")).alias("source"), name((F.col("page_id") * 7 + 3) % 250).alias("target"))
    return resolve.redirect_ends(pages.select(name(F.col("page_id")).alias("url")), edges)


@query(r"""WITH h AS (SELECT page_id, [' Application/PDF ; charset=x', 'text/HTML', 'application/json;a;b', ' Image/PNG '][page_id % 4 + 1] AS header FROM pages)
SELECT page_id, lower(trim(string_split(header, ';')[1])) AS media, lower(trim(string_split(header, ';')[1])) IN ('application/pdf', 'text/html') AS accepted FROM h""")
def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array(*[F.lit(x) for x in (" Application/PDF ; charset=x", "text/HTML", "application/json;a;b", " Image/PNG ")])
    media = web.media_type(F.get(headers, (F.col("page_id") % 4).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", media.alias("media"), media.isin("application/pdf", "text/html").alias("accepted"))


@query(r"""WITH s AS (SELECT page_id, '<script>var a = ' || page_id % 5 || ';</script><p>x</p><script type="t">b()</script>' || html AS html FROM pages),
x AS (SELECT page_id, regexp_extract_all(html, '(?s)<script(?:\s[^>]*)?>(.*?)</script>', 1) AS l FROM s),
f AS (SELECT page_id, b, min(i) AS i FROM (SELECT page_id, unnest(l) AS b, unnest(range(1, len(l) + 1)) AS i FROM x) WHERE b <> '' GROUP BY page_id, b)
SELECT page_id, string_agg('sha256-' || base64(unhex(sha256(b))), ' ' ORDER BY i) AS policy FROM f GROUP BY page_id""")
def content_policy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<script>var a = "), (F.col("page_id") % 5).cast("string"), F.lit(';</script><p>x</p><script type="t">b()</script>'), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(web.script_hashes(html), " ").alias("policy"))


@query("""WITH a AS (SELECT page_id, CAST(page_id * 16843009 % 4294967296 AS BIGINT) AS n FROM pages),
r AS (SELECT CAST(i * 400000000 AS BIGINT) AS first, CAST(i * 400000000 + 90000000 + (i % 3) * 200000000 AS BIGINT) AS last FROM range(0, 11) t(i))
SELECT page_id, n, EXISTS (SELECT 1 FROM r WHERE n BETWEEN first AND last) AS blocked FROM a""")
def ip_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, i: F.shiftright(c, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("string")
    n = (F.col("page_id") * 16843009) % 4294967296
    text = F.concat_ws(".", *[part(n, i) for i in range(4)])
    addresses = table(spark, sf_dir, "pages").select("page_id", F.lit(4).alias("family"), web.ip_number(text).alias("n"))
    i = F.col("id")
    rules = spark.range(0, 11).select(F.lit(4).alias("family"), (i * 400000000).alias("first"), (i * 400000000 + 90000000 + (i % 3) * 200000000).alias("last"))
    return resolve.addresses_in(addresses, rules).select("page_id", "n", "blocked")


@query("""WITH p AS (SELECT page_id, page_id::UHUGEINT AS p FROM pages), a AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 4 WHEN 5 THEN NULL ELSE 6 END AS family, CASE page_id % 6
    WHEN 0 THEN p * 16843009 % 4294967296
    WHEN 1 THEN ((p * 23757 % 65536) << 112) + ((p * 31676 % 65536) << 96) + ((p * 39595 % 65536) << 80) + ((p * 47514 % 65536) << 64) + ((p * 55433 % 65536) << 48) + ((p * 63352 % 65536) << 32) + ((p * 71271 % 65536) << 16) + p * 79190 % 65536
    WHEN 2 THEN (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + p * 7919 % 65536
    WHEN 3 THEN (65535::UHUGEINT << 32) + p * 16843009 % 4294967296
    WHEN 4 THEN (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + ((p % 7) << 80) + p % 9 END AS n FROM p
), r(family, first, last) AS (VALUES
  (4, 268435456::UHUGEINT, 536870911::UHUGEINT), (4, 285278208, 285343743), (4, 1677721607, 2030043145),
  (6, (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96), (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + 32767),
  (6, (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + (2::UHUGEINT << 80), (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + (4::UHUGEINT << 80) + 5),
  (6, (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + (3::UHUGEINT << 80), (8193::UHUGEINT << 112) + (3512::UHUGEINT << 96) + (4::UHUGEINT << 80) - 1),
  (6, (65535::UHUGEINT << 32), (65535::UHUGEINT << 32) + 2147483647), (6, 1::UHUGEINT << 127, (1::UHUGEINT << 127) + (1::UHUGEINT << 125) - 1)
) SELECT page_id, family, EXISTS (SELECT 1 FROM r WHERE r.family = a.family AND n BETWEEN first AND last) AS blocked FROM a""")
def ip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both families in all their spellings, and some that are none, against subnets and
    ranges, wide and nested."""
    p = F.col("page_id")
    hexed = lambda n: F.hex(n.cast("long"))
    dotted = lambda n: F.concat_ws(".", *[F.shiftright(n, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in range(4)])
    n = (p * 16843009) % 4294967296
    groups = [hexed((p * (7919 * (i + 3))) % 65536) for i in range(8)]
    odd = F.get(F.array(*[F.lit(x) for x in ("1::2::3", "300.1.1.1", "01.2.3.4", "12345::", "")]), (p % 5).cast("int"))
    kinds = [dotted(n), F.concat_ws(":", *groups), F.concat(F.lit("2001:DB8::"), hexed((p * 7919) % 65536)), F.concat(F.lit("::ffff:"), dotted(n)), F.concat(F.lit("2001:db8:"), hexed(p % 7), F.lit("::"), hexed(p % 9)), odd]
    address = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        address = F.when(p % 6 == i, kind).otherwise(address)
    rules = [("16.0.0.0", None, 4), ("17.1.0.0", None, 16), ("100.0.0.7", "121.0.0.9", None), ("2001:db8::", None, 113), ("2001:db8:2::", "2001:db8:4::5", None), ("2001:db8:3::1", None, 48), ("::ffff:0:0", None, 97), ("8000::", None, 3)]
    table_ = spark.createDataFrame(rules, "first string, last string, bits int")
    found = resolve.blocked_by_rules(table(spark, sf_dir, "pages").select("page_id", address.alias("address")), table_)
    return found.select("page_id", F.substring(web.ip_key(F.col("address")), 1, 1).cast("int").alias("family"), "blocked")


@query("""WITH s AS (SELECT page_id AS store, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'f' || page_id END AS path, length(html) AS size, page_id * 10 AS mtime, length(html) + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS has_size FROM pages)
SELECT store, path IS NOT NULL AND size = has_size AS open FROM s""")
def kv_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("store"), F.length("html").cast("long").alias("n"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    path = F.when(F.col("store") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("f"), F.col("store").cast("string")))
    settings = pages.select("store", F.explode(F.array(pair("source_path", path), pair("source_size", F.col("n")), pair("source_mtime", F.col("store") * 10))).alias("p")).select("store", "p.*")
    facts = pages.select("store", (F.col("n") + F.when(F.col("store") % 3 == 0, 1).otherwise(0)).alias("size"), (F.col("store") * 10).alias("mtime"))
    return resolve.gate(settings, facts)


METHODS, PATHS, ORIGINS = ["GET", "POST", "OPTIONS", "HEAD"], ["/pdf", "/health", "/source", "/other"], [None, "https://a.test", "https://b.test", ""]
ASKED, HEADERS = [None, "GET", "POST"], [None, "Content-Type", "x-other", "", None]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every kind: each column's values follow each other in their own period."""
    pick = lambda xs, i: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), i.cast("int"))
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", pick(METHODS, p % 4).alias("method"), pick(PATHS, F.floor(p / 4) % 4).alias("path"), pick(ORIGINS, p % 7 % 4).alias("origin"), pick(ASKED, p % 11 % 3).alias("asked"), pick(HEADERS, p % 5).alias("headers"))


def quoted(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"""WITH r AS (SELECT page_id, {quoted(METHODS)}[page_id % 4 + 1] AS method, {quoted(PATHS)}[page_id // 4 % 4 + 1] AS path, {quoted(ORIGINS)}[page_id % 7 % 4 + 1] AS origin,
  {quoted(ASKED)}[page_id % 11 % 3 + 1] AS asked, {quoted(HEADERS)}[page_id % 5 + 1] AS headers FROM pages)
SELECT page_id, CAST(CASE
  WHEN origin <> '' AND origin <> 'https://a.test' THEN 403
  WHEN path NOT IN ('/pdf', '/source', '/health') THEN 404
  WHEN method = 'OPTIONS' AND path = '/source' THEN CASE WHEN coalesce(asked, '') NOT IN ('', 'POST') OR lower(coalesce(headers, '')) NOT IN ('', 'content-type') THEN 403 ELSE 204 END
  WHEN method = 'OPTIONS' THEN CASE WHEN coalesce(asked, '') NOT IN ('', 'GET') OR coalesce(headers, '') <> '' THEN 403 ELSE 204 END
  WHEN path = '/source' AND method <> 'POST' THEN 405 WHEN path <> '/source' AND method <> 'GET' THEN 405 ELSE 200 END AS BIGINT) AS status FROM r""")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = web.status_of(F.col("method"), F.col("path"), F.col("origin"), ["https://a.test"], F.col("asked"), F.col("headers"))
    return requests(spark, sf_dir).select("page_id", status.alias("status"))


@query("""WITH b AS (SELECT page_id, ['/runtime/x', '/source', '/runtimes', '/pdf'][page_id % 4 + 1] AS path, [0, 132000, 132001, 134217728, 134217729][page_id % 5 + 1] AS size FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/runtime/') THEN size <= 134217728 ELSE size <= 132000 END AS fits FROM b""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", pick(["/runtime/x", "/source", "/runtimes", "/pdf"], p % 4).alias("path"), pick([0, 132000, 132001, 134217728, 134217729], p % 5).alias("size"))
    return rows.select("page_id", web.body_fits(F.col("path"), F.col("size")).alias("fits"))


@query(r"""WITH e AS (SELECT page_id, ['a/b.txt', '/abs', 'a/../b', 'c:\x', 'ok/..x/y', ''][page_id % 6 + 1] AS path, ['-', 'd', 'l'][page_id % 5 % 3 + 1] AS kind FROM pages)
SELECT page_id, kind IN ('-', 'd') AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '[\\:]') AND NOT list_contains(string_split(path, '/'), '..') AND path <> '' AS safe FROM e""")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", pick(["a/b.txt", "/abs", "a/../b", "c:\\x", "ok/..x/y", ""], p % 6).alias("path"), pick(["-", "d", "l"], p % 5 % 3).alias("kind"))
    return rows.select("page_id", web.safe_path(F.col("path"), F.col("kind")).alias("safe"))


@query("""WITH c AS (SELECT page_id % 60 AS record, page_id AS ord, url, page_id % 3 <> 0 AS good FROM pages)
SELECT record, arg_min(url, ord) FILTER (WHERE good) AS url FROM c GROUP BY record""")
def first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 60).alias("record"), F.col("page_id").alias("ord"), "url")
    return resolve.first_available(rows, "record", "ord", F.col("ord") % 3 != 0, "url")


URLS = [
    "https://www.courtlistener.com/api/rest/v4/search/?q=1", "https://www.courtlistener.com/api/rest/v4/clusters/7/", "https://www.courtlistener.com/api/rest/v4/citation-lookup/", "https://www.courtlistener.com/api/rest/v4/opinions/",
    "https://www.courtlistener.com/api/rest/v4/opinions/12/#x", "https://www.courtlistener.com/api/rest/v4/people/", "https://api.govinfo.gov/search", "https://api.govinfo.gov/packages/USCOURTS-1_a/summary", "https://api.govinfo.gov/packages/USCODE-1/summary",
    "https://api.govinfo.gov/packages/USCOURTS-1/pdf?api_key=k", "https://www.govinfo.gov/content/pkg/USCOURTS-a/pdf/USCOURTS-a.pdf", "https://www.govinfo.gov/content/pkg/USCOURTS-a/pdf/USCOURTS-b.pdf", "https://assets.publishing.service.gov.uk/media/5a/Judgment.PDF",
    "https://assets.publishing.service.gov.uk/government/uploads/system/uploads/attachment_data/file/12/x y.pdf", "https://assets.publishing.service.gov.uk/other/x.pdf", "https://storage.courtlistener.com/pdf/2020/x.pdf", "https://storage.courtlistener.com/pdf%2fx.pdf",
    "http://www.courtlistener.com/api/rest/v4/search/", "https://www.courtlistener.com:8443/api/rest/v4/search/", "https://user@www.courtlistener.com/api/rest/v4/search/", "https://WWW.courtlistener.com:443/api/rest/v4/search/", "https://storage.courtlistener.com/x.html", "not a url",
]


@query(rf"""WITH u AS (SELECT page_id, {quoted(URLS)}[page_id % {len(URLS)} + 1] AS url, ['GET', 'POST', 'PUT'][page_id // {len(URLS)} % 3 + 1] AS method FROM pages),
p AS (SELECT *, regexp_extract(url, '^https://([^/?#]*)', 1) AS authority, split_part(split_part(regexp_extract(url, '^https://[^/?#]*(.*)$', 1), '#', 1), '?', 1) AS path FROM u),
h AS (SELECT *, lower(regexp_replace(authority, ':443$', '')) AS host FROM p)
SELECT page_id, CASE
  WHEN host LIKE '%:%' OR host LIKE '%@%' OR regexp_matches(path, '(?i)%(00|2f|5c)') THEN NULL
  WHEN host = 'www.courtlistener.com' AND method = 'POST' AND path = '/api/rest/v4/citation-lookup/' THEN host
  WHEN host = 'www.courtlistener.com' AND method = 'GET' AND regexp_full_match(path, '/api/rest/v4/(citation-lookup/|search/|clusters/[0-9]+/|opinions/|opinions/[0-9]+/)') THEN host
  WHEN host = 'api.govinfo.gov' AND method = 'POST' AND path = '/search' THEN host
  WHEN host = 'api.govinfo.gov' AND method = 'GET' AND regexp_full_match(path, '/packages/USCOURTS-[A-Za-z0-9_-]+/(summary|pdf)') THEN host
  WHEN host = 'www.govinfo.gov' AND method = 'GET' AND regexp_full_match(path, '/content/pkg/USCOURTS-[A-Za-z0-9_-]+/pdf/[^/]+') AND split_part(path, '/', 6) = split_part(path, '/', 4) || '.pdf' THEN host
  WHEN host = 'assets.publishing.service.gov.uk' AND method = 'GET' AND regexp_full_match(lower(path), '/(media/[a-z0-9_-]+|government/uploads/system/uploads/attachment_data/file/[0-9]+)/[^/]+\.pdf') THEN host
  WHEN host = 'storage.courtlistener.com' AND method = 'GET' AND regexp_full_match(lower(path), '/[a-z0-9_%./-]+\.pdf') THEN host END AS provider FROM h""")
def provider_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    p = F.col("page_id").cast("long")
    rows = table(spark, sf_dir, "pages").select("page_id", pick(URLS, p % len(URLS)).alias("url"), pick(["GET", "POST", "PUT"], F.floor(p / len(URLS)) % 3).alias("method"))
    return rows.select("page_id", web.provider(F.col("url"), F.col("method")).alias("provider"))


@query("""WITH c AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN repeat('k', 4096) WHEN 2 THEN repeat('k', 4097) WHEN 3 THEN 'a' || chr(10) || 'b' ELSE '' END AS token FROM pages)
SELECT page_id, token IS NULL OR (length(token) <= 4096 AND NOT contains(token, chr(10)) AND NOT contains(token, chr(13))) AS fits FROM c""")
def credential_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.lit(None).cast("string"), F.repeat(F.lit("k"), 4096), F.repeat(F.lit("k"), 4097), F.lit("a\nb"), F.lit(""))
    token = F.get(values, (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", web.credential_fits(token).alias("fits"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1)), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') AS origin
FROM (SELECT page_id, regexp_replace(upper(url), '^(HTTPS?://[^/?#]+)', CASE WHEN page_id % 3 = 0 THEN '\1:443' WHEN page_id % 3 = 1 THEN '\1:80' ELSE '\1:8080' END) AS u FROM pages)""")
def url_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    port = F.when(F.col("page_id") % 3 == 0, ":443").when(F.col("page_id") % 3 == 1, ":80").otherwise(":8080")
    head = F.regexp_extract(F.upper("url"), "^(HTTPS?://[^/?#]+)", 1)
    url = F.concat(head, port, F.expr("substring(upper(url), length(regexp_extract(upper(url), '^(HTTPS?://[^/?#]+)', 1)) + 1)"))
    return table(spark, sf_dir, "pages").select("page_id", web.origin(url).alias("origin"))


QUERIES, ORACLES = query.queries, query.oracles
