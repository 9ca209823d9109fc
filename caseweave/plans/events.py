"""Queries over the events: caches, sessions, queues, breakers, as-of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..operators import layout, resolve, stateful
from ..sources.tables import table
from .registry import Registry

query = Registry()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""SELECT event_id, user_id, coalesce(
  first_value(CASE WHEN event_type = 'error' THEN 'blocked at ' || event_id END IGNORE NULLS) OVER w, CASE WHEN event_type = 'error' THEN 'blocked at ' || event_id END, 'ok') AS outcome,
  first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w IS NOT NULL AS skipped
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def origin_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("blocked at "), F.col("event_id").cast("string"))
    found = resolve.after_block(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error", message)
    return found.select("event_id", "user_id", "outcome", "skipped")


@query("""WITH a AS (SELECT event_id, ts, CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN 30 ELSE 1 END AS days FROM events), n AS (SELECT max(ts) AS now FROM events)
SELECT event_id, CAST(days AS BIGINT) AS days, ts + days * INTERVAL 1 DAY > now AS fresh FROM a, n""")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    now = rows.agg(F.max("ts")).scalar()
    url = F.when(F.col("event_type") == "view", F.lit("https://api.test/fetch?doc_type=cases")).otherwise(F.lit("https://api.test/fetch?doc_type=laws"))
    body = F.when(F.col("event_id") % 4 == 0, F.lit('{"results" : [ ]}')).otherwise(F.lit('{"results":[1]}'))
    found = stateful.expired(rows.withColumn("days", web.answer_days(url, body)), "ts", F.col("days"), now)
    return found.select("event_id", "days", "fresh")


LOG = """log AS (
  SELECT user_id AS cache, 'k' || event_id % 23 AS key, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS op, CAST(event_id * 37 % 1200 + 1 AS BIGINT) AS size, event_id AS seq FROM events
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write")
    return events(spark, sf_dir).select(F.col("user_id").alias("cache"), F.concat(F.lit("k"), (F.col("event_id") % 23).cast("string")).alias("key"), op.alias("op"), (F.col("event_id") * 37 % 1200 + 1).alias("size"), F.col("event_id").alias("seq"))


def snapshot_sql(used: str) -> str:
    return f"""WITH {LOG}, e AS (
  SELECT cache, key, arg_max(size, seq) FILTER (WHERE op = 'write') AS size, {used} AS used FROM log GROUP BY cache, key
), t AS (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY used DESC ROWS UNBOUNDED PRECEDING) AS total FROM e WHERE size <= 1000)
SELECT cache, key, size, used, CAST(total AS BIGINT) AS total FROM t WHERE total <= 1000"""


@query(snapshot_sql("max(seq) FILTER (WHERE op = 'write')"))
def cache_fifo_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.kept_within(stateful.last_use(log(spark, sf_dir), ["cache", "key"], reads_count=False), 1000, [F.desc("used")], ["cache"])


@query(snapshot_sql("max(seq)"))
def cache_lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.kept_within(stateful.last_use(log(spark, sf_dir), ["cache", "key"], reads_count=True), 1000, [F.desc("used")], ["cache"])


def replay_sql(oversized: str) -> str:
    """The cache as a list of entries by their last use; an eviction keeps its longest tail within the budget."""
    others = "list_filter(w.held, lambda x: x.k <> r.key)"
    return f"""WITH RECURSIVE {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY seq) AS rn FROM log),
walk(cache, rn, held) AS (
  SELECT DISTINCT cache, CAST(0 AS BIGINT), CAST([] AS STRUCT(k VARCHAR, s BIGINT, u BIGINT)[]) FROM r UNION ALL
  SELECT cache, rn, list_filter(h, lambda x, i: list_sum(list_transform(h[i:], lambda y: y.s)) <= 1000) FROM (
    SELECT r.cache, r.rn, CASE
      WHEN r.op = 'read' AND len({others}) = len(w.held) THEN w.held
      WHEN r.op = 'read' THEN list_append({others}, {{'k': r.key, 's': list_filter(w.held, lambda x: x.k = r.key)[1].s, 'u': r.seq}})
      WHEN r.size > 1000 THEN {"w.held" if oversized == "ignore" else others}
      ELSE list_append({others}, {{'k': r.key, 's': r.size, 'u': r.seq}}) END AS h
    FROM walk w JOIN r ON r.cache = w.cache AND r.rn = w.rn + 1)
), ends AS (SELECT cache, unnest(arg_max(held, rn)) AS e FROM walk GROUP BY cache)
SELECT cache, e.k AS key, e.s AS size, e.u AS used FROM ends"""


@query(replay_sql("drop"))
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.replayed_cache(log(spark, sf_dir), "cache", 1000, reads_count=True)


@query(replay_sql("ignore"))
def store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.replayed_cache(log(spark, sf_dir), "cache", 1000, reads_count=True, oversized="ignore")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return stateful.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT user_id, event_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS depth FROM events) WHERE depth <= 40""")
def undo_tail_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.history_tail(events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "depth")


@query("""WITH RECURSIVE r AS (
  SELECT user_id, event_id, CASE WHEN event_id % 5 IN (0, 2) THEN 'undo' WHEN event_id % 5 = 3 THEN 'redo' ELSE 'change' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), walk(user_id, rn, event_id, v, u, d) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM r UNION ALL
  SELECT r.user_id, r.rn, r.event_id,
    CASE WHEN op = 'change' THEN r.event_id WHEN op = 'undo' AND len(u) > 0 THEN u[-1] WHEN op = 'redo' AND len(d) > 0 THEN d[-1] ELSE v END,
    CASE WHEN op = 'change' THEN list_append(u, v)[-5:] WHEN op = 'undo' THEN u[:-2] WHEN len(d) > 0 THEN list_append(u, v) ELSE u END,
    CASE WHEN op = 'change' THEN [] WHEN op = 'redo' THEN d[:-2] WHEN len(u) > 0 THEN list_append(d, v) ELSE d END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1
) SELECT user_id, event_id, v AS current, CAST(len(u) AS BIGINT) AS undos, CAST(len(d) AS BIGINT) AS redos FROM walk WHERE rn > 0""")
def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes, undos and redos of a history of five steps."""
    rest = F.col("event_id") % 5
    op = F.when(rest.isin(0, 2), "undo").when(rest == 3, "redo").otherwise("change")
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", op.alias("op"), F.col("event_id").alias("value"))
    return stateful.replayed_history(rows, "user_id", ["ts", "event_id"], most=5).drop("ts")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session_no""")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sessions(events(spark, sf_dir), "user_id", "ts", 6 * 3600)


@query("""WITH RECURSIVE r AS (
  SELECT user_id, event_type, event_id, epoch_us(ts) AS happened, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events
), walk(user_id, event_type, rn, request_id, leader, since) AS (
  SELECT user_id, event_type, rn, event_id, event_id, happened FROM r WHERE rn = 1 UNION ALL
  SELECT r.user_id, r.event_type, r.rn, r.event_id, CASE WHEN r.happened - w.since >= 172800000000 THEN r.event_id ELSE w.leader END, CASE WHEN r.happened - w.since >= 172800000000 THEN r.happened ELSE w.since END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.rn = w.rn + 1
) SELECT user_id, event_type, request_id, leader FROM walk""")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumnRenamed("event_id", "request_id")
    return stateful.shared_requests(rows, ["user_id", "event_type"], "ts", 2 * 86400)


@query("""WITH q AS (SELECT event_id AS request_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'signup'), a AS (SELECT user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'),
w AS (SELECT q.request_id, q.user_id, min(a.at) - any_value(q.at) AS wait FROM q LEFT JOIN a ON a.user_id = q.user_id AND a.at >= q.at GROUP BY q.request_id, q.user_id)
SELECT request_id, user_id, CASE WHEN wait <= 432000000000 THEN wait END AS wait_us, coalesce(wait > 432000000000, true) AS timed_out FROM w""")
def request_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    asked = rows.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    return stateful.answered(asked, rows.where("event_type = 'purchase'").select("user_id", "ts"), "user_id", 5 * 86400)


@query("""SELECT p.event_id, p.user_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS page
FROM events p WHERE p.event_type = 'purchase'""")
def asof_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    marks = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("page"))
    return layout.last_before(rows.where("event_type = 'purchase'"), marks, "user_id", "ts", "page")


@query("""WITH o AS (SELECT user_id AS build, 'f' || event_id AS path, event_id % 97 AS stamp FROM events WHERE user_id % 10 <> 3 OR event_id % 2 = 0),
n AS (SELECT user_id AS build, 'f' || event_id AS path, event_id % 97 + CASE WHEN user_id % 10 = 4 AND event_id % 5 = 0 THEN 1 ELSE 0 END AS stamp FROM events)
SELECT build, bool_and(coalesce(o.stamp = n.stamp, false)) AS reuse FROM o FULL JOIN n USING (build, path) GROUP BY build""")
def build_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("build"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), (F.col("event_id") % 97).alias("stamp"), "event_id")
    old = rows.where("build % 10 <> 3 or event_id % 2 = 0").drop("event_id")
    new = rows.withColumn("stamp", F.col("stamp") + F.when((F.col("build") % 10 == 4) & (F.col("event_id") % 5 == 0), 1).otherwise(0)).drop("event_id")
    return stateful.reusable(old, new)


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS ready, CAST(json_extract(any_value(props), '$.k') IS NOT NULL AS BOOLEAN) AS has_k FROM events GROUP BY event_type""")
def ready_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("ready"), F.bool_or(k.isNotNull()).alias("has_k"))


QUERIES, ORACLES = query.queries, query.oracles
