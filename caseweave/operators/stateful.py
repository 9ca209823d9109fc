"""Caches, sessions, queues and histories as batch computations over their logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import durable
from .folds import TARGET, sorted_pass


def kept_within(entries: DataFrame, budget: int, newest: Sequence[Column], partition: Sequence[str] = ()) -> DataFrame:
    """The newest entries whose sizes add up to the budget at most: a snapshot of an eviction that
    drops the oldest first. entries: size and what orders them. One over the budget is never kept and
    evicts nothing."""
    order = Window.partitionBy(*partition).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    return entries.where(F.col("size") <= budget).withColumn("total", F.sum("size").over(order)).where(F.col("total") <= budget)


def last_use(log: DataFrame, keys: Sequence[str], reads_count: bool) -> DataFrame:
    """(keys, size, used): the last size written and when the entry was last used.

    log: keys, op (read or write), size, seq. reads_count: whether a read makes an entry younger
    (least recently used), or only a write does (first in, first out)."""
    write = F.col("op") == "write"
    used = F.max("seq") if reads_count else F.max(F.when(write, F.col("seq")))
    return log.groupBy(*keys).agg(F.max_by(F.when(write, F.col("size")), F.when(write, F.col("seq"))).alias("size"), used.alias("used")).where("size is not null")


def replayed_cache(log: DataFrame, cache: str, budget: int, reads_count: bool, oversized: str = "drop") -> DataFrame:
    """(cache, key, size, used): what is in each cache after its log, replayed write by write.

    After an eviction a smaller replacement doesn't bring the evicted entry back, hence the fold; a
    cache is one group. An entry over the budget never evicts others. oversized: whether it takes its
    key's old value with it (drop, as in memory) or leaves that as it is (ignore, as in a store).
    log: cache, key, op, size, seq.
    """
    if oversized not in ("drop", "ignore"):
        raise ValueError(oversized)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, list] = {}
        total = 0
        for r in rows.sort_values("seq").itertuples(index=False):
            if r.op == "read":
                if reads_count and r.key in held:
                    held[r.key][1] = r.seq
                continue
            if r.size > budget and oversized == "ignore":
                continue
            total -= held.pop(r.key)[0] if r.key in held else 0
            if r.size > budget:
                continue
            total += r.size
            held[r.key] = [r.size, r.seq]
            for key in sorted(held, key=lambda k: held[k][1]):
                if total <= budget:
                    break
                total -= held.pop(key)[0]
        return pd.DataFrame([(rows[cache].iloc[0], k, s, u) for k, (s, u) in held.items()], columns=[cache, "key", "size", "used"])

    return log.groupBy(cache).applyInPandas(fold, f"{cache} {log.schema[cache].dataType.simpleString()}, key string, size long, used long")


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: later progress replaces what wasn't sent yet."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def history_tail(rows: DataFrame, key: str, order: Sequence[str], most: int = 40) -> DataFrame:
    """The last so many rows of each key, numbered from the newest."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("depth", F.row_number().over(newest).cast("long")).where(F.col("depth") <= most)


def replayed_history(rows: DataFrame, key: str, order: Sequence[str], most: int = 40) -> DataFrame:
    """(key, order, current, undos, redos): what each key holds after each of its rows, and how many
    steps back and forth it then has.

    rows: key, the order's columns, op and value. A change puts what was there on the undo stack, which
    keeps the last `most`, and clears the redo stack; undo and redo take from one stack and put on the
    other, and do nothing where there is nothing to take. One sorted pass per key, whose state is two
    stacks of `most` values together. Rows of another op, or of none, change nothing; before the first
    change a key holds null.
    """
    order = list(order)
    kind = rows.schema["value"].dataType
    fields = [rows.schema[c] for c in (key, *order)] + [StructField("current", kind), StructField("undos", LongType()), StructField("redos", LongType())]

    def step(state: list, row: tuple) -> list[tuple]:
        if not state:
            state[:] = [None, [], []]
        op, value = row[-2:]
        current, undo, redo = state
        if op == "change":
            undo.append(current)
            del undo[:-most], redo[:]
            state[0] = value
        elif op in ("undo", "redo"):
            source, target = (undo, redo) if op == "undo" else (redo, undo)
            if source:
                target.append(current)
                state[0] = source.pop()
        return [(*row[1:-2], state[0], len(undo), len(redo))]

    return sorted_pass(rows.select(key, *order, "op", "value"), [key], order, StructType(fields), list, step)


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_no, first, last, n): a session ends when nothing came for more than the gap."""
    order = Window.partitionBy(key).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce(seconds - F.lag(seconds).over(order) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = events.withColumn("_new", fresh).withColumn("session_no", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def expired(answers: DataFrame, ts: str, days: Column, now: Column) -> DataFrame:
    """answers with `fresh`: whether now is less than so many days after."""
    return answers.withColumn("fresh", F.col(ts) + F.make_dt_interval(days.cast("int")) > now)


def shared_requests(requests: DataFrame, key: Sequence[str], ts: str, window_seconds: int, target: int = TARGET) -> DataFrame:
    """requests with `leader`: the first of identical requests since an answer of so many seconds ran
    out does the work, the others share it.

    A later one counts from its leader, so leaders follow from each other. Keys of at most `target`
    requests are one sorted pass each, which keeps the last leader only. Where a key has more, each
    time points at its successor, the first at or after it and the window; the leaders are what the
    key's first request reaches, found by doubling the pointers, and no step needs a key's rows
    together: times meet by windows of the time's length, of which a leader's sharers fill two.
    Requests without a time share the first of them. Columns besides key and request_id are dropped.
    """
    span, key = window_seconds * 1_000_000, list(key)
    rows = requests.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col("request_id").alias("id"))
    largest = rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if largest > target:
        return leaders_by_pointers(rows, key, span)
    n = len(key)

    def step(state: list, row: tuple) -> list[tuple]:
        at, id_ = row[n:]
        if not state or (at is not None and (state[0] is None or at - state[0] >= span)):
            state[:] = [at, id_]
        return [(id_, state[1])]

    kind = rows.schema["id"].dataType
    out = StructType([*rows.select(*key).schema.fields, StructField("request_id", kind), StructField("leader", kind)])
    return sorted_pass(rows, key, ["at", "id"], out, list, step)


def leaders_by_pointers(rows: DataFrame, key: list[str], span: int) -> DataFrame:
    """shared_requests for keys of any size. rows: key, at in microseconds, id."""
    none = rows.where("at is null")
    lone = none.join(none.groupBy(*key).agg(F.min("id").alias("leader")).select(*[F.col(k).alias(f"_{k}") for k in key], "leader"), null_safe(key))
    lone = lone.select(*key, F.col("id").alias("request_id"), "leader")
    part = F.floor(F.col("at") / span)
    timed = rows.where("at is not null")
    times = durable(timed.groupBy(*key, "at").agg(F.min("id").alias("id")).withColumn("part", part))
    # the first time of the next part that has any, and of the one after an empty next part
    parts = times.groupBy(*key, "part").agg(F.min("at").alias("first"))
    order = Window.partitionBy(*key).orderBy("part")
    after = parts.select(*key, "part", F.lead("first").over(order).alias("_one"), F.lead("part").over(order).alias("_part"), F.lead("first", 2).over(order).alias("_two"))
    # the first time at or after at + span: in the next part, or the first of a later one
    asks = times.select(*key, (F.col("part") + 1).alias("part"), (F.col("at") + span).alias("at"), F.col("at").alias("asker"))
    both = times.select(*key, "part", "at", F.lit(None).cast("long").alias("asker")).unionByName(asks)
    later = Window.partitionBy(*key, "part").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_there", F.min(F.when(F.col("asker").isNull(), F.col("at"))).over(later)).where("asker is not null")
    own = after.select(*[F.col(k).alias(f"_{k}") for k in key], (F.col("part") + 1).alias("_own"), "_part", "_one", "_two")
    follows = F.coalesce("_there", F.when(F.col("_part") == F.col("part"), F.col("_two")).otherwise(F.col("_one")))
    jump = durable(found.join(own, null_safe(key) & (F.col("part") == F.col("_own"))).select(*key, F.col("asker").alias("at"), follows.alias("to")).where("to is not null"))
    reached = durable(times.groupBy(*key).agg(F.min("at").alias("at")))
    while jump.limit(1).count():
        old = [F.col(k).alias(f"_{k}") for k in key]
        steps = jump.select(*old, F.col("at").alias("_at"), F.col("to").alias("_to"))
        more = reached.join(steps, null_safe(key) & (F.col("at") == F.col("_at"))).select(*key, F.col("_to").alias("at"))
        reached = durable(reached.unionByName(more))
        jump = durable(jump.join(steps, null_safe(key) & (F.col("to") == F.col("_at"))).select(*key, "at", F.col("_to").alias("to")))
    old = [F.col(k).alias(f"_{k}") for k in key]
    leaders = reached.join(times.select(*old, F.col("at").alias("_at"), "id", "part"), null_safe(key) & (F.col("at") == F.col("_at"))).select(*key, "at", F.col("id").alias("leader"), "part")
    # a leader's sharers are in its own part and the next
    spread = leaders.unionByName(leaders.withColumn("part", F.col("part") + 1)).withColumns({"id": F.lit(None).cast(rows.schema["id"].dataType), "side": F.lit(0)})
    all_rows = spread.unionByName(timed.select(*key, "at", F.lit(None).cast(rows.schema["id"].dataType).alias("leader"), part.alias("part"), "id", F.lit(1).alias("side")))
    last = F.last("leader", ignorenulls=True).over(Window.partitionBy(*key, "part").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, 0))
    shared = all_rows.withColumn("leader", last).where("side = 1").select(*key, F.col("id").alias("request_id"), "leader")
    return shared.unionByName(lone)


def null_safe(key: Sequence[str]) -> Column:
    """Equality of the columns of key and those of the same names after an underscore, nulls too."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])


def answered(requests: DataFrame, responses: DataFrame, key: str, limit_seconds: int) -> DataFrame:
    """requests with the first response of their key within the limit; timed_out if there is none.

    requests: request_id, key, ts; responses: key, ts. One window over the union finds the next
    response of each request."""
    at = lambda df: F.unix_micros(df["ts"].cast("timestamp"))
    both = requests.select("request_id", key, at(requests).alias("at"), F.lit(None).cast("long").alias("answer")).unionByName(responses.select(F.lit(None).cast("long").alias("request_id"), key, at(responses).alias("at"), at(responses).alias("answer")))
    later = Window.partitionBy(key).orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    wait = F.min("answer").over(later) - F.col("at")
    timed = both.withColumn("wait_us", wait).where("request_id is not null")
    ok = F.col("wait_us") <= limit_seconds * 1_000_000
    return timed.select("request_id", key, F.when(ok, F.col("wait_us")).alias("wait_us"), (~F.coalesce(ok, F.lit(False))).alias("timed_out"))


def started(queue: DataFrame, source: str, most: int, held: Column) -> DataFrame:
    """What of each source's queue starts: by priority, then order; not those held, unless they have
    priority."""
    order = Window.partitionBy(source).orderBy(F.desc("priority"), "order", "seq")
    return queue.where((F.col("priority") > 0) | ~held).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def reusable(old: DataFrame, new: DataFrame, build: str = "build") -> DataFrame:
    """(build, reuse): whether every input of a build has the same stamp as before, and none came or went."""
    o = old.select(build, "path", F.col("stamp").alias("_old"))
    n = new.select(build, "path", F.col("stamp").alias("_new"))
    return o.join(n, [build, "path"], "full").groupBy(build).agg(F.bool_and(F.coalesce(F.col("_old") == F.col("_new"), F.lit(False))).alias("reuse"))
