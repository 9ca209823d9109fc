"""Stateful operators over streams with keyed state that ends: what was seen, the latest, the breaker."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of what was seen: a bucket's identities are read at once.
BUCKETS = 256
#: Calls of a trigger over which the keys of the latest rows and of the breaker are dealt.
CALLS = 1024
DAY_MS = 86_400_000


def keep_state(spark: SparkSession) -> None:
    """These operators keep their state in RocksDB, which a session must say before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def time_mode(ms: int) -> str:
    return "ProcessingTime" if ms else "None"


class Unseen(StatefulProcessor):
    """What was seen of a bucket of names: identity to the time it was last listed, forgotten after a
    time without it. A later choice of the folder than the one known clears it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "identity string", "at long", self.ttl_ms or None)
        self.choice = handle.getValueState("choice", "choice long", self.ttl_ms or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        listed = pd.concat(list(rows), ignore_index=True)
        newest, known = int(listed["choice"].max()), self.choice.get() if self.choice.exists() else None
        if known is None or newest > known[0]:
            self.seen.clear()
            known = (newest,)
        self.choice.update((known[0],))
        listed = listed[listed["choice"] == known[0]]
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        fresh = []
        for i, name, size, mtime in listed[["name", "size", "mtime_us"]].itertuples():
            identity = f"{name}|{size}|{mtime}"
            at = seen.get(identity)
            if at is None:
                fresh.append(i)
            if at is None or (self.ttl_ms and now - at > self.ttl_ms // 2):  # what is still there isn't forgotten
                self.seen.updateValue((identity,), (now,))
                seen[identity] = now
        yield listed.loc[fresh, ["name", "size", "mtime_us"]]

    def close(self) -> None:
        pass


def unseen(files: DataFrame, ttl_ms: int = DAY_MS, buckets: int = BUCKETS) -> DataFrame:
    """(name, size, mtime_us): each identity once per choice of the folder.

    files: name, size, mtime_us, choice, a number that grows when the folder is chosen anew; what was
    seen before that is forgotten, as is what wasn't listed for ttl_ms. State is bounded by the files
    that were there within that time. Rows of an older choice than one that came are passed over. ttl_ms 0: for
    good, which a stream that ends (availableNow) needs, as times of their own keep it running.
    """
    keep_state(files.sparkSession)
    rows = files.select("name", "size", "mtime_us", F.col("choice").cast("long").alias("choice"), F.pmod(F.crc32(F.col("name")), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(Unseen(ttl_ms), "name string, size long, mtime_us long", "append", time_mode(ttl_ms))


def bucketed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with _key, the names' values as one string, and the bucket of the first of them. A processor
    is called once for each bucket and trigger, as a call costs far more than a row; the state knows
    what a bucket holds by _key."""
    key = F.to_json(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)]))
    return rows.withColumns({"state_key": key, "state_bucket": F.pmod(F.xxhash64(names[0]), F.lit(CALLS))})


class Latest(StatefulProcessor):
    """The latest row of each item of a bucket's keys, replaced by later ones, forgotten some time after
    its last row."""

    def __init__(self, order: Sequence[str], columns: Sequence[str], kind: str, ttl_ms: int):
        self.order, self.columns, self.kind, self.ttl_ms = list(order), list(columns), kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "item string", self.kind, self.ttl_ms or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        last = given.drop_duplicates("state_key", keep="last")
        changed = []
        for i, item, *at in last[["state_key", *self.order]].itertuples():
            at = tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in at)
            old = self.held.getValue((item,))
            if old is None or at >= tuple(old):
                self.held.updateValue((item,), at)
                changed.append(i)
            elif self.ttl_ms:
                self.held.updateValue((item,), tuple(old))
        yield last.loc[changed, self.columns]

    def close(self) -> None:
        pass


def latest(rows: DataFrame, key: str, item: str, order: Sequence[str], idle_ms: int = DAY_MS) -> DataFrame:
    """The last row of each item of a key so far, in update mode: what changed in a trigger. Later
    progress replaces what wasn't sent yet; over all triggers it is stateful.latest of all rows, also
    where a trigger brings rows that are older than some before.

    rows: without nulls in order. The state holds the order of each item's latest row. An item whose
    last row is idle_ms old is forgotten; with 0 none is."""
    keep_state(rows.sparkSession)
    columns = [key, item, *(c for c in rows.columns if c not in (key, item))]
    of = lambda names: ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    processor = Latest(order, columns, of(order), idle_ms)
    return bucketed(rows, [key, item]).groupBy("state_bucket").transformWithStateInPandas(processor, StructType([rows.schema[c] for c in columns]), "update", time_mode(idle_ms))


class Breaker(StatefulProcessor):
    """What first blocked the origins of a bucket in their runs; later attempts there get its message."""

    def __init__(self, order: Sequence[str], columns: Sequence[str], ttl_ms: int):
        self.order, self.columns, self.ttl_ms = list(order), list(columns), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocked = handle.getMapState("blocked", "origin string", "message string", self.ttl_ms or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        codes, origins = pd.factorize(given["state_key"])
        known = {i: found[0] for i, o in enumerate(origins) if (found := self.blocked.getValue((o,))) is not None}
        own = given["block_message"].where(given["block_message"].notna(), None)
        blocks = own[own.notna()]
        first = blocks.groupby(codes[blocks.index]).head(1)
        own_first = dict(zip(codes[first.index].tolist(), first.items()))
        for code, (_, message) in own_first.items():
            if code not in known:
                self.blocked.updateValue((origins[code],), (message,))
        outcomes, skipped = [], []
        for at, code in enumerate(codes.tolist()):
            where, message = (-1, known[code]) if code in known else own_first.get(code, (at + 1, "ok"))
            outcomes.append(message if at >= where else "ok")
            skipped.append(at > where)
        yield given[self.columns].assign(outcome=outcomes, skipped=skipped)

    def close(self) -> None:
        pass


def after_block(attempts: DataFrame, run: str, origin: str, order: Sequence[str], blocked: Column, message: Column, ttl_ms: int = DAY_MS) -> DataFrame:
    """attempts with `outcome` and `skipped`, as resolve.after_block gives them for each run: once an
    origin has blocked, later attempts of the run there fail with that message and aren't made.

    Attempts of a trigger come in their order, after all of earlier triggers. What is known of a run
    and origin is forgotten ttl_ms after its block; with 0 it isn't."""
    keep_state(attempts.sparkSession)
    marked = bucketed(attempts.withColumn("block_message", F.when(blocked, message)), [origin, run])
    out = StructType([*attempts.schema.fields]).add("outcome", "string").add("skipped", "boolean")
    return marked.groupBy("state_bucket").transformWithStateInPandas(Breaker(order, attempts.columns, ttl_ms), out, "append", time_mode(ttl_ms))
