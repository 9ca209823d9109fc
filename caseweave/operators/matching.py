"""Matching incoming files to the records that wait for them."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable
from functools import reduce
from heapq import heapify, heappop, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import durable
from .folds import TARGET, sorted_pass


def word_runs(rows: DataFrame, key: str, text: str, size: int = 12, opening: bool = False) -> DataFrame:
    """(key, phrase): the different runs of so many words of a text, or only its opening one.

    Words are split at ASCII white space and lower-cased; a shorter text has none."""
    with_words = rows.select(key, words_of(text).alias("w")).where(F.size("w") >= size)
    if opening:
        return with_words.select(key, run_at(F.lit(1), size).alias("phrase"))
    return with_words.select(key, F.explode(F.array_distinct(F.transform(places(size), lambda i: run_at(i, size)))).alias("phrase"))


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), "[\\t\\n\\f\\r ]+"), lambda w: w != "")


def places(size: int) -> Column:
    return F.sequence(F.lit(1), F.size("w") - size + 1)


def run_at(i: Column, size: int) -> Column:
    return F.array_join(F.slice("w", i, size), " ")


def shared_openings(rows: DataFrame, key: str, text: str, size: int = 12) -> DataFrame:
    """(phrase, n): opening runs that several texts share."""
    return word_runs(rows, key, text, size, opening=True).groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1")


def majority_matches(files: DataFrame, file_key: str, waiting: DataFrame, record_key: str, size: int = 12, text: str = "text") -> DataFrame:
    """(file, record, hits, unique_hits): files that hold most of a record's phrases, two of which no
    other waiting record has.

    A file's runs are hashed where it is read, and only those whose hash is one of a record's go on; of
    these the words are compared, so an equal hash alone is no hit."""
    wanted = word_runs(waiting, record_key, text, size)
    owners = wanted.groupBy("phrase").agg(F.count("*").alias("_owners"))
    sizes = wanted.groupBy(record_key).agg(F.count("*").alias("_phrases"))
    hashed = files.select(file_key, words_of(text).alias("w")).where(F.size("w") >= size).select(file_key, F.posexplode(F.transform(places(size), lambda i: F.xxhash64(F.slice("w", i, size)))).alias("at", "hash"))
    met = hashed.join(wanted.select(F.xxhash64(F.split("phrase", " ")).alias("hash")).distinct(), "hash", "left_semi").groupBy(file_key).agg(F.collect_set("at").alias("at"))
    held = files.select(file_key, words_of(text).alias("w")).join(met, file_key).select(file_key, F.explode(F.transform("at", lambda i: run_at(i + 1, size))).alias("phrase")).distinct()
    hits = held.join(wanted.join(owners, "phrase"), "phrase").groupBy(file_key, record_key).agg(F.count("*").alias("hits"), F.count_if(F.col("_owners") == 1).alias("unique_hits"))
    return hits.join(sizes, record_key).where("hits * 2 > _phrases and unique_hits >= 2").select(file_key, record_key, "hits", "unique_hits")


def name_keys(name: Column) -> Column:
    """A name's words, split at ASCII white space and lower-cased, and the name itself."""
    words = F.filter(F.split(F.lower(name), "[\\t\\n\\f\\r ]+"), lambda w: w != "")
    return F.array_distinct(F.concat(words, F.array(name)))


def matching_names(files: DataFrame, records: DataFrame, group: str, matches: Callable[[str, str], bool], shares: Callable[[Column], Column] = name_keys) -> DataFrame:
    """(group, name, wanted): a file's and a record's name that match, each pair of names once.

    Only names of a group that share a key are compared, by an equality join of different names."""
    keyed = lambda rows, name: rows.select(group, F.col("name").alias(name)).where(F.col("name").isNotNull()).distinct().withColumn("_key", F.explode(shares(F.col(name))))

    @F.pandas_udf("boolean")
    def match(name: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([bool(matches(a, b)) for a, b in zip(name, wanted)], dtype=bool)

    met = keyed(files, "name").join(keyed(records, "wanted"), [group, "_key"]).select(group, "name", "wanted").distinct()
    return met.where(match("name", "wanted"))


def greedy_assignment(files: DataFrame, records: DataFrame, group: str, matches: Callable[[str, str], bool] | None = None, shares: Callable[[Column], Column] = name_keys, target: int = TARGET) -> DataFrame:
    """(group, file_id, record_id): per group, files by time from the newest each take the first
    waiting record that matches, which is then gone.

    files: group, file_id, name, mtime; records: group, record_id, seq, name. Other columns are
    ignored. Equal times are broken by file_id, equal seq by record_id; files without a time come last,
    records without seq first. A null group or name matches nothing.

    matches None: names must be equal. The n-th file of a name then takes its n-th record, which two
    windows over group and name find. Another match says of two names whether they do, and must hold
    only for names that have one of the keys of `shares` in common. What a file takes then depends on
    all before it: a group is one sorted pass (assigned_in_turn), in which records wait by their own name
    and aren't repeated for each name of a file. Where a group has over 50 times `target` records and
    pairs of names, assigned_in_stretches decides `target` files of it at a time.
    """

    if matches is None:
        at = lambda *order: F.row_number().over(Window.partitionBy(group, "name").orderBy(*order))
        f = files.select(group, "name", "file_id", at(F.desc("mtime"), "file_id").alias("_place"))
        r = records.select(group, "name", "record_id", at("seq", "record_id").alias("_place"))
        return f.join(r, [group, "name", "_place"]).select(group, "file_id", "record_id")
    placed = lambda rows, *order: durable(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    f = placed(files.select(group, "file_id", "name", "mtime"), F.desc_nulls_last("mtime"), "file_id")
    r = placed(records.select(group, "record_id", "seq", F.col("name").alias("wanted")), F.asc_nulls_first("seq"), "record_id")
    names = durable(matching_names(f, r.withColumnRenamed("wanted", "name"), group, matches, shares))
    named = names.select(F.col(group).alias("_group"), F.col("name").alias("_name"), F.col("wanted").alias("_wanted"))
    askers = f.select(F.col(group).alias("_group"), F.col("name").alias("_name"), F.col("_at").alias("_file"))
    waiting = r.select(F.col(group).alias("_group"), F.col("wanted").alias("_wanted"), F.col("_at").alias("_record"))
    askers = askers.join(named.select("_group", "_name").distinct(), ["_group", "_name"], "left_semi")
    waiting = waiting.join(named.select("_group", "_wanted").distinct(), ["_group", "_wanted"], "left_semi")
    held = waiting.select("_group").unionByName(named.select("_group")).groupBy("_group").count()
    large = durable(held.where(F.col("count") > 50 * target).select("_group"))
    if not large.limit(1).count():
        taken = assigned_in_turn(askers, waiting, named)
    else:
        within, without = ([x.join(large, "_group", how) for x in (askers, waiting, named)] for how in ("left_semi", "left_anti"))
        offered = within[2].join(within[1], ["_group", "_wanted"]).select("_group", "_name", "_record")
        in_stretches = assigned_in_stretches(within[0], offered, target).select("_file", "_record")
        taken = assigned_in_turn(*without).unionByName(in_stretches)
    ids = taken.join(f.select(group, "file_id", F.col("_at").alias("_file")), "_file").join(r.select("record_id", F.col("_at").alias("_record")), "_record")
    return ids.select(group, "file_id", "record_id")


def assigned_in_turn(askers: DataFrame, waiting: DataFrame, named: DataFrame) -> DataFrame:
    """(_file, _record): the same as assigned_in_stretches, each group in one sorted pass.

    askers: _group, _name, _file; waiting: _group, _wanted, _record; named: the pairs _name and _wanted
    of a group that match. Records of one name go in their order, so a name's place in them is all that
    is known of those that are gone. A file's name keeps a heap of the next record of each name it
    matches; as places only move on, its top is right once it is that name's next one.
    """

    def take(state: dict, row: tuple) -> list[tuple]:
        _, file, record, name, wanted = row
        if file is None and record is None:
            state["pairs"].setdefault(name, []).append(wanted)
            return []
        left, at = state["left"], state["at"]
        if file is None:
            left.setdefault(wanted, array("q")).append(record)
            at[wanted] = 0
            return []
        if name in state["pairs"]:
            state["heaps"][name] = heap = [(left[w][at[w]], w) for w in state["pairs"].pop(name) if at[w] < len(left[w])]
            heapify(heap)
        heap = state["heaps"][name]
        while heap:
            record, wanted = heap[0]
            place = at[wanted]
            if place == len(left[wanted]):
                heappop(heap)
            elif left[wanted][place] != record:
                heapreplace(heap, (left[wanted][place], wanted))
            else:
                at[wanted] = place + 1
                return [(file, record)]
        return []

    none = lambda kind: F.lit(None).cast(kind)
    rows = named.select("_group", none("long").alias("_file"), none("long").alias("_record"), "_name", "_wanted")
    rows = rows.unionByName(waiting.select("_group", none("long").alias("_file"), "_record", none("string").alias("_name"), "_wanted"))
    rows = rows.unionByName(askers.select("_group", "_file", none("long").alias("_record"), "_name", none("string").alias("_wanted")))
    out = StructType([rows.schema["_group"], StructField("_file", LongType()), StructField("_record", LongType())])
    return sorted_pass(rows, ["_group"], ["_file", "_record"], out, lambda: {"pairs": {}, "left": {}, "at": {}, "heaps": {}}, take).select("_file", "_record")


def assigned_in_stretches(askers: DataFrame, offered: DataFrame, target: int = TARGET) -> DataFrame:
    """(_group, _name, _file, _record): from the smallest _file of a group on, each takes the smallest
    _record offered to its name that is left.

    askers: _group, _name, _file; offered: _group, _name, _record. A number is given to one file and to
    one record; a record may be offered to many names.

    A file's turn depends on all before it, so a group is decided in stretches of `target` files, all
    groups side by side. A stretch is one sorted pass over the records left for its names and then over
    its files. It is told twice as many records of a name as it has files of it, and 256 more; where
    others took all of these and there are more, the pass ends before that file, which begins the next
    stretch. So a pass holds a bounded number of records whatever the size of a group, and the first
    file of each stretch is always decided. Names whose records are all gone leave at once.
    """
    by = ["_group", "_name"]
    more = -1

    def take(state: dict, row: tuple) -> list[tuple]:
        _, file, _, record, name = row
        if file is None:
            state["offers"].setdefault(name, deque()).append(record)
            return []
        left = state["offers"].get(name)
        while left and left[0] in state["gone"]:
            left.popleft()
        state["ended"] |= bool(left) and left[0] == more
        if state["ended"]:
            return []
        if not left:
            return [(name, file, None)]
        state["gone"].add(left[0])
        return [(name, file, left.popleft())]

    nothing = F.lit(None).cast("long")
    out = StructType([*askers.select(*by).schema.fields, StructField("_file", LongType()), StructField("_record", LongType())])
    left, offers, done = askers, offered, []
    while True:
        left = durable(left.join(offers.select(*by).distinct(), by, "left_semi"))
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done) if done else left.withColumn("_record", nothing)
        place = F.row_number().over(Window.partitionBy("_group").orderBy("_file"))
        chosen = left.withColumn("_n", place).where(F.col("_n") <= target)
        wanted = chosen.groupBy(*by).agg((F.count("*") * 2 + 256).alias("_most"))
        told = offers.join(wanted, by).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_record"))).where("_n <= _most + 1")
        told = told.select("_group", nothing.alias("_file"), "_n", F.when(F.col("_n") <= F.col("_most"), F.col("_record")).otherwise(more).alias("_record"), "_name")
        rows = told.unionByName(chosen.select("_group", "_file", "_n", nothing.alias("_record"), "_name"))
        decided = durable(sorted_pass(rows, ["_group"], ["_file", "_n"], out, lambda: {"offers": {}, "gone": set(), "ended": False}, take))
        taken = decided.where("_record is not null")
        done.append(taken)
        left = left.join(decided.select("_file"), "_file", "left_anti")
        offers = durable(offers.join(taken.select("_record"), "_record", "left_anti"))
