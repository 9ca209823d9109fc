"""Resolution of wanted records: aliases, exact matches with their cardinality, state over attempts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.web import ip_key, ip_prefix
from ..sources.scratch import durable


def last_alias(aliases: DataFrame, key: str = "key") -> DataFrame:
    """(key, target): the last line of each key wins."""
    return aliases.groupBy(key).agg(F.max_by("target", "line_no").alias("target"))


def with_alias(rows: DataFrame, aliases: DataFrame, on: str, key: str = "key") -> DataFrame:
    """rows with the alias's target, null without one. The table is small or not: its size decides
    whether Spark broadcasts it."""
    return rows.join(last_alias(aliases, key).withColumnRenamed(key, "_key"), F.col(on) == F.col("_key"), "left").drop("_key")


def exact_matches(wanted: DataFrame, rows: DataFrame, columns: Sequence[str], row_id: str, key: str = "key") -> DataFrame:
    """(key, n_matches, status, row_id) of each wanted key: none, one or many rows hold it in any of
    the columns. A row counts once, however many of its columns match; only one match is resolved."""
    named = ", ".join(f"cast({c} as string)" for c in columns)
    held = rows.select(row_id, F.expr(f"stack({len(columns)}, {named}) as _value")).where("_value is not null").distinct()
    hits = wanted.select(key).distinct().join(held, F.col(key) == F.col("_value"), "left").groupBy(key)
    counted = hits.agg(F.count(row_id).alias("n_matches"), F.min(row_id).alias("_first"))
    status = F.when(F.col("n_matches") == 0, "none").when(F.col("n_matches") == 1, "match").otherwise("many")
    return counted.select(key, "n_matches", status.alias("status"), F.when(F.col("n_matches") == 1, F.col("_first")).alias(row_id))


def unique_bind(files: DataFrame, records: DataFrame, keys: str = "keys") -> DataFrame:
    """(file_id, record_id): files whose keys meet the keys of exactly one record."""
    f = files.select("file_id", F.explode(F.array_distinct(keys)).alias("_k"))
    r = records.select("record_id", F.explode(F.array_distinct(keys)).alias("_k"))
    met = f.join(r, "_k").select("file_id", "record_id").distinct().groupBy("file_id")
    return met.agg(F.count("*").alias("n"), F.min("record_id").alias("record_id")).where("n = 1").select("file_id", "record_id")


def merged_state(old: DataFrame, new: DataFrame, key: str = "id", targets: str = "targets") -> DataFrame:
    """(key, action, targets) after a new parse: keep, relocate (other targets), new, retained (a
    manual row that wasn't parsed again) or dropped."""
    o = old.select(key, F.col(targets).alias("_old"), "manual", F.lit(True).alias("_was"))
    n = new.select(key, F.col(targets).alias("_new"), F.lit(True).alias("_is"))
    both = o.join(n, key, "full")
    action = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), F.when(F.col("manual"), "retained").otherwise("dropped"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), "keep")
        .otherwise("relocate")
    )
    return both.select(key, action.alias("action"), F.when(F.col("_is").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias(targets))


def distinct_in_order(*arrays: Column) -> Column:
    """The arrays' values, each once, in the order of first appearance."""
    return F.array_distinct(F.concat(*arrays))


def priority_first(priority: Column, pages: Column) -> Column:
    """The pages with those of the priority list that are among them in front."""
    return F.array_distinct(F.concat(F.array_intersect(priority, pages), pages))


def after_block(attempts: DataFrame, origin: str, order: Sequence[str], blocked: Column, message: Column) -> DataFrame:
    """attempts with `outcome`: once an origin has blocked, later attempts there fail with that
    message and aren't made."""
    before = Window.partitionBy(origin).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.first(F.when(blocked, message), ignorenulls=True).over(before)
    return attempts.withColumn("outcome", F.coalesce(earlier, F.when(blocked, message), F.lit("ok"))).withColumn("skipped", earlier.isNotNull())


def redirect_ends(starts: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """(url, final, n_hops, status): redirects followed up to so many hops, by one join each.

    status: done, or too_many if there would be another. redirects: source, target; a row that its
    origin rule refuses is simply not in it.
    """
    edges = redirects.groupBy("source").agg(F.min("target").alias("target"))
    now = starts.select("url", F.col("url").alias("final"), F.lit(0).cast("long").alias("n_hops"))
    for _ in range(hops):
        step = edges.select(F.col("source").alias("final"), "target")
        now = now.join(step, "final", "left").select("url", F.coalesce("target", "final").alias("final"), (F.col("n_hops") + F.col("target").isNotNull().cast("long")).alias("n_hops"))
    more = edges.select(F.col("source").alias("final"), F.lit(True).alias("_more"))
    return now.join(more, "final", "left").select("url", "final", "n_hops", F.when(F.col("_more"), "too_many").otherwise("done").alias("status"))


def ranked_links(pages: DataFrame, pattern: str, most: int = 4, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, rank, link): the first so many different links of a page in its order."""
    links = F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), 1, most)
    return pages.select(key, F.posexplode(links).alias("rank", "link")).withColumn("rank", (F.col("rank") + 1).cast("long"))


def first_available(candidates: DataFrame, key: str, order: str, usable: Column, value: str) -> DataFrame:
    """(key, value) of the first usable candidate in order; null if none is."""
    return candidates.groupBy(key).agg(F.min_by(F.when(usable, F.col(value)), F.when(usable, F.col(order))).alias(value))


def gate(settings: DataFrame, facts: DataFrame, owner: str = "store") -> DataFrame:
    """(owner, open): whether the recorded path, size and time of an index fit what is there.

    settings: owner, key, value; facts: owner, size, mtime."""
    wide = settings.groupBy(owner).agg(*[F.max_by("value", F.when(F.col("key") == k, 1)).alias(k) for k in ("source_path", "source_size", "source_mtime")])
    fits = F.col("source_path").isNotNull() & (F.col("source_size").try_cast("long") == F.col("size")) & (F.col("source_mtime").try_cast("long") == F.col("mtime"))
    return facts.join(wide, owner, "left").select(owner, F.coalesce(fits, F.lit(False)).alias("open"))


def addresses_in(addresses: DataFrame, rules: DataFrame, number: str = "n", stretch: Callable[[Column], Column] = lambda n: F.shiftright(n, 20)) -> DataFrame:
    """addresses with `blocked`: whether a rule of the same family holds the number.

    The rules, which are few beside the addresses, are merged into disjoint blocks first, so an address
    meets one at most. Blocks and addresses meet by the stretch of numbers that they are in: a block
    stands in each that it reaches into, so this is an equality join, which Spark broadcasts if the
    blocks' measured size is small and splits where a stretch is hot. stretch: from a number to one of
    a few thousand consecutive longs; the default suits IPv4 addresses as numbers.
    """
    order = Window.partitionBy("family").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    block = rules.withColumn("_reach", F.max("last").over(order)).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("first") > F.col("_reach")), 1).otherwise(0))
    block = block.withColumn("_b", F.sum("_new").over(Window.partitionBy("family").orderBy("first"))).groupBy("family", "_b").agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    reached = block.select(F.col("family").alias("_family"), "_first", "_last", F.explode(F.sequence(stretch(F.col("_first")), stretch(F.col("_last")))).alias("_stretch"))
    n = F.col(number)
    meets = (F.col("family") == F.col("_family")) & (stretch(n) == F.col("_stretch")) & (n >= F.col("_first")) & (n <= F.col("_last"))
    return addresses.join(reached, meets, "left").select(*addresses.columns, F.col("_first").isNotNull().alias("blocked"))


def prefixes(first: str, last: str, bits: int | None) -> list[tuple[int, str]]:
    """(bits, key) of the prefixes that make up a rule of two ip_keys, or of one and its bits: at most
    twice as many as an address has bits."""
    if first is None or (bits is None and (last is None or first[:2] != last[:2])):
        raise ValueError("a rule needs addresses of one family")
    size, width = (32 if first[0] == "4" else 128), len(first) - 2
    low = int(first[2:], 16)
    if bits is not None:
        return [(bits, first[:2] + f"{low >> size - bits << size - bits:0{width}x}")]
    high, out = int(last[2:], 16), []
    while low <= high:
        free = min((low & -low).bit_length() - 1 if low else size, (high - low + 1).bit_length() - 1)
        out.append((size - free, first[:2] + f"{low:0{width}x}"))
        low += 1 << free
    return out


def blocked_by_rules(addresses: DataFrame, rules: DataFrame, address: str = "address") -> DataFrame:
    """addresses with `blocked`: whether a rule of the same family, IPv4 or IPv6, holds the address.

    rules: first, last, bits: the first and last address of a range, or a network and how many of its
    bits count. A range is cut into prefixes. Each different address gives its own prefix of every
    length that a rule of its family has, 161 at most and a few in practice, and meets the rules by an
    equality join: rules may be many, wide and nested, and a frequent address is looked up once. What
    is no address, and null, isn't blocked; a rule of unsound addresses, or of two families, raises; a
    range that ends before it begins holds nothing.
    """
    cut = F.udf(lambda first, last, bits: prefixes(first, last, bits), "array<struct<bits:int,key:string>>")
    each = rules.select(F.explode(cut(ip_key(F.col("first")), ip_key(F.col("last")), F.col("bits").cast("int"))).alias("p"))
    held = durable(each.select("p.bits", ip_prefix(F.col("p.key"), F.col("p.bits")).alias("_prefix"), F.substring("p.key", 1, 1).alias("family")).distinct())
    lengths = sorted(tuple(r) for r in held.select("family", "bits").distinct().collect())
    of = lambda family: F.array(*[F.lit(n) for f, n in lengths if f == family]).cast("array<int>")
    known = addresses.select(F.col(address).alias("_address")).where("_address is not null").distinct().withColumn("_key", ip_key(F.col("_address"))).where("_key is not null")
    asked = known.withColumn("bits", F.explode(F.when(F.col("_key").startswith("4"), of("4")).otherwise(of("6"))))
    hits = asked.withColumn("_prefix", ip_prefix(F.col("_key"), F.col("bits"))).join(held, ["bits", "_prefix"], "left_semi").select("_address").distinct()
    return addresses.join(hits.withColumn("_hit", F.lit(True)), F.col(address) == F.col("_address"), "left").select(*[addresses[c] for c in addresses.columns], F.coalesce("_hit", F.lit(False)).alias("blocked"))
