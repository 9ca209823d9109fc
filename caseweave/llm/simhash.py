"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, discard, id_and_text, materialise, private, with_columns
from .components import connected_components

#: Fingerprints whose variants a task emits, at most.
NODES = 1 << 17

LOW_BITS = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of so many words, repeats included, A-Z lower-cased.

    Fewer words than that: the whole sequence is the one shingle. No word (null, empty, white space
    only): no shingle.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = [n - 1 for n in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(n + 1 for n in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[min(words, len(parts)) - 1 :])]


def widened(hashes: np.ndarray, width: int) -> np.ndarray:
    """(n, width) 64-bit words per hash: the hash itself, then mixes of it for wider fingerprints."""
    out = np.empty((len(hashes), width), np.uint64)
    out[:, 0] = hashes
    for k in range(1, width):  # the SplitMix64 finaliser
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def bit_counts(words: np.ndarray) -> np.ndarray:
    """(width, 64) how many rows of (n, width) have each bit; eight counters are added in one word."""
    n, width = words.shape
    padded = np.zeros((-(-n // 255) * 255, width), np.uint64)
    padded[:n] = words
    padded = padded.reshape(-1, 255, width)
    counts = np.empty((width, 64), np.int64)
    for k in range(8):
        sums = ((padded >> np.uint64(k)) & LOW_BITS).sum(axis=1, dtype=np.uint64)
        counts[:, k::8] = np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), width, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, words: int = 3, width: int = 1) -> list[int]:
    """The SimHash as 64-bit words; a bit is 1 if it is set in over half the hashes. No word: 0."""
    return of_hashes(np.array(shingle_hashes(text, words), np.uint64), width)


def of_hashes(hashes: np.ndarray, width: int) -> list[int]:
    if not len(hashes):
        return [0] * width
    counts = sum(bit_counts(widened(hashes[i : i + 65536], width)) for i in range(0, len(hashes), 65536))
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): the fingerprint's 64-bit words as signed longs, one row per document."""
    names = [f"f{i}" for i in range(width)]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def rows(ids: list, texts: list) -> dict:
        prints = np.array([fingerprint(t, words, width) for t in texts], np.uint64).reshape(-1, width).view(np.int64)
        return {"doc_id": ids} | {n: prints[:, i] for i, n in enumerate(names)}

    return id_and_text(docs).mapInArrow(by_text(schema, rows), ", ".join(f"{n} long" for n in schema.names))


def ball(bits: int, radius: int) -> list[int]:
    """All masks of so many bits with at most radius ones, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in ones) for r in range(radius + 1) for ones in combinations(range(bits), r)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def ball_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of nodes whose fingerprints differ in at most so many bits, enough of them to
    connect all such. nodes: rep, f0, each f0 once.

    Every fingerprint emits all variants within half the radius. Values that meet at a variant lie
    within the radius of each other, so a star from the smallest of them loses no connection; a variant
    has as many such values as a ball has masks at most.
    """
    spark = nodes.sparkSession
    masks = ball(64, radius // 2)
    tasks = max(2 * spark.sparkContext.defaultParallelism, ceil(nodes.count() / NODES))  # each row becomes 65
    variants = nodes.repartition(tasks, "f0").select("rep", "f0", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    variants = variants.select("rep", F.col("f0").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("a", F.min("rep").over(Window.partitionBy("variant"))).where("a <> rep")
    pairs = materialise(met.select("a", F.col("rep").alias("b")).distinct(), "pairs")

    def side(to: str) -> DataFrame:
        return nodes.select(F.col("rep").alias(to), F.col("f0").alias(f"{to}_f0"))

    with_a = materialise(pairs.join(side("a"), "a"), "pairs-a")
    return with_a.join(side("b"), "b").where(F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))) <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; linked documents share a component.

    Every distinct fingerprint emits all variants within half the radius; two within the radius meet
    at a variant. Colliding pairs are deduplicated and verified: they link at radius or fewer
    differing bits, and every such link is found.

    Documents with one fingerprint are one node from the start, so that copies cost nothing more.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows and ids
    are returned as often as they come; a row without an id gets the component of its fingerprint.
    An empty table gives an empty result.
    """
    if radius % 2:
        raise ValueError("the radius is even")
    prints = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(prints.where("doc_id is not null").groupBy("f0").agg(F.min("doc_id").alias("rep")), "nodes")

    found = connected_components(ball_links(nodes, radius))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f0", F.coalesce("component", "rep").alias("component_id"))
    named = materialise(named, "named")
    return prints.join(named, "f0", "left").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Values of a band of min-hashes. Two shingle sets of similarity s share a band with the chance s^BAND.
BAND = 8
#: Shingles of a block of documents that are compared with those of another block in one task.
BLOCK = 1 << 20


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_hash(hashes: np.ndarray) -> int:
    """One hash of a sorted set of shingles: texts of the same set are one node."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """A key for each BAND of min-hashes, one min-hash per odd factor; none without a shingle."""
    if not len(hashes):
        return []
    least = np.min([(hashes[i : i + 1024, None] * factors).min(axis=0) for i in range(0, len(hashes), 1024)], axis=0).reshape(-1, BAND)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)]


def sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """(doc_id, node, n, f0, keys): hash and size of each document's set of shingles, the set's SimHash,
    and its band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("f0", pa.int64()), ("keys", pa.list_(pa.int64()))])
    factors = np.random.default_rng(42).integers(0, 2**64, bands * BAND, np.uint64) | np.uint64(1)

    def rows(ids: list, texts: list) -> dict:
        sets = [distinct_shingles(t, words) for t in texts]
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return {"doc_id": ids, "node": signed([set_hash(s) for s in sets]), "n": [len(s) for s in sets], "f0": signed([of_hashes(s, 1)[0] for s in sets]), "keys": [signed(band_keys(s, factors)) for s in sets]}

    return id_and_text(docs).mapInArrow(by_text(schema, rows), "doc_id long, node long, n long, f0 long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles): each document's distinct shingles, sorted."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def rows(ids: list, texts: list) -> dict:
        sets = [distinct_shingles(t, words) for t in texts]
        return {"node": np.array([set_hash(s) for s in sets], np.uint64).view(np.int64), "shingles": [s.view(np.int64) for s in sets]}

    return id_and_text(docs).mapInArrow(by_text(schema, rows), "node long, shingles array<long>")


def forest(candidates: Callable[[int], np.ndarray], linked: Callable[[int, int], bool], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that linked pairs of candidates connect. Pairs of one label, or that are
    connected already, aren't tested, so a dense group takes few tests and never gives more links than
    members."""
    labels, out = labels.copy(), []
    for i in range(len(labels)):
        left = candidates(i) & (labels != labels[i])
        while left.any():
            j = int(left.argmax())
            left[j] = False
            if linked(i, j):
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
                left &= labels != labels[i]
    return out


def coded(shingles: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets with their shingles numbered from 0, in one numbering, and an array of no for each."""
    distinct, codes = np.unique(shingles.combine_chunks().flatten().to_numpy(), return_inverse=True)
    return np.split(codes, np.cumsum(pc.list_value_length(shingles).to_numpy())[:-1]), np.zeros(len(distinct), bool)


def near(n: np.ndarray, i: int, similarity: float) -> np.ndarray:
    """Which rows' sizes don't rule out a link with row i."""
    return np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])


def head_links(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """The links of nodes with the head that they met."""

    def run(table: pa.Table) -> pa.Table:
        node, head, n = (table.column(c).to_numpy() for c in ("node", "head", "n"))
        h = int((node == head).argmax())
        sets, held = coded(table.column("shingles"))
        held[sets[h]] = True
        close = near(n, h, similarity) & (node != head)
        ends = [i for i in np.flatnonzero(close).tolist() if (both := np.count_nonzero(held[sets[i]])) / (n[i] + n[h] - both) >= similarity]
        return pa.table({"a": node[ends], "b": head[ends]})

    return run


def block_links(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """The links between two blocks of a band's nodes, or within one, that connect different labels."""

    def run(table: pa.Table) -> pa.Table:
        node, n, label = (table.column(c).to_numpy() for c in ("node", "n", "label"))
        block = np.unique(table.column("block").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        sets, held = coded(table.column("shingles"))
        holder = -1
        across = table.column("i")[0] != table.column("j")[0]

        def candidates(i: int) -> np.ndarray:
            close = near(n, i, similarity)
            return close & (block != block[i]) if across else close

        def linked(i: int, j: int) -> bool:
            nonlocal holder
            if holder != i:
                held[sets[holder]] = False
                held[sets[i]] = True
                holder = i
            both = np.count_nonzero(held[sets[j]])
            return both / (n[i] + n[j] - both) >= similarity

        found = forest(candidates, linked, np.unique(label, return_inverse=True)[1])
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": node[ends[:, 0]], "b": node[ends[:, 1]]})

    return run


def linked_sets(nodes: DataFrame, keyed: DataFrame, close: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, component) of the nodes that have a link. nodes: node, n; keyed: node, key of each band;
    close: node, head, further pairs to compare; sets: from nodes to (node, shingles).

    First every node is compared with one head, the smallest node of most of its bands or of its ball:
    work in proportion to the nodes, which settles a large group of near copies of one text. Of a band
    whose nodes that leaves in different components, all pairs of different components are compared,
    block against block: work in proportion to the pairs that share a band. A component of more than a
    block has blocks of its own there, which meet those of others only. Nodes are dealt without their
    sets, which join them once they are.
    """
    heads = materialise(keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("held")).where("held > 1"), "heads")
    by_band = keyed.join(heads, "key").where("node <> head").groupBy("node", "head").agg(F.count("*").alias("shared"))
    either = by_band.unionByName(close.where("node <> head").select("node", "head", F.lit(64).cast("long").alias("shared")))
    met = either.groupBy("node").agg(F.max(F.struct("shared", F.bitwise_not("head").alias("order"), "head")).alias("m")).select("node", F.col("m.head").alias("head"))
    met = materialise(met, "met")
    involved = keyed.join(heads.select("key"), "key").select("node").unionByName(close.select("node")).unionByName(close.select(F.col("head").alias("node"))).distinct()
    members = nodes.join(involved, "node")
    members = materialise(members.join(sets(members), "node").select("node", "n", "shingles"), "members")

    salts = materialise(met.join(members.select("node", "n"), "node").groupBy("head").agg(F.ceil(F.sum("n") / BLOCK).alias("salts")), "salts")
    spokes = met.join(salts, "head").select("head", "node", F.pmod(F.xxhash64("node"), "salts").alias("salt"))
    hubs = salts.select("head", F.col("head").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    by_head = spokes.unionByName(hubs).join(members, "node").groupBy("head", "salt").applyInArrow(head_links(similarity), "a long, b long")
    by_head = materialise(by_head, "head-links")
    discard(met, salts)
    first = connected_components(by_head).withColumnRenamed("component", "label")

    shared = keyed.join(heads.select("key"), "key").join(first, "node", "left")
    labelled = materialise(shared.select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    rows = materialise(labelled.join(open_keys, "key").join(nodes.select("node", "n"), "node"), "open")
    sizes = rows.groupBy("key", "label").agg(F.sum("n").alias("size")).withColumn("part", F.when(F.col("size") > BLOCK, F.col("label").cast("string")).otherwise("rest"))
    sizes = materialise(sizes, "sizes")
    parts = sizes.groupBy("key", "part").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes.select("key", "label", "part"), ["key", "label"]).join(parts, ["key", "part"])
    named = lambda part, number: F.concat_ws(":", part, number.cast("string"))
    dealt = dealt.withColumn("block", named(F.col("part"), F.pmod(F.xxhash64("node"), "blocks"))).drop("blocks")
    others = parts.select("key", F.col("part").alias("other"), "blocks")
    faced = dealt.join(others, "key").where("part <> other or part = 'rest'").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    opposite = named(F.col("other"), F.col("number"))
    faced = faced.select("key", F.least("block", opposite).alias("i"), F.greatest("block", opposite).alias("j"), "block", "node", "label").join(members, "node")
    by_block = materialise(faced.groupBy("key", "i", "j").applyInArrow(block_links(similarity), "a long, b long"), "block-links")
    discard(heads, members, labelled, rows, sizes)
    found = connected_components(by_head.unionByName(by_block))
    discard(by_head, by_block)
    return found


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 2, bands: int = 24, similarity: float = 0.8) -> DataFrame:
    """docs with one row left of each group of near-duplicates, that of the smallest id.

    Documents of one set of shingles are one node. Two searches find pairs to compare. Ball hashing:
    nodes whose SimHashes differ in at most `radius` bits, and those of one SimHash. Sets of a
    similarity of 0.8 differ in far more bits than a ball of bounded size has, so every node also emits
    its band keys, and nodes that share a key meet: a pair of similarity s with the chance
    1 - (1 - s^BAND)^bands. None is capped. A pair links if the similarity of its sets (what both have
    of what either has) is similarity at least; nothing else rules one out.

    Rows are judged by id and set: where one id has several texts, each counts in its own group. Of
    rows that repeat both, one stays; rows without an id are kept as they are. Texts without a word,
    null ones too, are one set. Texts of any length are read whole; an empty table gives an empty
    result. Columns of any name may be in docs.
    """
    rows = materialise(sketches(docs, words, bands).where("doc_id is not null"), "sketches")
    nodes = materialise(rows.groupBy("node", "n", "f0").agg(F.min("doc_id").alias("rep")), "nodes")
    keyed = materialise(rows.select("node", F.explode("keys").alias("key")).distinct(), "keys")
    prints = materialise(nodes.groupBy("f0").agg(F.min("node").alias("rep"), F.count("*").alias("held")), "prints")
    equal = nodes.join(prints.where("held > 1"), "f0").select("node", prints["rep"].alias("head"))
    close = materialise(ball_links(prints.select("rep", "f0"), radius).select(F.col("b").alias("node"), F.col("a").alias("head")).unionByName(equal), "close")

    def sets(members: DataFrame) -> DataFrame:
        sought = members.select(F.col("rep").alias("doc_id")).distinct()
        return shingle_sets(id_and_text(docs).join(sought, "doc_id"), words).groupBy("node").agg(F.first("shingles").alias("shingles"))

    found = linked_sets(nodes, keyed, close, sets, similarity)
    p = private(docs)
    placed = rows.select("doc_id", "node").distinct().join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    placed = materialise(placed, "placed")
    discard(nodes, keyed, prints, close)
    winners = materialise(placed.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("w")).select(F.col("w.doc_id").alias(p + "id"), F.col("w.node").alias(p + "set")), "winners")
    repeated = materialise(rows.groupBy(F.col("doc_id").alias(p + "id")).agg(F.count("*").alias("n")).where("n > 1").select(p + "id"), "repeated")
    lost = placed.select(F.col("doc_id").alias(p + "id")).distinct().join(winners, p + "id", "left_anti")
    gone = materialise(lost.unionByName(repeated).distinct(), "gone")
    single = docs.join(gone, docs["doc_id"] == gone[p + "id"], "left_anti")

    def node(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([set_hash(distinct_shingles(t, words)) for t in texts], np.uint64).view(np.int64))]

    several = with_columns(docs.join(repeated, docs["doc_id"] == repeated[p + "id"], "left_semi"), node, [(p + "node", "long")])
    same = (several["doc_id"] == winners[p + "id"]) & (several[p + "node"] == winners[p + "set"])
    one = several.join(winners, same, "left_semi").dropDuplicates(["doc_id", p + "node"]).drop(p + "node")
    return single.unionByName(one)
