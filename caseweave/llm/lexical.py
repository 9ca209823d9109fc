"""Ranked lexical search over a clustered inverted index of documents reordered by graph bisection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, private, release, slices

#: Documents at most, in expectation, from which the upper levels of the order are learnt.
SAMPLE = 4096
#: Of the sample, each leaf of the upper levels has so many documents at least; so many levels at most.
LEAF_SAMPLE, LEVELS = 128, 5
#: A block, bisected within one task, has about so many different terms of documents in all.
BLOCK_POSTINGS = 1_000_000
#: A cluster, visited as a whole, has so many documents at most.
CLUSTER_DOCS = 1024
#: Passes of swaps per bisection, at most.
PASSES = 8
#: Clusters that each item visits in its first round; a round visits so many times more than the last.
FIRST_ROUND, WIDER = 8, 16
#: Items that share one copy of a cluster's postings in a task.
ITEM_BLOCK = 256
#: Up to so many different terms of all items, of bounded length in practice a few MB, are broadcast.
BROADCAST_TERMS = 100_000
LAST = (1 << 63) - 1
#: Bytes of terms: digits, ASCII letters (lower-cased) and whatever isn't ASCII; the others are spaces.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FORWARD = "row long, doc_id long, leaf int, n long, terms binary, tfs binary"
#: docs, places within the cluster, are unsigned 16-bit integers, saturations 32-bit ones.
INDEX = "cluster long, term binary, df long, top long, docs binary, saturations binary, ids array<long>"
INDEX_SCHEMA = pa.schema([("cluster", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("top", pa.int64()), ("docs", pa.binary()), ("saturations", pa.binary()), ("ids", pa.list_(pa.int64()))])


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: maximal runs of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F],
    lower-cased in A-Z only. The delimiters are all ASCII, so UTF-8 can be cut as bytes."""
    return text.encode().translate(TERMS).split() if text else []


def swaps(docs: np.ndarray, terms: np.ndarray, n: int, n_terms: int, passes: int = PASSES) -> np.ndarray:
    """Which of n documents are right, as booleans, half of them: one bisection of the document-term graph.

    docs and terms are its edges. From the halves of the given order, pairs of documents change places
    while that lowers the estimated bits of the gaps, d * log2(size / (d + 1)) for a term that d of a
    half's documents hold.
    """
    right = np.arange(n) >= n - n // 2
    total = np.bincount(terms, minlength=n_terms)
    sizes = (n - n // 2, n // 2)
    for _ in range(passes):
        d = np.bincount(terms[right[docs]], minlength=n_terms)
        cost = [total - d, d]
        bits = [c * np.log2(s / (c + 1.0)) for c, s in zip(cost, sizes)]
        less = [(c - 1) * np.log2(s / np.maximum(c, 1.0)) for c, s in zip(cost, sizes)]
        more = [(c + 1) * np.log2(s / (c + 2.0)) for c, s in zip(cost, sizes)]
        out = [bits[0] + bits[1] - less[0] - more[1], bits[0] + bits[1] - less[1] - more[0]]  # of a move from left, from right
        gain = np.bincount(docs, np.where(right[docs], out[1][terms], out[0][terms]), n)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        change = int(np.count_nonzero(gain[a[:k]] + gain[b[:k]] > 1e-9))
        if not change:
            break
        right[a[:change]], right[b[:change]] = True, False
    return right


def part(docs: np.ndarray, terms: np.ndarray, n: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The graph of the chosen documents: edges with new numbers, terms of one of them left out; the
    number of terms, and their old numbers."""
    kept = chosen[docs]
    d, t = (np.cumsum(chosen) - 1)[docs[kept]], terms[kept]
    count = np.bincount(t) if len(t) else np.zeros(0, int)
    useful = count > 1
    edge = useful[t] if len(t) else np.zeros(0, bool)
    return d[edge], (np.cumsum(useful) - 1)[t[edge]] if len(t) else t, int(useful.sum()), np.flatnonzero(useful)


def bisected(docs: np.ndarray, terms: np.ndarray, n: int, most: int) -> list[np.ndarray]:
    """The documents 0 .. n - 1 as clusters of at most `most`, in the order of recursive bisection."""
    out: list[np.ndarray] = []
    stack = [(np.arange(n), docs, terms)]
    while stack:
        names, d, t = stack.pop()
        if len(names) <= most:
            out.append(names)
            continue
        d, t, n_terms, _ = part(d, t, len(names), np.ones(len(names), bool))
        right = swaps(d, t, len(names), n_terms)
        for side in (right, ~right):  # the left one is popped first
            child, ct, _, _ = part(d, t, len(names), side)
            stack.append((names[side], child, ct))
    return out


class Router:
    """The upper levels of the order, learnt from a sample: at each node a weight per term, the bits that
    it costs left more than right, and the threshold that halves the sample."""

    def __init__(self, sample: list[bytes], leaf: int = LEAF_SAMPLE, levels: int = LEVELS) -> None:
        held: Counter = Counter()
        for doc in sample:
            held.update(doc.split())
        self.number = {t: i for i, t in enumerate(sorted(t for t, n in held.items() if n > 1))}
        del held
        self.levels = max(0, min(levels, int(np.log2(max(1, len(sample) / leaf)))))
        self.weights = np.zeros(((1 << self.levels) - 1, len(self.number)), np.float32)
        self.thresholds = np.zeros(len(self.weights))
        rows = [np.fromiter((self.number[t] for t in doc.split() if t in self.number), np.int32) for doc in sample]
        docs = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        terms = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        nodes = [(0, np.ones(len(rows), bool))] if self.levels else []
        while nodes:
            node, chosen = nodes.pop()
            d, t, n_terms, names = part(docs, terms, len(rows), chosen)
            right = swaps(d, t, int(chosen.sum()), n_terms)
            r = np.bincount(t[right[d]], minlength=n_terms)
            left = np.bincount(t, minlength=n_terms) - r
            self.weights[node, names] = np.log2((r + 1.0) / (left + 1.0))
            score = np.bincount(d, self.weights[node, names][t], int(chosen.sum()))
            self.thresholds[node] = np.median(score)
            goes = np.zeros(len(rows), bool)
            goes[np.flatnonzero(chosen)] = score > self.thresholds[node]
            if 2 * node + 2 < len(self.weights):
                nodes += [(2 * node + 1, chosen & ~goes), (2 * node + 2, goes)]

    def leaf(self, terms: Iterable[bytes]) -> int:
        at, held = 0, [i for i in map(self.number.get, terms) if i is not None]
        scores = self.weights[:, held].sum(axis=1) - self.thresholds
        for _ in range(self.levels):
            at = 2 * at + (2 if scores[at] > 0 else 1)
        return at - len(self.weights)


def sampled(docs: DataFrame, most: int = SAMPLE) -> list[bytes]:
    """The different terms, with spaces between, of about `most` rows, or of all where there are fewer; never of over twice as many."""
    total = docs.count()
    some = docs if total <= most else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total // most))) == 0).limit(2 * most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(sorted(set(terms_of(t)))) for t in batch.column("text").to_pylist()], pa.binary())], ["terms"])

    return [bytes(r.terms) for r in some.select("text").mapInArrow(run, "terms binary").collect()]


def forward(docs: DataFrame, router: Router) -> DataFrame:
    """A row per document with a term: its place in the upper levels, n, and its terms with their tf."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.int32()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(router)  # bounded by the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, model = TaskContext.get().partitionId() << 40, shared.value
        for whole in batches:
            for batch in slices(whole):
                out = []
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    found = terms_of(text)
                    if found:
                        counts = Counter(found)
                        out.append((row, key, model.leaf(counts), len(found), b" ".join(counts), np.fromiter(counts.values(), "<i4", len(counts)).tobytes()))
                    row += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        release()

    return docs.mapInArrow(run, FORWARD)


def saturation(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) with m = 100 - 90 + (90 * n * docs) div length."""
    m = 10 + (90 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def index_block(block: int, table: pa.Table, docs: int, length: int, most: int = CLUSTER_DOCS) -> pa.Table:
    """The index rows of one block: for each cluster a row per term, and one of the empty term with the
    documents' ids in their new order."""
    table = table.sort_by("row")
    ids, number, term_at, tf_at = table.column("doc_id").to_pylist(), {}, [], []
    for blob, tfs in zip(table.column("terms").to_pylist(), table.column("tfs").to_pylist()):
        held = blob.split()
        term_at.append(np.fromiter((number.setdefault(t, len(number)) for t in held), np.int64, len(held)))
        tf_at.append(np.frombuffer(tfs, "<i4"))
    sizes = [len(t) for t in term_at]
    doc, term, tf = np.repeat(np.arange(len(ids)), sizes), np.concatenate(term_at), np.concatenate(tf_at).astype(np.int64)
    value = saturation(tf, np.repeat(table.column("n").to_numpy(), sizes), docs, length)
    clusters = bisected(doc, term, len(ids), most)
    cluster_of, place = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for k, names in enumerate(clusters):
        cluster_of[names], place[names] = k, np.arange(len(names))
    key = cluster_of[doc] * len(number) + term
    order = np.lexsort((place[doc], key))
    key, at, value = key[order], place[doc][order].astype("<u2"), value[order].astype("<u4")
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[first, len(key)].astype(np.int32)

    def blobs(numbers: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer((ends * numbers.itemsize).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(numbers)])

    words = pa.array(list(number), pa.binary()).take(pa.array(key[first] % len(number)))
    none = pa.nulls(len(first), pa.list_(pa.int64()))
    base = block << 20
    rows = [base + key[first] // len(number), words, np.diff(ends).astype(np.int64), np.maximum.reduceat(value, first).astype(np.int64), blobs(at), blobs(value), none]
    empty = [b""] * len(clusters)
    heads = [base + np.arange(len(clusters)), [b""] * len(clusters), [len(c) for c in clusters], [0] * len(clusters), empty, empty, [[ids[i] for i in c.tolist()] for c in clusters]]
    both = [pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(part_, INDEX_SCHEMA)], schema=INDEX_SCHEMA) for part_ in (rows, heads)]
    return pa.concat_tables(both).combine_chunks()


class Index:
    """An index in the shared folder: rows, the number of documents with a term, and of all their terms."""

    def __init__(self, rows: DataFrame, docs: int, length: int) -> None:
        self.rows, self.docs, self.length = rows, docs, length


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, block_postings: int = BLOCK_POSTINGS, cluster_docs: int = CLUSTER_DOCS) -> Index:
    """Index every row of docs; rows without a term (null texts too) hold nothing that could be found.

    The order of documents is that of recursive graph bisection: its upper levels are learnt from a
    bounded sample and every document is sent down them, which deals the corpus over tasks; a leaf with
    more than a block holds is dealt over several by row; within a block the bisection goes on over
    all its documents down to clusters. The order decides only how much a search can leave out.
    Repeated rows are documents of their own.
    """
    if not 0 < cluster_docs <= 1 << 16:
        raise ValueError("a cluster's places are 16-bit numbers")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    router = Router(sampled(rows, sample))
    release()
    known = materialise(forward(rows, router), "forward")
    leaves = known.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("length"), F.sum(F.octet_length("tfs") / 4).cast("long").alias("postings")).collect()
    n, length = sum(r.docs for r in leaves), sum(r.length for r in leaves)
    blocks = {r.leaf: max(1, -(-r.postings // block_postings)) for r in leaves}
    if not blocks:
        return Index(docs.sparkSession.createDataFrame([], INDEX), 0, 0)
    many = F.create_map(*[F.lit(x).cast("long") for item in blocks.items() for x in item])
    block = F.col("leaf").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), many[F.col("leaf").cast("long")])

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = index_block(group[0].as_py(), table, n, length, cluster_docs)
        release()
        return out

    index = materialise(known.withColumn("block", block).groupBy("block").applyInArrow(run, INDEX), "index")
    discard(known)
    return Index(index, n, length)


def top_of(ids: list, scores: np.ndarray, k: int) -> list[tuple[int | None, int]]:
    """The k best (doc_id, score) above 0: highest score, then smallest id, null last."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    ranked = sorted(((-int(scores[i]), LAST if ids[i] is None else ids[i], i) for i in found.tolist()))[:k]
    return [(ids[i], -s) for s, _, i in ranked]


def visit(work: DataFrame, index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each cluster that an item visits.

    work: item, cluster. asked: item, term, weight. A cluster's postings of asked terms meet all its
    visitors of a block of items in one task; the block bounds the task whatever the number of items.
    """
    visits = work.withColumn("items", F.floor(F.col("item") / ITEM_BLOCK))
    wanted = visits.select("cluster", "items").distinct()
    postings = index.join(wanted, "cluster")
    asks = visits.join(asked, "item").select(F.col("cluster").alias("_cluster"), F.col("items").alias("_items"), "item", "term", "weight")
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists, ids = {}, []
        for term, docs, values, names in zip(*(left.column(n).to_pylist() for n in ("term", "docs", "saturations", "ids"))):
            if term:
                lists[term] = (np.frombuffer(docs, "<u2"), np.frombuffer(values, "<u4"))
            else:
                ids = names
        out = []
        by_item: dict = {}
        for item, term, weight in zip(right.column("item").to_pylist(), right.column("term").to_pylist(), right.column("weight").to_pylist()):
            if term in lists:
                by_item.setdefault(item, []).append((term, weight))
        for item, parts in by_item.items():
            scores = np.zeros(len(ids), np.int64)
            for term, weight in parts:
                at, value = lists[term]
                scores[at] += weight * value.astype(np.int64)
            out += [(item, *found) for found in top_of(ids, scores, k)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    columns = ["cluster", "items", "term", "docs", "saturations", "ids"]
    grouped = postings.select(*columns).groupBy("cluster", "items").cogroup(asks.groupBy("_cluster", "_items"))
    return grouped.applyInArrow(run, "item long, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0.

    An item first visits the clusters of its highest bounds, the sum of its terms' weights times each
    term's largest saturation there, then ever more, until no cluster is left whose bound passes the
    score at rank k, or equals it where the cluster has a smaller doc_id than that rank: exact, ties
    included. Each term counts once. Repeated items are ranked each; items without terms have no rows.
    """
    spark = items.sparkSession
    stem = private(items)
    named = items.select(F.monotonically_increasing_id().alias(f"{stem}item"), F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType()))])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("item_id"), terms], ["item", "item_id", "terms"])

    asked = materialise(named.mapInArrow(split, schema), "items")
    names = asked.select("item", "item_id")
    by_term = asked.select("item", F.explode("terms").alias("term"))
    every = by_term.select("term").distinct().unionByName(spark.createDataFrame([(b"",)], "term binary"))
    few = every.count() <= BROADCAST_TERMS
    rows = index.rows.join(F.broadcast(every) if few else every, "term", "left_semi").select(index.rows.columns)
    narrow = rows.where("term <> X''").select("cluster", "term", "df", "top")
    counted = narrow.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.docs + 2) / (2.0 * F.col("df") + 1)))
    weighed = materialise(by_term.join(counted, "term").select("item", "term", weight.cast("long").alias("weight")), "weights")
    first_id = F.array_min(F.transform("ids", lambda x: F.coalesce(x, F.lit(LAST))))
    heads = rows.where("term = X''").select("cluster", first_id.alias("first_id"))
    bounds = narrow.join(weighed, "term").groupBy("item", "cluster").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    left = materialise(bounds.where("bound > 0").join(heads, "cluster"), "bounds")
    found, width = spark.createDataFrame([], "item long, doc_id long, score long"), FIRST_ROUND
    while left.limit(1).count():
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
        ranked = materialise(left.withColumn("turn", F.row_number().over(order)), "turns")
        now = visit(ranked.where(F.col("turn") <= width).select("item", "cluster"), rows, weighed, k)
        found = materialise(best(found.unionByName(now), k), "found")
        reached = found.where(F.col("rank") == k).select("item", F.col("score").alias("_score"), F.coalesce("doc_id", F.lit(LAST)).alias("_id"))
        found = found.drop("rank")
        open_ = F.col("_score").isNull() | (F.col("bound") > F.col("_score")) | ((F.col("bound") == F.col("_score")) & (F.col("first_id") < F.col("_id")))
        after = materialise(ranked.where(F.col("turn") > width).drop("turn").join(reached, "item", "left").where(open_).drop("_score", "_id"), "bounds")
        discard(left, ranked)
        left, width = after, width * WIDER
    return best(found, k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of all docs. Empty tables give no rows."""
    return search(build(docs), items, k)
