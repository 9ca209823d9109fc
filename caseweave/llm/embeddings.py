"""Near-duplicate vectors by an inverted multi-index and exact verification."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

#: Vectors of a block, about, and visitors that are packed together; a cell with more is dealt over several.
BLOCK, VISITORS = 512, 2048


@dataclass
class MultiIndex:
    """A codebook per half of the vectors; a cell is a pair of codes.

    slack: the traversal of a vector visits the cells whose distance is at most that of its nearest
    cell plus the slack. The distance of a cell is the sum of the squared distances of the halves.
    """

    first: np.ndarray
    second: np.ndarray
    slack: float = 0.0

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return squared(unit[:, :cut], self.first), squared(unit[:, cut:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(unit)
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def needed(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The slack with which the vector's traversal reaches the cell, row by row."""
        d1, d2 = self.distances(unit)
        a, b = np.divmod(cells, len(self.second))
        rows = np.arange(len(unit))
        return d1[rows, a] + d2[rows, b] - d1.min(axis=1) - d2.min(axis=1)

    def visits(self, unit: np.ndarray) -> list[list[int]]:
        """The cells each vector visits, nearest first: the multi-sequence algorithm.

        Both halves' codes are sorted by distance. A queue holds pairs of ranks by the sum of their
        distances; the least is taken, and a pair enters once both pairs before it were taken.
        """
        out = []
        for d1, d2 in zip(*self.distances(unit)):
            o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
            s1, s2 = d1[o1].tolist(), d2[o2].tolist()
            limit = s1[0] + s2[0] + self.slack
            queue, taken, cells = [(s1[0] + s2[0], 0, 0)], set(), []
            while queue:
                d, i, j = heapq.heappop(queue)
                if d > limit:
                    break
                taken.add((i, j))
                cells.append(o1[i] * len(o2) + o2[j])
                if i + 1 < len(s1) and (not j or (i + 1, j - 1) in taken):
                    heapq.heappush(queue, (s1[i + 1] + s2[j], i + 1, j))
                if j + 1 < len(s2) and (not i or (i - 1, j + 1) in taken):
                    heapq.heappush(queue, (s1[i] + s2[j + 1], i, j + 1))
            out.append(cells)
        return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = squared(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def unit_rows(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float, per_cell: int = 256, seed: int = 0) -> MultiIndex:
    """Codebooks from a sample of unit vectors, sized for so many rows, and the slack for the recall.

    A pair is found if either vector's traversal reaches the other's cell. The slack is the recall
    quantile of what such pairs need: pairs of a sample vector with a vector at exactly the cosine
    from it in a random direction, the furthest that still link, and the linked pairs of the sample.
    """
    k = max(1, ceil(sqrt(rows / per_cell)))
    cut = sample.shape[1] // 2
    index = MultiIndex(k_means(sample[:, :cut], k, seed=seed), k_means(sample[:, cut:], k, seed=seed + 1))
    rng = np.random.default_rng(seed)
    q = sample[:4000]
    other = rng.normal(size=q.shape)
    other -= (other * q).sum(axis=1, keepdims=True) * q
    norm = np.sqrt((other * other).sum(axis=1, keepdims=True))
    w = cosine * q + sqrt(1 - cosine * cosine) * other / np.where(norm > 0, norm, 1)
    needs = [np.minimum(index.needed(q, index.cells(w)), index.needed(w, index.cells(q)))]
    a, b = np.nonzero(np.triu(sample[:2000] @ sample[:2000].T >= cosine, 1))
    if len(a):
        needs.append(np.minimum(index.needed(sample[a], index.cells(sample[b])), index.needed(sample[b], index.cells(sample[a]))))
    index.slack = max(float(np.quantile(x, recall)) for x in needs if len(x)) + 1e-9
    return index


def roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name that each row and column of a block reaches through its links."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1, initial=top))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(axis=0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def fields(packs: pa.Array) -> tuple:
    return packs.offsets.to_numpy(), packs.values


def matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), -1))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, sample: int = 20000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; linked vectors share a component.

    Exact copies are one entry of the index. The codebooks and the slack are fitted on a sample of
    about so many distinct vectors, chosen by hash; all are indexed. Every vector's traversal asks for
    the cells that it visits; what meets in a cell is verified in double precision, block against
    block. Each link is counted once, though both ends may find it. A block returns, per vector, the
    number of its links there and the smallest vector that it reaches, so that a large group of near
    copies gives rows in proportion to its vectors and not to its pairs. A cell with more vectors or
    more visitors than a block or a pack holds is dealt over several.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
    components of their own. Vectors of each length are a table of their own. Repeated rows are vectors
    of their own, and count as links of each other. A row without vec_id has no links, no component and isn't kept. Rows
    that share an id and a length are one vector for the components. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    lengths = sorted(r[0] for r in rows.where(sound).select(F.size("v")).distinct().collect())
    if len(lengths) > 1:  # vectors of different lengths never link: an index for each
        size = F.size("embedding")
        parts = [near_duplicates(vectors.where(size == n), cosine, recall, sample) for n in lengths]
        return reduce(DataFrame.unionByName, parts, near_duplicates(vectors.where(F.col("embedding").isNull() | ~size.isin(lengths)), cosine, recall, sample))
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    entries = materialise(rows.where(sound).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "entries")
    total = entries.count()
    share = min(1.0, sample / total)
    chosen = entries.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toPandas()["v"]
    if not len(chosen):
        chosen = entries.select("v").limit(sample).toPandas()["v"]
    index = fit(unit_rows(np.array(chosen.tolist())), total, cosine, recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks, each of sqrt(rows / 256) half vectors

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                raw = np.array(batch.column("v").to_pylist(), kind)
                unit = unit_rows(raw)
                visits = shared.value.visits(unit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("n"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(shared.value.cells(unit)), pa.array(visits, pa.list_(pa.int64()))],
                    names=["rep", "n", "vec", "cell", "visits"],
                )

    placed = materialise(entries.select("rep", "n", "v").mapInArrow(assign, "rep long, n long, vec binary, cell long, visits array<long>"), "placed")
    stored = placed.select("cell", "rep", "n", "vec")
    probes = placed.select(F.explode("visits").alias("cell"), "rep", "n", "vec", F.col("cell").alias("own"))
    s_sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    p_sizes = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("p_blocks"))
    sizes_of = materialise(s_sizes.join(p_sizes, "cell"), "cells")
    deal = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks))
    packed = lambda *names: F.collect_list(F.struct(*names))
    s_packs = stored.join(sizes_of, "cell").select("cell", deal("blocks").alias("block"), "p_blocks", "rep", "n", "vec").groupBy("cell", "block", "p_blocks").agg(packed("rep", "n", "vec").alias("stored"))
    # Visitors are the greater side: they stay where they are packed, and the blocks are sent to them.
    s_packs = s_packs.select("cell", "stored", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_blocks") - 1)).alias("p_block"))
    p_packs = probes.join(sizes_of, "cell").select("cell", deal("p_blocks").alias("p_block"), "rep", "n", "vec", "own").groupBy("cell", "p_block").agg(packed("rep", "n", "vec", "own").alias("probes"))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            (p_at, p), (s_at, s) = fields(batch.column("probes")), fields(batch.column("stored"))
            names, links, found = [], [], []
            for i in range(batch.num_rows):
                q, w = (x.slice(at[i], at[i + 1] - at[i]) for x, at in ((p, p_at), (s, s_at)))
                q_rep, w_rep, q_n, w_n = (x.field(f).to_numpy(zero_copy_only=False) for f in ("rep", "n") for x in (q, w))
                q_unit, w_unit = matrix(q.field("vec"), kind), matrix(w.field("vec"), kind)
                linked = (q_unit @ w_unit.T >= cosine) & (q_rep[:, None] != w_rep[None, :])
                if not linked.any():
                    continue
                a, b = np.nonzero(linked)
                d1, d2 = index.distances(w_unit)
                c1, c2 = np.divmod(q.field("own").to_numpy(zero_copy_only=False), len(index.second))
                reach = d1.min(axis=1) + d2.min(axis=1) + index.slack
                unseen = d1[b, c1[a]] + d2[b, c2[a]] > reach[b]  # else it is counted where w asks
                q_links = np.bincount(a, w_n[b], minlength=len(q_rep))
                w_links = np.bincount(b, q_n[a] * unseen, minlength=len(w_rep))
                q_root, w_root = roots(linked, q_rep, w_rep)
                for rep, n, root, has in ((q_rep, q_links, q_root, linked.any(axis=1)), (w_rep, w_links, w_root, linked.any(axis=0))):
                    names.append(rep[has])
                    links.append(n[has].astype(np.int64))
                    found.append(root[has])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, links, found)], names=["rep", "links", "root"])

    met = materialise(p_packs.join(s_packs, ["cell", "p_block"]).select("probes", "stored").mapInArrow(verify, "rep long, links long, root long"), "links")
    found = connected_components(met, "rep", "root").withColumnRenamed("node", "rep")
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    known = entries.join(counts, "rep", "left").join(found, "rep", "left")
    known = materialise(known.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    out = rows.withColumn("key", F.when(sound, F.col("v"))).join(known.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), (F.col("vec_id").eqNullSafe(component) & F.col("vec_id").isNotNull()).alias("kept"))
