import numpy as np
import pytest

from caseweave.llm import embeddings


def brute(rows, cosine=0.9):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links = {i: 0 for i in range(len(rows))}
    root = {k: k for k, _ in rows if k is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = {i: np.array(rows[i][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[i][1], np.float32).astype(float)) for i in ok}
    for i in ok:
        for j in ok:
            if i != j and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return links, {k: find(k) for k in root}


def near(rng, centre, n, spread):
    return [(centre + rng.normal(size=8) * spread).tolist() for _ in range(n)]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    vectors = [v for _ in range(12) for v in near(rng, rng.normal(size=8), 6, 0.08)] + near(rng, rng.normal(size=8), 90, 0.05) + rng.normal(size=(150, 8)).tolist()
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[5]]]
    odd = [None, [], [0.0] * 8, [1.0] * 7, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors) + len(odd)) + 5, vectors + odd)] + [(None, vectors[0])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, n_links int, rep string")
    found = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links, root = brute(rows)
    total = sum(links.values())
    got = sum(r.n_links for r in found.values())
    assert len(found) == len(rows) and 0.95 * total <= got <= total
    for i, (k, _) in enumerate(rows):
        assert found[k].n_links <= links[i]
    assert sum(found[k].component_id == c for k, c in root.items()) >= 0.97 * len(root)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values() if r.vec_id is not None)


def test_empty_and_unsound(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = embeddings.near_duplicates(spark.createDataFrame([(2, None), (1, [0.0])], schema)).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, True), (2, 0, 2, True)]
    same = embeddings.near_duplicates(spark.createDataFrame([(2, [1.0]), (1, [3.0]), (3, [-1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, same)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_each_length_is_linked(spark):
    rows = [(i, [1.0, float(i)] * 4) for i in range(6)] + [(20, [1.0, 2.0, 3.0]), (21, [2.0, 4.0, 6.0]), (22, [-1.0, 0.0, 0.0]), (30, [5.0]), (40, None), (41, [0.0, 0.0, 0.0]), (42, [])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(found) == len(rows)
    assert found[20] == (1, 20, True) and found[21] == (1, 20, False) and found[22] == (0, 22, True) and found[30] == (0, 30, True)
    assert all(found[i] == (0, i, True) for i in (40, 41, 42)) and found[5][0] > 0


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(2)
    index = embeddings.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(5, 3)), 2.5)
    unit = embeddings.unit_rows(rng.normal(size=(40, 6)))
    d1, d2 = index.distances(unit)
    for cells, a, b in zip(index.visits(unit), d1, d2):
        every = sorted((a[i] + b[j], i * 5 + j) for i in range(6) for j in range(5))
        assert cells == [c for d, c in every if d <= every[0][0] + 2.5]


@pytest.mark.parametrize("seed", range(5))
def test_roots_span_a_block(seed):
    rng = np.random.default_rng(seed)
    linked = rng.random((9, 8)) < 0.15
    left, right = np.arange(9) + 100, np.arange(8) + 50
    a, b = embeddings.roots(linked, left, right)
    for i, j in zip(*np.nonzero(linked)):
        assert a[i] == b[j]
    assert all(a[i] == left[i] for i in range(9) if not linked[i].any())
