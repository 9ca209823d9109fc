import math
import random
import re

import numpy as np

from caseweave.llm import lexical

LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, k=10):
    docs = [(key, terms(text)) for key, text in rows]
    docs = [(key, t, {x: t.count(x) for x in set(t)}) for key, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t, _ in docs)
    df: dict = {}
    for _, _, counts in docs:
        for x in counts:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked = [x for x in set(terms(text)) if x in df]
        weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x in asked}
        scored = []
        for key, t, counts in docs:
            m = 10 + (90 * len(t) * n) // length
            score = sum(weight[x] * ((1000000000 * counts[x]) // (1000 * counts[x] + 8 * m)) for x in asked if x in counts)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables(spark, rows, items):
    """Columns clash with those that the operator makes."""
    docs = spark.createDataFrame([(k, t, "x", 2, 3) for k, t in rows], "doc_id long, text string, terms string, row int, leaf int").repartition(3)
    return docs, spark.createDataFrame([(k, t, "y", 0) for k, t in items], "item_id long, text string, term string, item int")


def found(spark, rows, items, **settings):
    docs, asked = tables(spark, rows, items)
    out = lexical.search(lexical.build(docs, **settings), asked).select("item_id", "rank", "doc_id", "score")
    return sorted(map(tuple, out.collect()), key=str)


def corpus(n=400, seed=3):
    """Documents of a few topics each with words of its own, and common words."""
    rng = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    common = ["the", "Of", "and", "été", "x1"]
    rows = []
    for i in range(n):
        words = rng.choices(topics[rng.randrange(6)], k=rng.randrange(1, 40)) + rng.choices(common, k=rng.randrange(0, 20))
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    items = [(k, " ".join(rng.sample(topics[k % 6], 4)) + " the THE éTé") for k in range(12)]
    return rows, items


def test_like_brute_force_in_any_division(spark):
    rows, items = corpus()
    given = brute(rows, items)
    assert found(spark, rows, items) == given
    assert found(spark, rows, items, sample=100, block_postings=900, cluster_docs=8) == given


def test_ties_repeats_nulls_and_long_texts(spark):
    long_text = "needle " + "hay " * 60_000 + "Ünï日本 needle"
    rows = [(i, "the same words again") for i in range(40, 10, -1)] + [(5, "same words"), (5, "same words"), (None, "the same words again"), (None, None), (7, None), (8, ""), (9, ".,;!"), (3, long_text), (4, "needle")]
    items = [(1, "same WORDS same"), (1, "same WORDS same"), (2, None), (3, ""), (4, "needle Ünï日本"), (5, "nowhere"), (None, "again"), (6, "the")]
    given = brute(rows, items)
    assert found(spark, rows, items, cluster_docs=4, sample=16) == given
    only = [(i % 3, "one two") for i in range(15)] + [(None, "one two")]
    assert found(spark, only, [(1, "two")], cluster_docs=2) == brute(only, [(1, "two")])


def test_empty_tables(spark):
    rows, items = corpus(20)
    assert found(spark, [], items) == []
    assert found(spark, [(1, None), (2, "--")], items) == []
    assert found(spark, rows, []) == []


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 400), 0x3000, 0x1F600, 0x2028])) for _ in range(rng.randrange(40)))
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def test_bisection_gathers_topics():
    rng = np.random.default_rng(1)
    topic = rng.integers(0, 4, 256)
    edges = sorted({(i, int(topic[i]) * 50 + int(t)) for i in range(256) for t in rng.integers(0, 50, 30)})
    docs, words = np.array(edges).T
    clusters = lexical.bisected(docs, words, 256, 64)
    assert sorted(np.concatenate(clusters).tolist()) == list(range(256)) and max(map(len, clusters)) <= 64
    pure = sum(np.bincount(topic[c]).max() for c in clusters)
    assert pure > 0.8 * 256  # 0.3 in any random order


def test_search_leaves_clusters_out(spark, monkeypatch):
    rows, items = corpus(600, 5)
    items = items[:4]
    seen = []
    visit = lexical.visit
    monkeypatch.setattr(lexical, "visit", lambda work, *a: seen.append(work.count()) or visit(work, *a))
    monkeypatch.setattr(lexical, "FIRST_ROUND", 2)
    docs, asked = tables(spark, rows, items)
    index = lexical.build(docs, cluster_docs=16)
    out = lexical.search(index, asked).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in out), key=str) == brute(rows, items)
    assert sum(seen) < len(items) * index.rows.where("term = X''").count()
