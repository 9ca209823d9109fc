import random

import pytest
import xxhash

from caseweave.llm import simhash
from caseweave.llm.components import connected_components

COLUMNS = "doc_id long, text string, component_id string, f0 int"


def brute(texts, words=3):
    prints = []
    for text in texts:
        parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        runs = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return prints


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps ZETA Élan eta\ttheta".split(" ")) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.02 else "new" for w in t.split(" ")) for t in base for _ in range(4)]
    return [*base, *near, *base[:10], None, "", " \t\n", "one", "one two", "ONE two", "long " * 30000, "x" * 200000]


def test_matches_brute_force(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], COLUMNS)
    found = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    prints = brute(texts)
    assert [int(found[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert all(len(r.fingerprint) == 16 for r in found.values())
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert {i: r.component_id for i, r in found.items()} == groups(range(len(texts)), linked)
    assert len({found[texts.index(t)].component_id for t in (None, "", " \t\n")}) == 1


def test_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q")], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(rows).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 1)]


@pytest.mark.parametrize("edits", [1, 3])
def test_wide_tables_find_near_copies(spark, edits):
    rng = random.Random(edits)
    rows, n = [], 30
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(words), "en"))
        for _ in range(edits):
            words[rng.randrange(300)] = "edit"
        rows.append((1000 + i, " ".join(words), "en"))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=5)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == ["doc_id", "text", "lang"]
    assert set(range(n)) <= ids and len(ids) <= n + 3


def at_similarity(rng, similar, n=300, words=5):
    """Two texts whose sets of shingles have about this similarity: a run of words is replaced."""
    a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shingles = n - words + 1
    lost = round(shingles * (1 - similar) / (1 + similar))
    at = rng.randrange(words, n - lost - words)
    b = list(a)
    b[at : at + lost - words + 1] = [f"v{rng.randrange(10**6)}" for _ in range(lost - words + 1)]
    return " ".join(a), " ".join(b)


def test_wide_search_at_the_threshold(spark):
    rng, rows, n = random.Random(8), [], 300
    for i in range(n):
        a, b = at_similarity(rng, 0.81)
        rows += [(i, a), (1000 + i, b)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5)
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(n)) <= ids and len(ids) - n <= n // 10


def test_blocks_compare_every_pair(spark, monkeypatch):
    """A chain: neighbours are near copies, its ends aren't; every block pair must be compared."""
    monkeypatch.setattr(simhash, "BLOCK", 2000)
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(300)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = rng.randrange(290)
        words[at : at + 5] = [f"e{i}.{k}" for k in range(5)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5)
    assert [r.doc_id for r in kept.collect()] == [0]


def test_like_all_pairs(spark, monkeypatch):
    """Families of texts that share passages, so that groups hold strangers, chains and large components."""
    monkeypatch.setattr(simhash, "BLOCK", 3000)
    rng, texts = random.Random(12), []
    for family in range(6):
        shared = [f"s{family}.{k}" for k in range(120)]
        for _ in range(8):
            own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 100]))]
            base = shared + own
            for _ in range(rng.choice([1, 2, 12])):
                words = list(base)
                for _ in range(rng.randrange(5)):
                    words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
                texts.append(words)
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = simhash.one_of_each(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), words=5)
    ids = {r.doc_id for r in kept.collect()}
    want = {i for i in range(len(texts)) if find(i) == i}
    assert want <= ids and len(ids - want) <= 2


def test_clashing_names(spark):
    rows = [(i % 3, "a b c d e f g h") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _caseweave_id", "2 AS node", "3 AS n", "'x' AS component")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]


def test_pairs_below_the_threshold_stay(spark):
    """Pairs at 0.72 pass the fingerprint's filter and mostly share a band, and still aren't linked."""
    rng, rows = random.Random(10), []
    for i in range(100):
        a, b = at_similarity(rng, 0.72)
        rows += [(i, a), (1000 + i, b)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5)
    assert kept.count() == 200


def test_short_texts_at_the_threshold(spark):
    """Eight and nine words, four of five shingles: SimHashes of such pairs differ in many bits."""
    rng, rows, n = random.Random(4), [], 300
    for i in range(n):
        a = [f"w{rng.randrange(10**6)}" for _ in range(8)]
        rows += [(i, " ".join(a)), (1000 + i, " ".join([*a, f"v{i}"]))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()}
    assert set(range(n)) <= kept and len(kept) - n <= n // 20


def test_common_passages_don_t_lose_links(spark, monkeypatch):
    """Bands that a common passage makes hold strangers, among them pairs that link."""
    monkeypatch.setattr(simhash, "BLOCK", 400)
    rng, rows = random.Random(3), []
    passage = [f"p{k}" for k in range(100)]
    for i in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(i, " ".join(passage + own)), (1000 + i, " ".join([*passage, *own[:-2], "x", f"y{i}"]))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()}
    assert kept == set(range(40))


def test_repeated_ids_are_judged_by_row(spark):
    one, two, three = ("one " * 3 + "a b c d e f g h", "two i j k l m n o p", "three q r s t u v w x")
    rows = [(1, one), (1, one), (2, one), (2, two), (3, three), (3, three), (None, one), (None, one)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5)
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(0, one), (0, one), (1, one), (2, two), (3, three)])


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (200, 150)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
