import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseweave.llm import langid

WORDS = {"en": "the of and to in that was his with for this which from have".split(), "de": "der die und den von das nicht mit sich auf für ist über können".split(), "fr": "le la les des est dans une pour que qui avec été être où".split()}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, lang, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))).capitalize() + ".") for i in range(n) for lang in [list(WORDS)[i % 3]]]


def reference(counts, gram, alphabet):
    """Interpolated Kneser-Ney over dictionaries: P(last symbol | the others)."""
    tables = {langid.ORDER: Counter(counts)}
    for k in range(langid.ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    p = 1 / alphabet
    for k in range(1, langid.ORDER + 1):
        t, g = tables[k], gram[langid.ORDER - k :]
        n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.1))
        followers = {h: v for h, v in t.items() if h[:-1] == g[:-1]}
        if followers:
            total = sum(followers.values())
            p = max(followers.get(g, 0) - d, 0) / total + d * len(followers) / total * p
    return p


def test_grams():
    grams, whose = langid.symbol_grams(["ab", "1", "c-d", ""])
    assert ["".join(map(chr, g)) for g in grams.tolist()] == ["   a", "  ab", " ab ", "   c", "  c ", "   d", "  d "]
    assert whose.tolist() == [0, 0, 0, 2, 2, 2, 2]
    assert len(langid.symbol_grams(["12", "-"])[0]) == 0 == len(langid.symbol_grams([])[0])


def test_probabilities():
    counts = defaultdict(Counter)
    for _, lang, text in corpus(60):
        for g in langid.symbol_grams(text.lower().split())[0].tolist():
            counts[lang]["".join(map(chr, g))] += 1
    model = langid.fit(pd.DataFrame([(lang, g, n) for lang, c in counts.items() for g, n in c.items()], columns=["lang", "gram", "n"]))
    for word in ("the", "über", "xyz", "où", "a-b"):
        cost, n = model.costs([word])
        grams = ["".join(map(chr, g)) for g in langid.symbol_grams([word])[0].tolist()]
        assert n.tolist() == [len(grams)]
        for j, lang in enumerate(model.languages):
            assert cost[0, j] == pytest.approx(-sum(np.log(reference(counts[lang], g, model.alphabet)) for g in grams), rel=1e-4)
    for keys, _ in (*model.grams, *model.histories):
        assert (np.diff(keys.astype(object)) > 0).all()


def test_held_out_accuracy(spark):
    rows = [(i, t, lang, "x", 0.0) for i, lang, t in corpus(600)]
    extra = [(10_000, None, "en", "", 0.0), (10_001, "", None, "", 0.0), (10_002, "12 34 ,.", "en", "", 0.0), (None, "le la les", "fr", "", 0.0), (10_003, "the of and " * 20000, None, "", 0.0), (10_003, "the of", None, "", 0.0), (10_004, "щука ждёт обед " * 20, None, "", 0.0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, held_out string, score double")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows + extra)
    truth = {i: lang for i, _, lang, _, _ in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    for i in (10_000, 10_001, 10_002):
        (r,) = [r for r in found if r.doc_id == i]
        assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert next(r for r in found if r.doc_id is None).held_out is None
    assert next(r for r in found if r.doc_id == 10_004).rejected
    assert sum(r.rejected for r in held) <= 0.02 * len(held)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not {10_000, 10_001, 10_002, 10_004} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).collect() == []


def test_folds(spark):
    import zlib

    rows = spark.range(100).select("id", langid.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_clashing_names_and_odd_rows(spark):
    rows = [(i, "the words of this text are english and there are some of them", "en") for i in range(400)] + [(1000, None, "en"), (1001, "", None), (1002, "12 34", "en"), (None, "these words have no id but are english", None)]
    rows += [(5, rows[5][1], "en"), (1003, "the words of this text are english " * 30000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS _rejected", "2 AS _caseweave_rejected", "'x' AS _score")
    kept = langid.keep_known(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(5) == 2 and not {1000, 1001, 1002} & set(ids) and 1003 in ids
    assert langid.keep_known(docs.limit(0)).collect() == []
