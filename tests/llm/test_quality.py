import random
import re
from math import comb

import pytest

from caseweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", " \n\t", "one two", "a b c d e a b c d e", "x\nx\n\n x \nx", "# * $ a%b <c>", "ÉA é\x0bb", "w " * 30, "a b c d e f a b c d e g h a b c d e", "l" * 100_000, "up LOW " * 20 + "\n" + "z"]


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("text", [None, *TEXTS])
def test_metrics(text):
    assert quality.metrics_of(text)[:5] == brute(text)


def test_random_metrics():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "A", " ", " ", "\n", "#"]) for _ in range(rng.randrange(80)))
        assert quality.metrics_of(text)[:5] == brute(text)


def test_binomial():
    for n, p in ((10, 0.3), (40, 0.02)):
        for k in range(n):
            assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def test_certify():
    assert quality.certify([(0, 1), (0, 5), (1, 9), (90, 10)], 2000, 0.01, 0.05) == 2
    assert quality.certify([(0, 1)], 20, 0.01, 0.05) is None
    assert quality.certify([(0, 0)], 2000, 0.01, 0.05) is None
    assert quality.certify([(50, 9), (0, 1)], 1000, 0.01, 0.05) is None  # no test after one that fails
    assert quality.certify([], 0, 0.01, 0.05) is None


def test_guarantee():
    """Cutoffs chosen on samples lose more than alpha in at most about delta of the samples."""
    rng, alpha, delta, bad = random.Random(1), 0.05, 0.1, 0
    rates = [i / 200 for i in range(41)]  # true false rejection by cutoff
    for _ in range(200):
        draws = [rng.random() for _ in range(400)]
        counts = [(sum(d < r for d in draws), i + 1) for i, r in enumerate(rates)]
        i = quality.certify(counts, 400, alpha, delta)
        bad += i is not None and rates[i] > alpha
    assert bad <= 200 * delta * 1.5


def simulated(rng, n, strata):
    """(stratum, severities by rule, good) of n texts each; good texts rarely fail, by one rule or two."""
    out = []
    for s in range(strata):
        for _ in range(n):
            good = rng.random() < 0.8
            row = {r: min(48, int(rng.expovariate((0.9, 0.5, 1.5, 0.7, 0.4)[k] if good else 0.08))) for k, r in enumerate(quality.RATES)}
            out.append((s, row, good))
    return out


def learnt(rows, strata, alpha, delta):
    """What learn_cutoffs does, without tables."""
    found = {}
    for s in range(strata):
        mine = [(row, good) for t, row, good in rows if t == s]
        tuning, tested = mine[::5], [x for i, x in enumerate(mine) if i % 5]
        counts = [{r: [sum(g == want and row[r] >= level for row, g in tuning) for level in range(quality.LEVELS + 1)] for r in quality.RATES} for want in (True, False)]
        path = quality.path_of(*counts)
        first = {(r, v): i for r, v, i in quality.first_steps(path)}
        steps = {}
        for row, good in tested:
            step = min((first[r, v] for r, v in row.items() if (r, v) in first), default=None)
            g, b = steps.get(step, (0, 0))
            steps[step] = (g + good, b + (not good))
        found[s] = quality.certificate(str(s), path, steps, alpha, delta / strata)
    return found


def test_guarantee_of_all_rules_and_strata():
    """In at most about delta of the runs does any stratum lose over alpha of its good texts."""
    rng, alpha, delta, strata, bad, certified = random.Random(3), 0.1, 0.2, 2, 0, 0
    truth = [row for _, row, good in simulated(rng, 20000, 1) if good]
    for _ in range(60):
        found = learnt(simulated(rng, 300, strata), strata, alpha, delta)
        certified += sum(bool(c.cutoffs) for c in found.values())
        bad += any(sum(any(row[r] >= round(x * quality.STEPS) for r, x in c.cutoffs.items()) for row in truth) > alpha * len(truth) for c in found.values())
    assert certified > 60 and bad <= 60 * delta * 1.5


def test_reasons():
    few = quality.certificate("xx", [("symbols", 3)], {0: (0, 5), None: (20, 0)}, 0.03, 0.0125)
    assert not few.cutoffs and few.reason == "20 good texts, and 144 are needed"
    assert quality.certificate("xx", [], {None: (500, 3)}, 0.03, 0.0125).reason == "no rule rejects more bad than good texts"
    assert quality.certificate("xx", [("symbols", 3)], {0: (400, 5), None: (20, 0)}, 0.03, 0.0125).reason == "the first step isn't certified"


def table(spark, n=9000):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and a word some other many texts have".split()) + str(rng.randrange(300)) for _ in range(40)]
        good = i % 4 > 0
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), "en" if i % 50 else "xx", "clash"))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    rows += [(n, None, "en", ""), (None, "x " * 50, None, ""), (n, "dup", "en", "")]
    labels += [(None, 1, 0), (1, None, 0), (10**9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_judging(spark):
    docs, labels = table(spark)
    found = quality.judge(docs, labels).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id < 9000}
    assert all(r.kept == (r.doc_id % 4 > 0) for r in by.values() if r.doc_id % 50)
    assert all(r.kept for r in by.values() if not r.doc_id % 50 and not r.base_failed)  # too few labels: nothing is certified
    assert not any(r.kept for r in found if r.doc_id == 9000)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, r in by.items() if r.kept}
    assert quality.judge(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs.limit(0), labels).collect() == []
    plain = quality.judge(docs, labels.limit(0)).where("doc_id < 9000").collect()
    assert all(r.kept == (not r.base_failed) for r in plain)


def test_copies_and_repeated_labels_are_one_draw(spark):
    docs = spark.createDataFrame([(i, f"{i % 40} of these words make up a text that has ten words", "en") for i in range(2000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i != 39), 0) for i in range(2000)] * 2, "doc_id long, quality int, toxic int")
    rows = quality.measured(docs).select("doc_id", "lang", "text", *["_q_" + n for n, _ in quality.METRICS]).withColumnsRenamed({"lang": "stratum"}).selectExpr("*", "xxhash64(text) AS draw").drop("text")
    (found,) = quality.learn_cutoffs(rows, labels)
    assert found.good + found.bad <= 40 and found.bad == 0 and not found.cutoffs  # text 39 is labelled both ways


def test_clashing_names(spark):
    docs, labels = table(spark, 2000)
    kept = quality.keep_good(docs, labels)
    named = docs.selectExpr("*", "7 AS _q_n_words", "'x' AS _Q__q_n_words", "1 AS draw", "2 AS stratum")
    more = quality.keep_good(named, labels)
    assert more.columns == named.columns and more.count() == kept.count()
