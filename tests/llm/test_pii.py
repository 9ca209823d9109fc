import hashlib
import random
import re

import numpy as np
import pytest

from caseweave.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [None, "", "a@b", "a.b+c@x-y.co.uk, d@e.f", "@x.y", "a@@b.c", "a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (168) 555-5254", "+123", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é😀 x@y.zz", "no digits", "9" * 3000, "1." * 500, "4111111111111111 +4111111111111111"]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def noise(n=1500):
    rng = random.Random(6)
    bits = ["1", "23", "4111111111111111", ".", "@", "a", "B-", "+", " ", "-", "(", ")", "x.y", "255", "é", "0"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_base_spans():
    for text in TEXTS + noise():
        assert pii.base_spans(text) == base(text), text


def test_leading_zeros_of_any_number():
    for n in (0, 2, 1200, 5000):
        text = "0" * n + "1.2.3." + "0" * n + "255"
        assert (0, 1, len(text)) in pii.base_spans(text)
        assert not any(k == 1 for _, k, _ in pii.base_spans("0" * n + "256.2.3.4 " + "9" * (n + 4) + ".1.1.1"))


def test_long_runs_are_linear():
    for text in ("x" * 400_000 + "@", "9" * 400_000, "1.1" * 100_000, "+" + " " * 400_000, ("a" * 50 + "@") * 8000, "9 " * 200_000):
        pii.base_spans(text)


def test_gradient():
    tagger = pii.Tagger.fresh(3, 1)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.PAD + 1, (7, 4)), rng.integers(0, pii.TAGS, (7, 4))
    _, grads = tagger.gradient(x, y)
    for name in tagger.w:
        flat = tagger.w[name].reshape(-1)
        for i in rng.choice(flat.size, 4, replace=False):
            kept, step = flat[i], 1e-2
            flat[i] = kept + step
            up, _ = tagger.gradient(x, y)
            flat[i] = kept - step
            down, _ = tagger.gradient(x, y)
            flat[i] = kept
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=4e-3), name


def test_windows_cover():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("aaaaaaaaaaaaaaaaaaaaaaa1@ ") for _ in range(rng.randrange(900)))
        begins = pii.windows_of(text)
        for m in pii.TRIGGER.finditer(text):
            a, b = max(0, m.start() - 8), min(len(text), m.start() + pii.AROUND)
            assert any(w <= m.start() and m.start() < w + pii.WINDOW for w in begins)
            assert all(any(w <= i < w + pii.WINDOW for w in begins) for i in range(a, b))
    assert pii.windows_of("no triggers at all") == []


def test_reconciling():
    """A place takes what the window says in which it is furthest from an edge; gaps part stretches."""
    p = {b: np.full((96, pii.TAGS), b, np.float32) for b in (0, 48, 144, 400)}
    (first, one), (second, two) = pii.regions(p)
    assert (first, len(one), second, len(two)) == (0, 240, 400, 96)
    assert one[:72, 0].max() == 0 and one[73, 0] == 48 and one[-1, 0] == 144
    probs = np.full((3, 1, pii.TAGS), 0.01)
    probs[0, 0, 2] = probs[1, 0, 2] = probs[2, 0, 0] = 0.9  # inside without a begin isn't allowed
    probs[0, 0, 1] = 0.05
    assert pii.best_tags(probs).ravel().tolist() == [1, 2, 0]


def test_long_spans_are_joined(tagger):
    """A value longer than a window, with its trigger far from its begin."""
    words = "some plain words stand before it and "
    for n in (30, 60, 150):
        value = "long.name" * (n // 9) + "x9@" + "sub." * (n // 8) + "example.org"
        text = words * 4 + value + " " + words * 4
        spans = pii.model_spans(tagger, [text])[0]
        assert any(s <= len(words * 4) + 2 and e >= len(words * 4) + len(value) - 4 for s, _, e in spans), (n, spans)


def test_added_spans_through_find(spark, tagger):
    """Values in forms that the base patterns miss, in texts the model hasn't seen."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(400):
        kind = [0, 2, 3][i % 3]
        value = pii.invented(rng, kind)
        while pii.base_spans(value):
            value = pii.invented(rng, kind)
        left = "another text with words of its own, where one reads "
        rows.append((i, left + value + " and then further on in the same line"))
        want[i] = (len(left), pii.KINDS[kind], len(left) + len(value))
    rows += [(1000 + i, f"in {1800 + i} there were {i} of them, {i}.{i % 12 + 1}.2004, v{i % 9}.2.1 for ${i}.50 at {i % 24}:30") for i in range(200)]
    found = {r.doc_id: [(f.start, f.kind, f.end) for f in r.found if not f.base] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    hits = sum(w in found[i] for i, w in want.items())
    print("found", hits / len(want), "precision", hits / sum(map(len, found.values())))
    assert hits > 0.8 * len(want)
    assert hits > 0.95 * sum(map(len, found.values()))


@pytest.fixture(scope="module")
def tagger():
    x, y = pii.examples(["some plain words that stand around a value in a text and go on for a while"], 2400, 3)
    t = pii.Tagger.fresh(32, 0)
    losses = t.train(x, y, 8)
    assert losses[-1] < losses[0] / 5
    return t


def test_model_on_held_out_examples(tagger):
    x, y = pii.examples(["other words of another text, which the model hasn't seen, stand here"], 300, 77)
    tags = pii.best_tags(tagger.marginals(np.ascontiguousarray(x.T)))
    assert ((tags.T == y) & (y > 0)).sum() > 0.8 * (y > 0).sum()
    assert ((tags.T > 0) & (y == 0)).sum() < 0.05 * (y == 0).sum()


def test_query_columns(spark, tagger):
    given = list(enumerate(TEXTS + noise(100))) + [(None, "a@b.cc"), (3, "again a@b.cc"), (2, None)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, found string")
    found = pii.digest(pii.find(rows, tagger)).collect()
    sha = lambda t: hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t)).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == sorted((str(i), sha(t), *(sum(k == n for _, k, _ in base(t)) for n in range(4))) for i, t in given)
    for (i, t), r in ((g, r) for g in given for r in found if r.doc_id == g[0] and len([x for x in given if x[0] == g[0]]) == 1):
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t)} <= set(r.spans.split(","))
    assert pii.find(rows.limit(0), tagger).collect() == []


def test_training_from_a_table(spark):
    docs = spark.createDataFrame([(i, f"words before someone{i}@example.org and words after it, in all {i} of them") for i in range(60)], "doc_id long, text string")
    assert sum(r.n_email for r in pii.digest(pii.find(docs, windows=60, epochs=1)).collect()) == 60
