"""Quality rules whose cutoffs are certified on labelled documents by exact binomial tests."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, private, with_columns

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

METRICS = [(n, "long") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper")]

#: Each rule rejects a document whose rate, the first over the second, is above the cutoff.
RATES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_windows": ("n_repeat_words", "n_words"),
    "repeated_words": ("n_words - {p}n_distinct_words", "n_words"),
    "upper_case": ("n_upper", "word_chars"),
}
#: A cutoff is a level over STEPS; levels run from LEVELS, lenient, down to 1, strict.
STEPS, LEVELS = 50, 48
#: One in so many labelled texts proposes the order of tests; the others are tested.
TUNING = 5


def metrics_of(text: str | None) -> tuple[int, ...]:
    """The METRICS of one text; words are runs of other characters than ASCII white space."""
    if not text:
        return (0,) * len(METRICS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = [b" ".join(words[i : i + 5]) for i in range(n - 4)]
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set[bytes] = set()
        twice = set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        covered = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 5 - max(covered, i)
                covered = i + 5
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def measured(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """docs and the METRICS of their text, each with the prefix before its name."""

    def rows(texts: list) -> list[pa.Array]:
        return [pa.array(x, pa.int64()) for x in zip(*map(metrics_of, texts))] if texts else [pa.array([], pa.int64())] * len(METRICS)

    return with_columns(docs, rows, [(prefix + n, k) for n, k in METRICS], text)


def severity(rule: str, prefix: str = "_q_") -> Column:
    """The strictest level that the rule's rate doesn't fail is one above this: how many of the cutoffs
    1 / STEPS to LEVELS / STEPS the rate is above. 0 where there is nothing to divide by."""
    top, bottom = (prefix + x.format(p=prefix) for x in RATES[rule])
    return F.expr(f"CASE WHEN {bottom} > 0 AND {top} > 0 THEN least({LEVELS}, ({STEPS} * ({top}) - 1) div {bottom}) ELSE 0 END").cast("long")


def base_failed(prefix: str = "_q_") -> Column:
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n and p."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a binomial share, at level 1 - delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


@dataclass(frozen=True)
class Certificate:
    """The cutoffs of a stratum, and what all of its rules together reject of the tested texts.

    bound: the exact upper confidence bound of the share of good texts that they reject. Without
    cutoffs, reason says why there are none.
    """

    stratum: str
    cutoffs: dict[str, float]
    good: int
    good_rejected: int
    bad: int
    bad_rejected: int
    bound: float
    reason: str = ""


def certify(counts: list[tuple[int, int]], good: int, alpha: float, delta: float) -> int | None:
    """Which step of a sequence to stop at, given (good, bad) rejected up to each step.

    Fixed-sequence testing: the steps are tested in their order at level delta, each that its false
    rejection rate is over alpha, up to the first that isn't refuted; a chain of tests in an order
    fixed beforehand needs no correction for its length. Of those certified, the most lenient is taken
    that rejects as many bad documents as the strictest, one in a hundred less at most.
    """
    passed = 0
    while passed < len(counts) and good and binomial_tail(counts[passed][0], good, alpha) <= delta:
        passed += 1
    if not passed or not counts[passed - 1][1]:
        return None
    enough = 0.99 * counts[passed - 1][1]
    return next(i for i in range(passed) if counts[i][1] >= enough)


def path_of(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[tuple[str, int]]:
    """The steps (rule, level) in the order to test them, from what the tuning part says.

    good[rule][level] is how many good texts the rule rejects at that level. A step makes one rule
    stricter, and only where that rejects more further bad texts than good ones, so that no risk is
    spent on rules that find nothing. The next step is that of the rule that then rejects the fewest
    good texts; of equals, that which rejects the most bad ones.
    """
    chains = []
    for rule in RATES:
        chain: list[tuple[int, int, str, int]] = []
        lost = gained = 0
        for level in range(LEVELS, 0, -1):
            g, b = good[rule][level], bad[rule][level]
            if b - gained > g - lost:
                chain.append((g, -b, rule, level))
                lost, gained = g, b
        chains.append(chain)
    out = []
    while any(chains):
        out.append(min(filter(None, chains), key=lambda c: c[0][:2]).pop(0)[2:])
    return out


def first_steps(path: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(rule, severity, step): the first step at which the rule rejects a text of that severity."""
    out = []
    for rule in RATES:
        for v in range(1, LEVELS + 1):
            step = next((i for i, (r, level) in enumerate(path) if r == rule and level <= v), None)
            if step is not None:
                out.append((rule, v, step))
    return out


def certificate(stratum: str, path: list[tuple[str, int]], rejected: dict[int | None, tuple[int, int]], alpha: float, delta: float) -> Certificate:
    """What is certified for a stratum. rejected: (good, bad) texts first rejected at each step, those
    that no step rejects under None."""
    good, bad = (sum(x[k] for x in rejected.values()) for k in (0, 1))
    counts, total = [], (0, 0)
    for i in range(len(path)):
        new = rejected.get(i, (0, 0))
        total = total[0] + new[0], total[1] + new[1]
        counts.append(total)
    i = certify(counts, good, alpha, delta)
    if i is None:
        least = ceil(log(delta) / log1p(-alpha))
        reason = f"{good} good texts, and {least} are needed" if good < least else "no rule rejects more bad than good texts" if not path else "the first step isn't certified"
        return Certificate(stratum, {}, good, 0, bad, 0, 0.0, reason)
    cutoffs = {rule: min(level for r, level in path[: i + 1] if r == rule) / STEPS for rule in dict(path[: i + 1])}
    return Certificate(stratum, cutoffs, good, counts[i][0], bad, counts[i][1], upper_bound(counts[i][0], good, delta))


def learn_cutoffs(documents: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> list[Certificate]:
    """A certificate per stratum. documents: doc_id, stratum, draw (a hash of the text) and the
    prefixed METRICS.

    With probability 1 - delta at least, no stratum loses more than alpha of its good documents to all
    of its rules together. A fifth of the labelled texts, by their hash, proposes the order of steps;
    on the others, which had no part in that, the steps are tested in this order, each for everything
    rejected up to it (fixed sequence), with delta shared by the strata (Bonferroni).

    Draws are distinct texts: copies and repeated labels count once, and a text with clashing labels is
    a good one. Texts that the base rules fail aren't drawn. Every label is used; the driver sees a few
    hundred counts per stratum.
    """
    spark = documents.sparkSession
    labels = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("_label_id"), F.col("quality").cast("int").alias("_label"))
    known = documents.where(~base_failed()).join(labels, F.col("doc_id") == F.col("_label_id"))
    draws = known.groupBy("stratum", "draw").agg(F.max("_label").alias("good"), *[F.max(severity(r)).alias(r) for r in RATES])
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("severity")) for r in RATES]))
    draws = materialise(draws.select("stratum", "draw", "good", (F.pmod("draw", F.lit(TUNING)) == 0).alias("tuning"), rates.alias("r")).select("stratum", "draw", "good", "tuning", "r.*"), "draws")
    both = [F.count_if(F.col("good") == 1).alias("g"), F.count_if(F.col("good") == 0).alias("b")]

    seen: dict[str, tuple[dict, dict]] = {}
    for row in draws.where("tuning").groupBy("stratum", "rule", "severity").agg(*both).collect():
        counts = seen.setdefault(row.stratum, tuple({r: [0] * (LEVELS + 1) for r in RATES} for _ in range(2)))
        for level in range(1, row.severity + 1):
            counts[0][row.rule][level] += row.g
            counts[1][row.rule][level] += row.b
    paths = {stratum: path_of(*counts) for stratum, counts in seen.items()}
    steps = spark.createDataFrame([(s, *step) for s, path in paths.items() for step in first_steps(path)], "stratum string, rule string, severity long, step long")
    tested = draws.where("not tuning").join(steps, ["stratum", "rule", "severity"], "left").groupBy("stratum", "draw", "good").agg(F.min("step").alias("step"))
    rejected: dict[str, dict[int | None, tuple[int, int]]] = {}
    for row in tested.groupBy("stratum", "step").agg(*both).collect():
        rejected.setdefault(row.stratum, {})[row.step] = row.g, row.b
    return [certificate(s, paths.get(s, []), rejected[s], alpha, delta / len(rejected)) for s in sorted(rejected)]


def rejected(certificates: list[Certificate], stratum: Column, prefix: str = "_q_") -> Column:
    """Whether one of the stratum's rules rejects the row."""
    fails = F.lit(False)
    for c in certificates:
        for rule, cutoff in c.cutoffs.items():
            fails = fails | ((stratum == c.stratum) & (severity(rule, prefix) >= round(cutoff * STEPS)))
    return fails


def stratum_of(docs: DataFrame, column: str = "lang") -> Column:
    """The stratum of a row, the empty string where it is null or there is no such column."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in docs.columns else F.lit("")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(doc_id, the METRICS, base_failed, kept) of every document.

    base_failed: fewer than 10 words, or over a fifth of them in repeated 5-word windows. Such
    documents aren't kept, the others are unless a certified rule rejects them; cutoffs are learnt
    from the labelled documents that the base rules pass.

    A null or empty text has no words and fails the base rules. Labels of unknown documents, null
    labels and labels without an id are ignored; repeated ones count once, a text with clashing ones
    is good. Rows without an id are judged like any other. No labels: only the base rules decide. An
    empty table gives an empty result. Texts of any length are read whole.
    """
    names = ["_q_" + n for n, _ in METRICS]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stratum_of(docs, stratum).alias("stratum"))
    rows = materialise(measured(slim).select("doc_id", "stratum", F.xxhash64("text").alias("draw"), *names), "quality")
    found = learn_cutoffs(rows, labels, alpha, delta)
    return rows.select("doc_id", *[F.col("_q_" + n).alias(n) for n, _ in METRICS], base_failed().alias("base_failed"), (~base_failed() & ~rejected(found, F.col("stratum"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """The documents that judge keeps, with their columns; each text is measured once.

    Nulls, empty texts, repeated rows and labels as in judge: repeated rows are kept or go together.
    Columns of any name may be in docs.
    """
    p = private(docs, "_q_")
    rows = materialise(measured(docs, prefix=p), "measured")
    metrics = [F.col(p + n).alias("_q_" + n) for n, _ in METRICS]
    found = learn_cutoffs(rows.select(F.col("doc_id").cast("long").alias("doc_id"), stratum_of(docs, stratum).alias("stratum"), F.xxhash64("text").alias("draw"), *metrics), labels, alpha, delta)
    return rows.where(~base_failed(p) & ~rejected(found, stratum_of(docs, stratum), p)).select(docs.columns)
