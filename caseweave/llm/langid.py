"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, private, slices, with_columns

ORDER = 4
EDGE = 32  # the symbol before and after a word
UNKNOWN = "und"
#: Words whose scores a task remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 18
#: Symbols up to which evidence counts for the score; more text doesn't make it surer.
EVIDENCE = 400


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def hashed(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of symbols."""
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = (h + grams[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def symbol_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word): ORDER symbols ending at each predicted one, and which word it belongs to.

    Letters are symbols; a run of anything else is a word's edge. A run of letters is predicted
    symbol by symbol and then its edge, from a history that begins with edges only.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    letter = is_letter()[codes]
    first = np.zeros(len(codes), bool)
    first[starts[sizes > 0]] = True
    owner = np.repeat(np.arange(len(words)), sizes)
    places = np.flatnonzero(letter)
    if not len(places):
        return np.empty((0, ORDER), np.int64), np.empty(0, np.int64)
    new_run = np.ones(len(places), bool)
    new_run[1:] = (np.diff(places) > 1) | first[places[1:]]
    run = np.cumsum(new_run) - 1
    out = np.full(len(places) + ORDER * (run[-1] + 1), EDGE, np.int64)  # ORDER - 1 edges before a run, one after
    at = np.arange(len(places)) + ORDER * run + ORDER - 1
    out[at] = codes[places]
    last = np.append(new_run[1:], True)
    predicted = np.sort(np.concatenate([at, at[last] + 1]))
    whose = np.empty(len(out), np.int64)
    whose[at] = whose[at + 1] = owner[places]
    grams = np.stack([out[predicted - k] for k in range(ORDER - 1, -1, -1)], axis=1)
    return grams, whose[predicted]


def lookup(keys: np.ndarray, values: np.ndarray, hashes: np.ndarray, absent: float) -> np.ndarray:
    """Rows of values at the hashes in the sorted keys; absent where there is none."""
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[at] == hashes)[:, None], values[at], np.float32(absent))


@dataclass
class Model:
    """Tables per order: sorted hashes of grams with their discounted shares, and sorted hashes of
    histories with the weight of the next lower order; one column per language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    histories: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    alphabet: int = 1
    limits: np.ndarray | None = None  # highest accepted cross-entropy per language and size class
    sharpness: float = 1.0

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: the negative log-likelihood by each language, and the number of symbols."""
        grams, whose = symbol_grams(words)
        total, count = np.zeros((len(words), len(self.languages))), np.bincount(whose, minlength=len(words)).astype(np.int64)
        for i in range(0, len(grams), 1 << 18):
            part = grams[i : i + (1 << 18)]
            p = np.full((len(part), len(self.languages)), 1 / self.alphabet, np.float32)
            for k in range(1, ORDER + 1):
                share = lookup(*self.grams[k - 1], hashed(part[:, ORDER - k :]), 0.0)
                weight = lookup(*self.histories[k - 1], hashed(part[:, ORDER - k : -1]), 1.0)
                p = share + weight * p
            cost = -np.log(p)
            for j in range(len(self.languages)):
                total[:, j] += np.bincount(whose[i : i + (1 << 18)], cost[:, j], minlength=len(words))
        return total, count


def fit(counts: pd.DataFrame, discount_floor: float = 0.1) -> Model:
    """A model from (lang, gram, n): how often each run of ORDER symbols occurs per language.

    The highest order has the counts, lower ones the number of different symbols seen before a gram;
    each order's discount is n1 / (n1 + 2 n2) of its own counts.
    """
    languages = sorted(counts["lang"].unique())
    parts: list[list[tuple]] = [[] for _ in range(ORDER)]
    alphabet: set[int] = set()
    for j, lang in enumerate(languages):
        rows = counts[counts["lang"] == lang]
        grams = np.frombuffer("".join(rows["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, ORDER)
        n = rows["n"].to_numpy(np.float64)
        alphabet |= set(np.unique(grams[:, -1]).tolist())
        for k in range(ORDER, 0, -1):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(discount_floor, n1 / (n1 + 2 * n2) if n1 else discount_floor))
            history, of = np.unique(hashed(grams[:, :-1]), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            parts[k - 1].append((j, hashed(grams), np.maximum(n - d, 0) / total[of], history, d * kinds / total))
            if k > 1:
                shorter, where = np.unique(grams[:, 1:], axis=0, return_inverse=True)
                n = np.bincount(where.ravel()).astype(np.float64)
                grams = shorter
    model = Model(languages, alphabet=len(alphabet) + 1)
    for order in parts:
        for into, key, value, absent in ((model.grams, 1, 2, 0.0), (model.histories, 3, 4, 1.0)):
            keys = np.unique(np.concatenate([x[key] for x in order]))
            values = np.full((len(keys), len(languages)), absent, np.float32)
            for x in order:
                values[np.searchsorted(keys, x[key]), x[0]] = x[value]
            into.append((keys, values))
    return model


class Scorer:
    """Sums of word costs; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.cost = np.empty((0, len(self.model.languages)))
        self.count = np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol and language, symbols) of each whole text."""
        words = [t.lower().split() if t else [] for t in texts]
        if len(self.place) > REMEMBERED:
            self.reset()
        new = list(set().union(*words).difference(self.place))
        if new:
            cost, count = self.model.costs(new)
            self.place.update(zip(new, range(len(self.count), len(self.count) + len(new))))
            self.cost, self.count = np.concatenate([self.cost, cost]), np.concatenate([self.count, count])
        total, n = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for i, w in enumerate(words):
            if w:
                at = np.fromiter(map(self.place.__getitem__, w), np.int64, len(w))
                total[i], n[i] = self.cost[at].sum(axis=0), self.count[at].sum()
        return total / np.maximum(n, 1)[:, None], n


#: Symbols at which the size classes of the rejection limits begin.
SIZE_CLASSES = (0, 40, 160, 640)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(SIZE_CLASSES, n, side="right") - 1


def posteriors(entropy: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    logits = -entropy * np.minimum(n, EVIDENCE)[:, None] * sharpness
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(model: Model, texts: list[str], languages: list[str], accepted: float = 0.999, margin: float = 0.8) -> None:
    """Set the rejection limits and the score's sharpness on documents that the model hasn't seen.

    A limit is the accepted quantile of the cross-entropies that documents of the language have in
    their size class, plus a margin in nats; with fewer than 50 such documents it is the highest of the
    language's cross-entropies plus two margins, and there is none if there are no documents. The sharpness gives the true languages the highest likelihood.
    """
    entropy, n = Scorer(model)(texts)
    truth = np.array([model.languages.index(x) for x in languages], np.int64)
    use = n > 0
    entropy, n, truth = entropy[use], n[use], truth[use]
    model.limits = np.full((len(model.languages), len(SIZE_CLASSES)), np.inf)
    if not len(n):
        return
    own, classes = entropy[np.arange(len(n)), truth], size_class(n)
    for j in range(len(model.languages)):
        for c in range(len(SIZE_CLASSES)):
            part = own[(truth == j) & (classes == c)]
            if len(part) >= 50:
                model.limits[j, c] = np.quantile(part, accepted) + margin
        if (truth == j).any():
            model.limits[j][~np.isfinite(model.limits[j])] = own[truth == j].max() + 2 * margin
    grid = [0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]
    model.sharpness = max(grid, key=lambda s: np.log(np.maximum(posteriors(entropy, n, s)[np.arange(len(n)), truth], 1e-12)).sum())


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About so many rows of each lang at most, chosen by a hash of doc_id."""
    shares = {r.lang: min(1.0, most / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return rows.limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))


def learn(docs: DataFrame, per_language: int = 1500, calibration: int = 400) -> Model | None:
    """Fit on about per_language documents of each lang at most, calibrate on others.

    Only rows with text, lang and a doc_id outside fold 2 are used: folds 0 and 1 for the models, fold
    3 for calibration. Gram counts are summed by Spark; the driver sees those of the bounded sample.
    None if there is nothing to learn from.
    """
    rows = docs.where("doc_id is not null and text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    training = sampled(rows.where(fold(F.col("doc_id")) < 2), per_language)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    grams, _ = symbol_grams([w for t, x in zip(texts, langs) if x == lang for w in t.lower().split()])
                    if len(grams):
                        _, first, n = np.unique(hashed(grams), return_index=True, return_counts=True)
                        names = ["".join(map(chr, g)) for g in grams[first].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(names), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = training.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = fit(counts)
    checks = sampled(rows.where((fold(F.col("doc_id")) == 3) & F.col("lang").isin(model.languages)), calibration).select("text", "lang").collect()
    calibrate(model, [r.text for r in checks], [r.lang for r in checks])
    return model


_scorers: dict[int, Scorer] = {}


def scorer(shared) -> Scorer:
    """The task's scorer of a broadcast model."""
    if shared.value is None:
        raise ValueError("no model")
    key = id(shared.value)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def forget() -> None:
    _scorers.clear()


def predictions(shared, texts: list) -> tuple[list[str], list[float], list[bool]]:
    """(language, score, rejected) of each text."""
    if shared is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    s = scorer(shared)
    entropy, n = s(texts)
    best = entropy.argmin(axis=1)
    rows = np.arange(len(texts))
    score = posteriors(entropy, n, s.model.sharpness)[rows, best]
    rejected = (n == 0) | (entropy[rows, best] > s.model.limits[best, size_class(n)])
    return [s.model.languages[b] if k else UNKNOWN for b, k in zip(best, n)], np.where(n > 0, score, 0.0).tolist(), rejected.tolist()


def identified(docs: DataFrame, model: Model | None, prefix: str = "_") -> DataFrame:
    """docs with lang_pred, score and rejected, each with the prefix before its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None

    def rows(texts: list) -> list[pa.Array]:
        lang, score, rejected = predictions(shared, texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_columns(docs, rows, [(prefix + "lang_pred", "string"), (prefix + "score", "double"), (prefix + "rejected", "boolean")], done=forget)


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document.

    The language is that of the lowest cross-entropy per symbol over the whole text; `und` with score
    0 if the text is null or has no letter. The score is the calibrated probability of the language.
    rejected: `und`, or a cross-entropy above the calibrated limit, as of a language not learnt.

    held_out is null for a row without an id. Repeated rows are returned as often as they come. With
    nothing to learn from, every prediction is `und`. An empty table gives an empty result.
    """
    model = model or learn(docs, **options)
    found = identified(id_and_text(docs), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The documents that identify doesn't reject, with their columns; there is no shuffle.

    Null texts and texts without a letter go. Repeated rows stay or go together, rows without an id are
    judged like any other, and texts of any length are read whole. With nothing to learn from, or in an
    empty table, no row stays. Columns of any name may be in docs.
    """
    p = private(docs)
    return identified(docs, learn(docs, **options), p).where(~F.col(p + "rejected")).select(docs.columns)
