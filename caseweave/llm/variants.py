"""Spelling variants: words one edit apart, by a symmetric-delete join, and the form each belongs to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, release, slices

#: A word has so many code points and occurrences; a form has so many times its variant's.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: A run loses a code point where its hash divides by this.
DROP_EVERY = 31
#: Longer words travel as their digest, since their deletions together grow with the square of the length.
CARRIED = 64
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Latin-1 bytes: letters lower-cased in A-Z only, everything else a space.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of [A-Za-z\\u00C0-\\u00FF], lower-cased in A-Z only, as Latin-1 bytes."""
    return text.encode("latin-1", "replace").translate(RUNS).split()


def with_drops(key: bytes, counts: dict[bytes, int], least: int = LEAST_LENGTH) -> Iterator[tuple[bytes, int]]:
    """The words that a document's runs give, with their counts: by the CRC-32 of `key:run` a run may
    lose one code point. key is the document's id as text."""
    start = zlib.crc32(key + b":")
    for run, n in counts.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all documents. Null texts have no words; a null id is the empty text. Each task hands
    on one row per word it has met, so that a common word isn't shuffled once per occurrence."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if text:
                        for word, n in with_drops(b"" if key is None else b"%d" % key, Counter(runs(text)), least):
                            held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)
        held.clear()
        release()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletions(word: Column) -> Column:
    """64-bit hashes of a word and of its distinct single deletions."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), cut))


def near_pairs(words: DataFrame, carried: int = CARRIED) -> DataFrame:
    """(a, na, b, nb), a < b by id: the pairs of words exactly one insertion, deletion or replacement apart.

    words: word, n, each word once. Every word emits itself and its distinct single deletions; words
    that share one meet by an equi-join, and what meets is verified, so a clash of hashes adds nothing.
    All words of a key are it with one code point more, or it, so a group is bounded by the length
    times the alphabet, whatever the corpus. Words of over `carried` code points meet by their digest
    and get their text back before they are verified.
    """
    size = F.char_length("word")
    named = words.select("word", "n", F.when(size <= carried, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256))).alias("id"))
    long_words = materialise(named.where(size > carried).select("id", "word"), "long-words")
    keys = named.select("id", "n", F.explode(deletions(F.col("word"))).alias("key"))
    left = keys.select("key", F.col("id").alias("a"), F.col("n").alias("na"))
    right = keys.select("key", F.col("id").alias("b"), F.col("n").alias("nb"))

    def one_apart(x: Column, y: Column) -> Column:
        return F.levenshtein(x, y, 1) == 1

    digest = F.col("a").startswith("#") | F.col("b").startswith("#")
    met = left.join(right, "key").where("a < b").where(digest | one_apart(F.col("a"), F.col("b")))
    pairs = met.select("a", "na", "b", "nb").distinct()
    for side in ("a", "b"):
        text = long_words.select(F.col("id").alias(side), F.col("word").alias(f"_{side}"))
        pairs = pairs.join(text, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return pairs.where(one_apart(F.col("_a"), F.col("_b"))).select(F.col("_a").alias("a"), "na", F.col("_b").alias("b"), "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last. A form is more frequent than its
    word, so chains end; pointers are doubled, which takes the logarithm of the longest chain's steps."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(found.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return found


def group_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least 7 code points and 2 occurrences.

    form is the near word of the largest n, ties to the smallest in code-point order, where that is at
    least `times` the word's own n; root is the last form of the chain, the word itself without one.
    An empty table gives no words.
    """
    words = materialise(word_counts(docs).where(F.col("n") >= LEAST_COUNT), "words")
    pairs = materialise(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    large = -F.col("best.order") >= times * F.col("n")
    shown = {"form": F.when(large, F.col("best.near")), "form_n": F.when(large, -F.col("best.order")), "n_near": F.coalesce("n_near", F.lit(0).cast("long"))}
    formed = materialise(words.join(best, "word", "left").withColumns(shown).drop("best"), "forms")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
