"""Text columns. Offsets and lengths are code points; utf16_length converts at a boundary."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A range of pinpoints may span this much; a paste may have this many UTF-16 units.
MAX_SPAN, MAX_PASTE = 500, 150_000


def tidy(text: Column) -> Column:
    """Runs of ASCII white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\t\\n\\f\\r ]+", " "))


#: What counts as white space.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Characters that NFKC leaves alone wherever they stand: ASCII, Latin letters, common punctuation.
STABLE = "\\x00-\\x7f\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u2013\u2014\u2018-\u201e\u2022"


#: What parts the pieces that nfkc hands to Python; no form of another character holds it.
PARTED = "\x1f"


def nfkc(text: Column) -> Column:
    """NFKC, runs of white space (SPACES) as one space, none at the ends; null stays null.

    Texts of STABLE characters are in NFKC already and stay in the JVM. Of the others Python is handed
    the pieces of other characters only, each with the one before it, with which it may be composed: no
    STABLE character is composed with one before it. So what Python holds of a batch doesn't grow with
    the stable part of its texts. A text that holds PARTED itself is one piece.
    """

    @F.pandas_udf("string")
    def compatible(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    run = f"[{STABLE}]+(?=[{STABLE}])"  # all but the last of a run of stable characters
    whole = text.contains(PARTED)
    pieces = F.when(text.rlike(f"[^{STABLE}]"), F.when(whole, text).otherwise(F.regexp_replace(text, run, PARTED)))
    composed = compatible(pieces)
    runs = F.concat(F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(composed, PARTED, -1), runs, lambda a, b: F.concat(a, b)), "")
    found = F.when(composed.isNull(), text).when(whole, composed).otherwise(joined)
    return F.trim(F.regexp_replace(found, f"[{SPACES}]+", " "))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_prefix(text: Column, most: int) -> Column:
    """The first so many UTF-16 units; a character that would be cut in two is left out."""
    head = F.substring(text, 1, most)  # as many units at least
    units = F.encode(head, "UTF-16BE")
    split = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.when(split, F.substring(units, 1, 2 * most - 2)).otherwise(F.substring(units, 1, 2 * most))
    return F.when(utf16_length(head) <= most, head).otherwise(F.decode(cut, "UTF-16BE"))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def useful_characters(text: Column) -> Column:
    """Letters and digits of any script."""
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", "")).cast("long")


def round_half_up(value: Column) -> Column:
    """To the next integer, halves upwards, negative ones too."""
    return F.floor(value + 0.5)


def indent(x: Column, margin: Column) -> Column:
    """Between 0 and 12 spaces for how far right of the margin a line begins."""
    return F.greatest(F.lit(0), F.least(F.lit(12), round_half_up((x - margin) * 60))).cast("long")


def expand_locator(first: Column, last: Column) -> Column:
    """All values of a numeric range as strings; one value as it is; an error for a reversed range or
    one over MAX_SPAN; none for what is neither."""
    a, b = first.try_cast("long"), F.coalesce(last, first).try_cast("long")
    numbers = F.when((b < a) | (b - a > MAX_SPAN), F.raise_error(F.concat(F.lit("range "), first, F.lit("-"), last))).otherwise(
        F.transform(F.sequence(a, F.when(b >= a, b).otherwise(a)), lambda n: n.cast("string"))
    )
    single = F.when(F.coalesce(last, first) == first, F.array(first)).otherwise(F.array().cast("array<string>"))
    return F.when(a.isNotNull() & b.isNotNull(), numbers).otherwise(single)


def target_label(kind: Column, value: Column, item: Column) -> Column:
    name = F.when(kind == "page", F.lit("Page ")).otherwise(F.lit("Para "))
    return F.concat(name, value, F.when(item.isNotNull(), F.concat(F.lit(" · item "), item)).otherwise(F.lit("")))


def item_of(text: Column) -> Column:
    """What stands after `item` in an instruction, lower-cased; null if nothing does."""
    return F.nullif(F.lower(F.regexp_extract(text, "(?i)\\bitem\\s+(\\d+[a-z]?)\\b", 1)), F.lit(""))


def running_key(text: Column) -> Column:
    """What a line is compared by across pages: null for a numbered one, one key for page numbers,
    else its normalised text."""
    line = nfkc(text)
    return F.when(numbered(line), F.lit(None)).when(line.rlike("^(?i)(page )?[-–—]? ?\\d+ ?[-–—]?$"), F.lit("#page-number")).otherwise(line)


def numbered(line: Column) -> Column:
    """Whether a line begins with a paragraph's number."""
    return line.rlike(f"^[{SPACES}]*(\\[\\d+\\]|\\d+[.)])[{SPACES}]+")


def error_distance(gold: Column, read: Column) -> Column:
    return F.levenshtein(gold, read).cast("long")


def recognition_accepted(gold: Column, read: Column, percent: int = 12) -> Column:
    """Whether the character error rate is under the limit."""
    return (F.length(gold) > 0) & (error_distance(gold, read) * 100 < percent * F.length(gold))


def file_name(name: Column) -> Column:
    """A name without the characters that file systems refuse, ending in .pdf."""
    clean = tidy(F.regexp_replace(name, "[\\\\/:*?\"<>|\\x00-\\x1f]+", " "))
    return F.concat(F.trim(F.regexp_replace(clean, "(?i)\\.pdf$", "")), F.lit(".pdf"))


def utf16_order(text: Column) -> Column:
    """A key that sorts strings by their UTF-16 units; Spark's own order is that of code points."""
    return F.encode(text, "UTF-16BE")
