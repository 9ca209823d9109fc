"""Secret scans: Boolean trigram queries derived from the rules choose what the regexes verify."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, id_and_text, private, with_columns

try:  # the parser that re itself uses
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """kind: name in the result. least: characters that the match, or the group, must have at least."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: The base rules, in the order that ties of position are listed in.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),  # runs are maximal, shorter ones would be dropped
)
#: Published forms of further credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (every text may match), or ("and" | "or", frozenset of queries and trigrams).


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    return ("and", frozenset([a, b])) if a != b else a


def either(a, b):
    return True if a is True or b is True else ("or", frozenset([a, b])) if a != b else a


def trigrams_of(literals: set[str]):
    """All trigrams of one of the literals; True if one of them has none."""
    found = None
    for text in sorted(literals):
        query = True
        for i in range(len(text) - 2):
            query = both(query, text[i : i + 3])
        found = query if found is None else either(found, query)
    return True if found is None else found


#: A set of exact strings is followed up to so many; a larger one becomes a query.
EXACT = 64


def derive(pattern: str):
    """The Boolean query over lower-case ASCII trigrams that every matching text satisfies.

    Walking the parsed regex, a run of parts that spell a small set of exact strings is multiplied
    out; when the set grows too large, or a part spells no exact strings, the trigrams of the run so
    far are required and the run begins anew. An alternative requires one of its branches, a
    repetition what its body requires if it occurs at least once.
    """
    query, exact = walk(sre_parse.parse(pattern))
    return both(query, trigrams_of(exact)) if exact else query


def folded(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def walk(parsed) -> tuple[object, set[str] | None]:
    """(query, exact strings); the latter are None when a part isn't spelt out."""
    query: object = True
    run: set[str] = {""}
    whole = True
    for op, value in parsed:
        part_query, part = element(op, value)
        query = both(query, part_query)
        if part is not None and len(run) * len(part) <= EXACT:
            run = {a + b for a in run for b in part}
        else:
            query, whole = both(query, trigrams_of(run)), False
            run = part if part is not None else {""}
    if whole:
        return query, run
    return both(query, trigrams_of(run)), None


def element(op, value) -> tuple[object, set[str] | None]:
    if op is sre.LITERAL:
        char = folded(value)
        return True, {char} if char else None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            codes = [x] if kind is sre.LITERAL else range(x[0], x[1] + 1) if kind is sre.RANGE else None
            if codes is None or len(chars) + len(codes) > EXACT or any(folded(c) is None for c in codes):
                return True, None
            chars |= {folded(c) for c in codes}
        return True, chars if len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return walk(value[-1])
    if op is sre.BRANCH:
        branches = [walk(b) for b in value[1]]
        if all(e is not None and q is True for q, e in branches) and sum(len(e) for _, e in branches) <= EXACT:
            return True, set().union(*(e for _, e in branches))
        found = None
        for q, e in branches:
            q = both(q, trigrams_of(e)) if e else q
            found = q if found is None else either(found, q)
        return found, None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = value
        q, e = walk(body)
        if e is not None and q is True and most <= 1:
            return True, e | {""} if least == 0 else e
        if least == 0:
            return True, None
        return both(q, trigrams_of(e)) if e else q, None
    return True, None


def terms(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(terms(x) for x in query[1]))


def answer(query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """The documents that satisfy the query, by intersecting and uniting sorted postings."""
    if query is True:
        return everything
    if isinstance(query, str):
        return postings.get(query, everything[:0])
    parts = sorted((answer(x, postings, everything) for x in query[1]), key=len)
    out = parts[0]
    for other in parts[1:]:
        out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
    return out


class Scanner:
    """The rules compiled: their regexes, their queries, and a table of the trigrams that those use."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regexes = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [derive(r.pattern) for r in rules]
        self.terms = sorted(set().union(*map(terms, self.queries)))
        self.number = np.zeros(1 << 21, np.min_scalar_type(len(self.terms)))  # of 7-bit trigrams
        for i, t in enumerate(self.terms):
            self.number[ord(t[0]) << 14 | ord(t[1]) << 7 | ord(t[2])] = i + 1

    def index(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Postings of a block: for each trigram of the queries the sorted documents that hold it.

        Trigrams of the lower-cased UTF-8 bytes; those that no query names are never looked up and
        are left out.
        """
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        codes = np.frombuffer(b"".join(raw).lower(), np.uint8).astype(np.uint32)
        if len(codes) < 3 or not self.terms:
            return {}
        grams = codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:]
        ascii_only = (codes[:-2] | codes[1:-1] | codes[2:]) < 128
        numbers = self.number[np.where(ascii_only, grams, 0)]
        places = np.flatnonzero(numbers)
        doc = np.searchsorted(ends, places, side="right")
        inside = places + 2 < ends[doc]  # not across two documents
        keys = np.unique(numbers[places[inside]].astype(np.int64) * len(texts) + doc[inside])
        of, doc = np.divmod(keys, len(texts))
        return {self.terms[k - 1]: doc[of == k] for k in np.unique(of).tolist()}

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, number of the rule, end), sorted; code points, end exclusive."""
        texts = [t or "" for t in texts]
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings, everything = self.index(texts), np.arange(len(texts))
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regexes, self.queries)):
            for d in answer(query, postings, everything).tolist():
                for m in regex.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[d].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets): secrets is an array of (kind, start, end, base), by start, then rule.

    Every block of documents gets an inverted index of the trigrams that the rules' queries name; a
    rule's query is answered by intersecting and uniting postings, and its regex runs over the
    candidates only. A rule without mandatory trigrams runs over every document. A match is leftmost
    and non-overlapping within its rule; one that fails the rule's least length is dropped.

    A null or empty text has no secrets; repeated rows and rows without an id are returned as often
    as they come; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    schema = pa.schema([("doc_id", pa.int64()), ("secrets", kind)])

    def rows(ids: list, texts: list) -> dict:
        found = scanner(rules).spans(texts)
        return {"doc_id": ids, "secrets": [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in spans] for spans in found]}

    return id_and_text(docs).mapInArrow(by_text(schema, rows), "doc_id long, secrets array<struct<kind: string, start: long, end: long, base: boolean>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of scan."""
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text replaced by the mask, and n_chars, if there, counted anew.

    Overlapping secrets are masked as one. Texts without a secret stay as they are, null ones too.
    Every row stays, repeated ones and those without an id too; texts of any length are read whole; an
    empty table gives an empty result. Columns of any name may be in docs.
    """

    def rows(texts: list) -> list[pa.Array]:
        out = []
        for text, spans in zip(texts, scanner(rules).spans(texts)):
            parts, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    parts += [text[at:start], mask]
                at = max(at, end)
            out.append("".join(parts) + text[at:] if spans else text)
        return [pa.array(out, pa.string())]

    p = private(docs)
    clean = with_columns(docs, rows, [(p + "text", "string")])
    new = F.col(p + "text")
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(new.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return clean.withColumns(changed).select(docs.columns)
