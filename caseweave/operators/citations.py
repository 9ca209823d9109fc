"""Citations, their pinpoints, and the records that instructions ask for."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from ..functions import text as T

OCCURRENCES = "array<struct<start:int,end:int,full_start:int,text:string,key:string,form:string,authority:string,style:string,court:string,pinpoints:array<struct<kind:string,first:string,last:string,start:int,end:int>>>>"

STYLE = r"(?:(?P<style>[A-ZÀ-Þ][\w.'’&-]*(?:[ ]+(?:[A-ZÀ-Þ][\w.'’&-]*|of|the|and|de|du|la))*[ ]+(?:v\.?|c\.)[ ]+[A-ZÀ-Þ][\w.'’&-]*(?:[ ]+(?:[A-ZÀ-Þ(][\w.'’&)-]*|of|the|and|de|du|la))*),?[ ]+)?"
NEUTRAL = re.compile(STYLE + r"(?P<cite>(?P<year>(?:1[89]|20)\d\d)[ ]+(?P<court>[A-Z]{2,8})[ ]+(?P<number>\d{1,6}))\b")
REPORTER = re.compile(STYLE + r"(?P<cite>\[(?P<year>(?:1[89]|20)\d\d)\][ ]+(?P<volume>\d+)[ ]+(?P<court>[A-Z](?:\.?[A-Z])*\.?)[ ]+(?P<number>\d+))\b")
STATUTE = re.compile(r"\b(?P<cite>(?P<court>RSC|SC|RSO|SO)[ ]+(?P<year>\d{4}),[ ]+c[ ]+(?P<number>[A-Z]?-?\d+(?:\.\d+)?))\b")
IBID = re.compile(r"\b(?P<cite>[Ii]bid)\b\.?")
PINPOINT = re.compile(r"\G?,?[ ]*(?:\bat[ ]+)?(?P<word>paras?\.?|¶+|pp?\.?|pages?|s\.?|ss\.?|sections?)[ ]+(?P<list>\d+[a-z]?(?:[ ]*[-–][ ]*\d+[a-z]?)?(?:(?:,[ ]*|[ ]+and[ ]+)\d+[a-z]?(?:[ ]*[-–][ ]*\d+[a-z]?)?)*)".replace(r"\G?", ""))
#: Words that introduce a citation and aren't part of a style of cause.
SIGNAL = re.compile(r"^(?:(?:See|Voir|Cf\.?|In|Dans|But|And|Also|Citing)[ ]+)+")
LOCATOR = re.compile(r"(\d+[a-z]?)(?:[ ]*[-–][ ]*(\d+[a-z]?))?")
#: What a text holds that holds a citation: a year before a court or a bracket, a statute's court, an
#: ibid. Java's syntax; the grammar reads no other text.
CITING = r"(?s)(?:1[89]|20)..(?: +[A-Z]{2}|\])|S[CO] |[Ii]bid"
#: A pattern's matches hold one of these.
MARKS = {"neutral": ("18", "19", "20"), "reporter": ("[",), "statute": ("SC ", "SO "), "ibid": ("bid",)}
KIND = {"p": "paragraph", "¶": "paragraph", "s": "section"}


def canonical(match: re.Match, kind: str) -> str:
    court = match["court"].replace(".", "")
    if kind == "neutral":
        return f"{match['year']} {court} {int(match['number'])}"
    if kind == "reporter":
        return f"[{match['year']}] {match['volume']} {court} {match['number']}"
    return f"{court} {match['year']}, c {match['number']}"


def pinpoints_after(text: str, at: int) -> list[dict]:
    """The pinpoints written right after a citation; `p 5` and `page 5` are pages, `para 5` paragraphs."""
    out: list[dict] = []
    while m := PINPOINT.match(text, at):
        word = m["word"].lower()
        kind = "paragraph" if word.startswith("para") or word[0] == "¶" else "page" if word[0] == "p" else "section"
        for part in LOCATOR.finditer(m["list"]):
            start = m.start("list") + part.start()
            out.append({"kind": kind, "first": part[1], "last": part[2], "start": start, "end": m.start("list") + part.end()})
        at = m.end()
    return out


def citations_in(text: str | None) -> list[dict]:
    """Every citation in the order of the text; an ibid takes the key of the citation before it."""
    found = []
    for kind, pattern in (("neutral", NEUTRAL), ("reporter", REPORTER), ("statute", STATUTE), ("ibid", IBID)):
        if not text or not any(mark in text for mark in MARKS[kind]):
            continue
        for m in pattern.finditer(text):
            found.append((m.start("cite"), m.end("cite"), kind, m))
    out: list[dict] = []
    end = 0
    for start, stop, kind, m in sorted(found, key=lambda f: f[:3]):
        if start < end:
            continue
        before = out[-1] if out else None
        lead = SIGNAL.match(m[0]) if m.groupdict().get("style") else None
        skipped = lead.end() if lead else 0
        if kind == "ibid":
            key, authority, style = (before["key"], before["authority"], None) if before else (None, None, None)
        else:
            key, authority, style = canonical(m, kind), "statute" if kind == "statute" else "case", (m.groupdict().get("style") or "")[skipped:] or None
        out.append({
            "start": start, "end": stop, "full_start": m.start() + skipped, "text": text[start:stop], "key": key, "form": "short" if kind == "ibid" else "full",
            "authority": authority, "style": style, "court": m.groupdict().get("court"), "pinpoints": pinpoints_after(text, m.end()),
        })
        end = stop
    return out


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, start, end, full_start, text, key, form, authority, style, court, pinpoints) per citation.

    The grammar knows neutral citations, bracketed reporters, statutes and ibid. Texts that can't hold
    one are left out on the JVM side; the others are read by Arrow batches, and what is found is exploded
    on the JVM side. A text that is null or cites nothing has no row.
    """
    found = to_arrow_type(ArrayType.fromDDL(OCCURRENCES))

    @F.arrow_udf(OCCURRENCES)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([citations_in(text) for text in batch.to_pylist()], found)

    return docs.where(F.col(text).rlike(CITING)).select(key, F.posexplode(run(F.col(text))).alias("seq", "c")).select(key, "seq", "c.*" if key != "key" else "c")


def tails(occurrences: DataFrame, document: str = "doc_id", text: str = "text") -> DataFrame:
    """occurrences with tail_end: the begin of the next one, the next line feed or the text's end,
    whichever comes first."""
    order = Window.partitionBy(document).orderBy("start")
    size = F.length(text)
    feed = F.expr(f"locate('\\n', {text}, `end` + 1)") - 1
    following = F.coalesce(F.lead("full_start").over(order), size)
    return occurrences.withColumn("tail_end", F.least(following, F.when(feed >= 0, feed).otherwise(size)).cast("long"))


def targets_of(pinpoints: Column, item: Column) -> Column:
    """The paragraphs and pages that pinpoints ask for, ranges spelt out; an item only with one target."""
    wanted = F.filter(pinpoints, lambda p: p["kind"].isin("paragraph", "page"))
    values = F.flatten(F.transform(wanted, lambda p: F.transform(T.expand_locator(p["first"], p["last"]), lambda v: F.struct(p["kind"].alias("kind"), v.alias("value")))))
    alone = F.size(values) == 1
    return F.transform(values, lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"), F.when(alone, item).alias("item")))


def records(occurrences: DataFrame, order: str = "seq") -> DataFrame:
    """One record per authority in the order of first mention.

    occurrences: order, key, text, style, targets and others. The first mention wins for name and
    citation; targets are appended in order if they are new. An occurrence without a key is a record
    by itself and isn't enabled.
    """
    full = occurrences.where("form = 'full' and authority = 'case'")
    named = full.select(
        order,
        T.first_filled(F.col("key"), F.concat(F.lit("unresolved:"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))).alias("id"),
        F.col("text").alias("citation"),
        T.first_filled(F.col("style"), F.col("text")).alias("name"),
        F.col("key").isNotNull().alias("enabled"),
        "targets",
    )
    grouped = named.groupBy("id").agg(
        F.min(order).alias("seq"), F.min_by("citation", order).alias("citation"), F.min_by("name", order).alias("name"), F.min_by("enabled", order).alias("enabled"),
        F.count("*").alias("mentions"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "targets"))).alias("t"),
    )
    return grouped.withColumn("targets", F.array_distinct(F.flatten(F.col("t.targets")))).drop("t")


def parse_instructions(pastes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of pasted instructions: extract, take each citation's tail, expand, group.

    A paste of over MAX_PASTE UTF-16 units is an error, as is a reversed or too long range.
    """
    checked = pastes.withColumn(text, F.when(T.utf16_length(F.col(text)) > T.MAX_PASTE, F.raise_error(F.lit("the text is too long"))).otherwise(F.col(text)))
    found = extract(checked, key, text)
    order = F.struct(F.col(key), F.col("seq"))
    return records(found.withColumn("targets", targets_of(F.col("pinpoints"), F.lit(None).cast("string"))).withColumn("order", order), "order")


def caption_style(text: str | None, key: str) -> str | None:
    """The style of cause that a decision prints on the line of its own citation, else null."""
    for line in (text or "").split("\n"):
        for c in citations_in(line):
            if c["key"] == key and c["style"]:
                return re.sub(r"^(?:Citation|Référence)\s*:\s*", "", c["style"]).strip() or None
    return None


#: Where the decisions of some courts are; any table of court and place may be given instead.
COURTS = {"SCC": "ca/scc", "FCA": "ca/fca", "FC": "ca/fct", "ONCA": "on/onca", "BCCA": "bc/bcca", "BCSC": "bc/bcsc", "ABCA": "ab/abca", "QCCA": "qc/qcca"}


def case_address(key: Column, language: str = "en", courts: Mapping[str, str] = COURTS) -> Column:
    """The page of a case by its neutral citation, null for other keys and for courts that aren't known."""
    form = "^(\\d{4}) ([A-Z]+) (\\d+)$"
    slug = F.lower(F.regexp_replace(key, form + "\\R?", "$1$2$3"))
    place = F.element_at(F.create_map(*[F.lit(x) for pair in courts.items() for x in pair]), F.split_part(key, F.lit(" "), F.lit(2)))
    return F.when(key.rlike(form), F.concat(F.lit(f"https://www.canlii.org/{language}/"), place, F.lit("/doc/"), F.substring(key, 1, 4), F.lit("/"), slug, F.lit("/"), slug, F.lit(".html")))


def statute_address(key: Column, language: str = "en") -> Column:
    part = lambda i: F.regexp_extract(key, "^(RSC|SC) (\\d{4}), c ([A-Z]?-?\\d+(?:\\.\\d+)?)$", i)
    slug = F.lower(F.concat_ws("-", part(1), part(2), F.lit("c"), part(3)))
    return F.when(part(1) != "", F.concat(F.lit(f"https://www.canlii.org/{language}/ca/laws/stat/"), slug, F.lit("/latest/"), slug, F.lit(".html")))


def address(key: Column, language: str = "en", courts: Mapping[str, str] = COURTS) -> Column:
    return F.coalesce(case_address(key, language, courts), statute_address(key, language))


def anchor(kind: Column, first: Column) -> Column:
    return F.when(kind == "paragraph", F.concat(F.lit("#par"), first)).when(kind == "section", F.concat(F.lit("#sec"), first)).otherwise(F.lit(""))
