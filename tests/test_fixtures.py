"""Semantics that the tables lack, on literal rows."""

import io
import random
import sqlite3
import time
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from caseweave.functions import geometry, text, web
from caseweave.operators import citations, folds, layout, links, matching, resolve, stateful, structure
from caseweave.sources import files, linked, scratch, sinks
from caseweave.streaming import state, watch

DECISION = "https://www.canlii.org/en/ca/scc/doc/2018/2018scc31/2018scc31.html"


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x long"
    return spark.createDataFrame([tuple(values.values()) or (0,)], names).select(column.alias("v")).first().v


def test_captions():
    page = "SUPREME COURT OF CANADA\nCitation: R. v. Latimer, 2001 SCC 1, [2001] 1 S.C.R. 3\nmore"
    assert citations.caption_style(page, "2001 SCC 1") == "R. v. Latimer"
    assert citations.caption_style(page, "2002 SCC 1") is None
    assert citations.caption_style("see 2001 SCC 1", "2001 SCC 1") is None
    assert citations.caption_style(None, "2001 SCC 1") is None


def test_grammar():
    found = citations.citations_in("See R v Smith, 2018 SCC 31 at paras 41-43, 46; RSC 1985, c C-46, s 8. Ibid at para 2. [2022] 3 SCR 999 at 1001")
    assert [(c["key"], c["form"], c["authority"]) for c in found] == [("2018 SCC 31", "full", "case"), ("RSC 1985, c C-46", "full", "statute"), ("RSC 1985, c C-46", "short", "statute"), ("[2022] 3 SCR 999", "full", "case")]
    assert found[0]["style"] == "R v Smith"
    assert [(p["kind"], p["first"], p["last"]) for p in found[0]["pinpoints"]] == [("paragraph", "41", "43"), ("paragraph", "46", None)]
    assert [(p["kind"], p["first"]) for p in found[1]["pinpoints"]] == [("section", "8")]
    assert citations.citations_in(None) == [] == citations.citations_in("nothing, 12 of 3")


def test_records(spark):
    pastes = spark.createDataFrame([(1, "R v Lee, 2011 SCC 58 at para 83"), (2, "2011 SCC 58 at paras 82-84, p 3"), (3, "2012 SCC 1"), (4, None)], "doc_id long, text string")
    found = {r.id: r for r in citations.parse_instructions(pastes).collect()}
    assert set(found) == {"2011 SCC 58", "2012 SCC 1"}
    first = found["2011 SCC 58"]
    assert (first.name, first.mentions, first.enabled) == ("R v Lee", 2, True)
    assert [(t.kind, t.value) for t in first.targets] == [("paragraph", "83"), ("paragraph", "82"), ("paragraph", "84"), ("page", "3")]
    assert found["2012 SCC 1"].targets == []


def test_bad_ranges_and_pastes_fail(spark):
    for bad in ("2011 SCC 58 at paras 84-82", "2011 SCC 58 at paras 1-900", "x" * 150_001):
        with pytest.raises(Exception, match="range|too long"):
            citations.parse_instructions(spark.createDataFrame([(1, bad)], "doc_id long, text string")).collect()


def test_links(spark):
    units = spark.createDataFrame([("f1", "footnote", "R v Smith, 2018 SCC 31 at para 41, RSC 1985, c C-46, s 8"), ("f2", "footnote", "2018 SCC 31. Ibid at para 46."), ("b", "body", "2018 SCC 31")], "unit_id string, kind string, text string")
    found = citations.extract(units, "unit_id")
    rows = links.planned(units, found).collect()
    urls = {(r.unit_id, r.expected, r.url) for r in rows}
    statute = "https://www.canlii.org/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html"
    assert ("f1", "2018 SCC 31", DECISION) in urls and ("f1", "41", DECISION + "#par41") in urls
    assert ("f1", "8", statute + "#sec8") in urls
    assert ("f2", "46", DECISION + "#par46") in urls
    assert not any(r.unit_id == "b" for r in rows)
    ranged = spark.createDataFrame([("x", "footnote", "2018 SCC 31 at paras 30–32")], "unit_id string, kind string, text string")
    of = lambda **k: sorted((r.expected, r.url.rpartition("#")[2]) for r in links.planned(ranged, citations.extract(ranged, "unit_id"), **k).collect() if "#" in r.url)
    assert of() == [("30", "par30"), ("32", "par32")]
    assert of(whole_pinpoint=True) == [("30–32", "par30")]


def test_a_rejected_span_blocks_nothing(spark):
    spans = spark.createDataFrame([("u", 1, 0, 10), ("u", 2, 5, 20), ("u", 3, 15, 25), ("u", 4, 10, 15)], "unit string, seq long, start long, end long")
    assert sorted(r.seq for r in links.without_overlaps(spans, "unit").collect()) == [1, 3, 4]


def test_stretches_like_one_fold(spark):
    """Spans of one key in any order, with empty ones, touching ones and one over all, against a plain loop."""
    rows = [("u", i, i * 7919 % 300, i * 7919 % 300 + i % 23) for i in range(120)] + [("v", 7, 0, 1000), ("v", 1, 5, 6), ("v", 2, 6, 9), ("v", 3, 8, 12), ("w", 1, None, 5), ("w", 2, 1, 4)]
    spans = spark.createDataFrame(rows, "unit string, seq long, start long, end long")
    kept = []
    for u, q, s, e in sorted(rows, key=lambda r: r[:2]):
        if s is None or not any(k[0] == u and k[2] is not None and s < k[3] and k[2] < e for k in kept):
            kept.append((u, q, s, e))
    assert sorted(map(tuple, links.without_overlaps(spans, "unit").collect()), key=str) == sorted(kept, key=str)


def test_many_links_of_one_citation(spark):
    text_ = "2018 SCC 31 at paras " + ", ".join(str(n) for n in range(1, 1205)) + "; 2019 SCC 7 at para 3"
    units = spark.createDataFrame([("x", "footnote", text_)], "unit_id string, kind string, text string")
    found = links.planned(units, citations.extract(units, "unit_id")).collect()
    assert len(found) == len({(r.seq, r.n) for r in found}) == 1204 + 3 and sum(r.seq == 1 for r in found) == 2


def test_planned_links_read_each_text_once(spark):
    """Once for the citations and once for the words at their places, also where links overlap."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, "footnote", f"2018 SCC {i} at paras {i}-{i + 2}") for i in range(1, 51)] + [(0, "footnote", "2018 SCC 31, 2018 XXX 5")]
    units = spark.createDataFrame(rows, "unit_id long, kind string, text string").mapInArrow(counted, "unit_id long, kind string, text string")
    found = citations.extract(units, "unit_id")
    again = found.where("unit_id = 1").withColumn("seq", F.lit(7)).withColumn("start", F.col("start") + 2)
    got = links.planned(units, found.unionByName(again)).collect()
    assert read.value <= 3 * len(rows)
    assert len(got) == 50 * 3 + 1 and {(r.seq, r.n) for r in got if r.unit_id == 1} == {(0, 0), (0, 1), (0, 2)}
    assert [r.url for r in got if r.unit_id == 0] == [DECISION]  # a court without an address has no link


def test_leaders_like_one_fold(spark):
    at = [0, 10, 59, 60, 61, 119, 121, 300, 300, 359, 361, 500]
    rows = [("k", i, t) for i, t in enumerate(at)] + [("l", 50, 5), ("k", 60, None)]
    requests = spark.createDataFrame(rows, "key string, request_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {r.request_id: r.leader for r in stateful.shared_requests(requests, ["key"], "ts", 60).collect()}
    leader, since = None, None
    for i, t in enumerate(at):
        if since is None or t - since >= 60:
            leader, since = i, t
        assert found[i] == leader
    assert (found[50], found[60]) == (50, 60)


def test_rectangles_one_row_after_the_other(spark):
    rows = [("m", i, (i % 4) * 0.25, float(i // 4), (i % 4) * 0.25 + (0.25 if i % 4 < 2 else 0.1), i // 4 + 0.5) for i in range(40)]
    found = layout.merge_rects(spark.createDataFrame(rows, "mark string, seq long, x0 double, y0 double, x1 double, y1 double"), ["mark"]).orderBy("rect_no").collect()
    assert [(r.x0, r.x1, r.y0) for r in found] == [x for line in range(10) for x in ((0.0, 0.6, float(line)), (0.75, 0.85, float(line)))]


def test_excerpts_count_units(spark):
    assert one(spark, structure.excerpt(F.col("t"), 4), t="\n\u00a0 ab😀cd \ufeff") == "ab😀"
    assert one(spark, structure.excerpt(F.col("t"), 3), t="ab😀cd") == "ab"
    assert one(spark, structure.excerpt(F.col("t"), 3), t="😀") == "😀"
    assert one(spark, citations.case_address(F.col("t"), "fr", {"CMAC": "ca/cmac"}), t="2019 CMAC 2").endswith("/fr/ca/cmac/doc/2019/2019cmac2/2019cmac2.html")


def test_text_functions(spark):
    assert one(spark, text.utf16_length(F.col("t")), t="a😀b") == 4
    assert one(spark, text.round_half_up(F.col("t")), t=-2.5) == -2
    assert one(spark, text.nfkc(F.col("t")), t=" ﬁ ﻿ x ") == "fi x"
    assert one(spark, text.first_filled(F.col("a"), F.col("b")), a="", b="c") == "c"
    assert one(spark, text.item_of(F.col("t")), t="at Item 3B of") == "3b"
    assert one(spark, text.item_of(F.col("t")), t="none") is None
    assert one(spark, text.running_key(F.col("t")), t="- 12 -") == "#page-number"
    assert one(spark, text.running_key(F.col("t")), t="[12] words") is None
    assert one(spark, text.expand_locator(F.col("a"), F.col("b")), a="12a", b=None) == ["12a"]
    assert one(spark, text.target_label(F.col("k"), F.col("v"), F.col("i")), k="paragraph", v="3", i="b") == "Para 3 · item b"
    assert one(spark, text.file_name(F.col("t")), t='a/b: "c".PDF') == "a b c.pdf"


def test_geometry(spark):
    assert one(spark, geometry.rgb_to_hex(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)))) == "#ff8000"
    assert one(spark, geometry.hex_to_rgb(F.lit("#ff0033"))) == [1.0, 0.0, 0.2]
    args = [F.lit(float(v)) for v in (10, 0, 0, 10, 100, 200, 50, 500, 1000)]
    assert [round(v, 4) for v in one(spark, geometry.glyph_rect(*args))] == [0.2, 0.79, 0.3, 0.8]
    assert one(spark, geometry.raster_scale(F.lit(10000.0), F.lit(10000.0))) < 0.35


def test_web(spark):
    assert one(spark, web.admitted(F.col("u"), ["x.test"]), u="http://x.test/a?b#c") == "https://x.test/a"
    for bad in ("http://y.test/a", "https://u@x.test/", "https://x.test:8/", "https://x.test/%20", "ftp://x.test"):
        assert one(spark, web.admitted(F.col("u"), ["x.test"]), u=bad) is None
    assert one(spark, web.resolved_path(F.col("p")), p="/a/./b/../../../c") == "/c"
    assert one(spark, web.origin(F.col("u")), u="HTTPS://X.test:443/a") == "https://x.test"
    assert one(spark, web.ip_number(F.col("a")), a="1.2.3.256") is None
    assert one(spark, web.ip_number(F.col("a")), a="1.2.3.4") == 16909060
    assert one(spark, web.ip_key(F.col("a")), a="::1") == "6:" + "0" * 31 + "1"
    assert one(spark, web.ip_key(F.col("a")), a="1.2.3.4") == "4:01020304"
    assert one(spark, web.credential_fits(F.col("a")), a="x\ny") is False
    pdf = spark.createDataFrame([(b"%PDF-1.7 ... %%EOF\n",), (b"%PDF-1.7",), (b"<html>%%EOF",)], "c binary")
    assert [r.v for r in pdf.select(web.is_pdf(F.col("c")).alias("v")).collect()] == [True, False, False]


def item(no, text_, x0, x1, baseline=0.5, eol=False):
    return (1, 1, no, text_, x0, 0.4, x1, 0.5, baseline, 0.1, eol, 1.0)


def test_line_assembly(spark):
    rows = [item(0, "Hello", 0.1, 0.2), item(1, "world", 0.22, 0.3), item(2, "!", 0.3, 0.31, eol=True), item(3, "next", 0.1, 0.2), item(4, "low", 0.25, 0.3, baseline=0.56), item(5, " ", 0.4, 0.5, eol=True), item(6, "far", 0.9, 0.95)]
    found = layout.assemble_lines(spark.createDataFrame(rows, "doc_id long, page long, item_no long, text string, x0 double, y0 double, x1 double, y1 double, baseline double, height double, has_eol boolean, width double")).orderBy("line_no").collect()
    assert [r.text for r in found] == ["Hello world!", "next", "low", "far"]


def test_cache_replay(spark):
    log = [("a", "x", "write", 5, 1), ("a", "y", "write", 5, 2), ("a", "x", "read", 0, 3), ("a", "z", "write", 3, 4), ("a", "z", "write", 1, 5), ("b", "big", "write", 99, 1)]
    rows = spark.createDataFrame(log, "cache string, key string, op string, size long, seq long")
    of = lambda **k: sorted((r.cache, r.key) for r in stateful.replayed_cache(rows, "cache", 10, **k).collect())
    assert of(reads_count=True) == [("a", "x"), ("a", "z")]
    assert of(reads_count=False) == [("a", "y"), ("a", "z")]


def test_oversized_entries_evict_nothing(spark):
    log = [("a", "x", "write", 5, 1), ("a", "y", "write", 5, 2), ("a", "y", "write", 99, 3)]
    rows = spark.createDataFrame(log, "cache string, key string, op string, size long, seq long")
    of = lambda how: sorted(r.key for r in stateful.replayed_cache(rows, "cache", 10, reads_count=True, oversized=how).collect())
    assert of("drop") == ["x"] and of("ignore") == ["x", "y"]
    newest = spark.createDataFrame([("a", 5, 1), ("b", 99, 2), ("c", 5, 0)], "key string, size long, used long")
    assert sorted(r.key for r in stateful.kept_within(newest, 10, [F.desc("used")]).collect()) == ["a", "c"]


def test_equal_names_pair_without_a_fold(spark):
    f = spark.createDataFrame([("g", 1, "a", 5), ("g", 2, "a", 9), ("g", 3, "b", 1), ("h", 4, "a", 1)], "g string, file_id long, name string, mtime long")
    r = spark.createDataFrame([("g", 10, 2, "a"), ("g", 11, 1, "a"), ("g", 12, 3, "a"), ("h", 13, 1, "b")], "g string, record_id long, seq long, name string")
    found = matching.greedy_assignment(f, r, "g")
    assert sorted(tuple(x) for x in found.collect()) == [("g", 1, 10), ("g", 2, 11)]
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_greedy_assignment(spark):
    f = spark.createDataFrame([("g", 1, "a", 10), ("g", 2, "a", 20), ("g", 3, "b", 5), ("h", 4, "a", 1)], "g string, file_id long, name string, mtime long")
    r = spark.createDataFrame([("g", 7, 1, "a"), ("g", 8, 2, "b")], "g string, record_id long, seq long, name string")
    found = matching.greedy_assignment(f, r, "g", lambda a, b: a == b).collect()
    assert sorted((x.file_id, x.record_id) for x in found) == [(2, 7), (3, 8)]


def test_a_pass_sees_a_key_once(spark):
    """Rows that are a union of joins on the key: adaptive execution makes broadcasts of them."""
    few = spark.range(7).select(F.col("id").alias("k"))
    part = lambda kind: spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.lit(kind).alias("kind")).join(few, "k", "left_semi")
    out = StructType([StructField("k", LongType()), StructField("n", LongType())])
    for threshold in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
        try:
            rows = part("a").unionByName(part("b"))
            found = folds.sorted_pass(rows, ["k"], ["v", "kind"], out, lambda: [0], lambda n, _: n.__setitem__(0, n[0] + 1) or (), lambda n: [(n[0],)]).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        assert sorted(r.k for r in found) == list(range(7)) and sum(r.n for r in found) == 4000


def test_citing_texts_are_all_read(spark):
    """What the JVM leaves out holds no citation, and what a pattern's marks leave out holds no match."""
    rng = random.Random(5)
    bits = ["2001", "1999", "20\u0661\u0662", "18\U0001d7ce\U0001d7cf", "[", "]", " ", "  ", "\n", "SCC", "S.C.R.", "RSC", "SO", "SC", "1985", ",", "c", "C-46", "12", "Ibid", "ibid.", "R. v. Oakes", "at paras 3-5", "x", "3"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(4000)] + [None, "", "SC 1985, c C-46", "[2001] 1 S.C.R. 3", "2001  SCC  1"]

    def plain(t):
        kinds = (("neutral", citations.NEUTRAL), ("reporter", citations.REPORTER), ("statute", citations.STATUTE), ("ibid", citations.IBID))
        return sorted((m.start("cite"), m.end("cite")) for _, p in kinds for m in p.finditer(t or ""))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in citations.extract(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {i for i, t in enumerate(texts) if plain(t)} == set(found)
    assert all(set(spans) <= set(plain(texts[i])) for i, spans in found.items())
    assert len(found) > 200


def in_turn(files, records, matches):
    """The plain fold: files from the newest, each takes the first record left that matches."""
    left, out = sorted(records, key=lambda r: (r[0], r[2] is not None, r[2] or 0, r[1])), []
    for g, file_id, name, _ in sorted(files, key=lambda f: (f[3] is None, -(f[3] or 0), f[1])):
        hit = next((r for r in left if None not in (g, name, r[3]) and r[0] == g and matches(name, r[3])), None)
        if hit:
            left.remove(hit)
            out.append((g, file_id, hit[1]))
    return sorted(out)


@pytest.mark.parametrize("seed,groups,words,target", [(0, 1, 3, 20_000), (1, 3, 5, 25)])
def test_greedy_assignment_in_stretches(spark, seed, groups, words, target):
    """Names of one or two words in few groups, so that kinds contend; times and places tie."""
    rng = random.Random(seed)
    name = lambda: " ".join(rng.choice([f"w{i}" for i in range(words)]) for _ in range(rng.choice([1, 2])))
    group = lambda: f"g{rng.randrange(groups)}"
    files = [(group(), i, name(), rng.choice([None, *range(9)])) for i in range(120)] + [(None, 900, "w0", 3), ("g0", 901, None, 3), ("g0", 902, "", 3)]
    records = [(group(), i, rng.choice([None, *range(9)]), name()) for i in range(100)] + [(None, 900, 1, "w0"), ("g0", 901, 1, None), ("g0", 902, 0, "")]
    share = lambda a, b: a == b or bool(set(a.split()) & set(b.split()))
    records = sorted(records, key=lambda r: str(r[0]))
    f = spark.createDataFrame(files, "g string, file_id long, name string, mtime long").withColumn("_record", F.lit(1))
    r = spark.createDataFrame(records, "g string, record_id long, seq long, name string").withColumn("_name", F.lit(1))
    found = sorted(tuple(x) for x in matching.greedy_assignment(f, r, "g", share, target=target).collect())
    plain = in_turn([x for x in files if x[0]], [x for x in records if x[0]], share)
    assert found == plain
    assert not matching.greedy_assignment(f.where("false"), r, "g", share).collect()


@pytest.mark.parametrize("target", [1, 20])
def test_greedy_assignment_in_one_pass(spark, monkeypatch, target):
    """A large group goes in stretches, the others in one pass each, in which no group waits for a round."""
    rng = random.Random(3)
    name = lambda: " ".join(rng.choice("abcde") for _ in range(2))
    group = lambda: rng.choice(["g0", "g1", "g1", "g1"])
    files = [(group(), i, name(), rng.randrange(9)) for i in range(90)] + [("g2", 90, "a b", 1), ("g2", 91, "b", 2)]
    records = [(group(), i, rng.randrange(9), name()) for i in range(60)] + [("g2", 60, 1, "b c"), ("g2", 61, 0, "c")]
    share = lambda a, b: bool(set(a.split()) & set(b.split()))
    f = spark.createDataFrame(files, "g string, file_id long, name string, mtime long")
    r = spark.createDataFrame(records, "g string, record_id long, seq long, name string")
    run, rounds = matching.assigned_in_stretches, []
    monkeypatch.setattr(matching, "assigned_in_stretches", lambda a, o, t: rounds.append(a.select("_group").distinct().count()) or run(a, o, 15))
    found = sorted(tuple(x) for x in matching.greedy_assignment(f, r, "g", share, target=target).collect())
    assert found == in_turn(files, records, share)
    assert rounds == ([] if target == 20 else [2])


def test_greedy_assignment_of_one_hot_name(spark):
    """A name that most files have, and one that contends for its records."""
    f = spark.range(9_000).select(F.lit("g").alias("g"), F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, "a b").otherwise("a").alias("name"), (-F.col("id")).alias("mtime"))
    r = spark.range(6_000).select(F.lit("g").alias("g"), F.col("id").alias("record_id"), F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("name"))
    share = lambda a, b: bool(set(a.split()) & set(b.split()))
    found = sorted((x.file_id, x.record_id) for x in matching.greedy_assignment(f, r, "g", share, target=3_000).collect())
    left, out = {"a": deque(i for i in range(6_000) if i % 4), "b": deque(range(0, 6_000, 4))}, []
    for i in range(9_000):
        open_ = [k for k in (("a", "b") if i % 3 == 0 else ("a",)) if left[k]]
        if open_:
            out.append((i, left[min(open_, key=lambda k: left[k][0])].popleft()))
    assert found == out


def test_merge_rects(spark):
    rows = [("m", 1, 0.1, 0.2, 0.2, 0.3), ("m", 2, 0.205, 0.202, 0.3, 0.301), ("m", 3, 0.5, 0.2, 0.6, 0.3), ("m", 4, 0.1, 0.4, 0.2, 0.5)]
    found = layout.merge_rects(spark.createDataFrame(rows, "mark string, seq long, x0 double, y0 double, x1 double, y1 double"), ["mark"]).orderBy("rect_no").collect()
    assert [(r.x0, r.y0, r.x1) for r in found] == [(0.1, 0.2, 0.3), (0.5, 0.2, 0.6), (0.1, 0.4, 0.2)]


def test_session_gap_is_strict(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp_ntz'2024-01-01 00:02:30' UNION ALL SELECT 1, timestamp_ntz'2024-01-01 00:05:01'")
    assert sorted(r.n for r in stateful.sessions(rows, "k", "ts", 150).collect()) == [1, 2]


def test_structure(spark):
    nodes = spark.createDataFrame([(1, "p1", "par3", ["par4"]), (1, "p2", "par5", None), (1, "p3", "par5", None)], "doc_id long, node_id string, label string, aliases array<string>")
    wanted = spark.createDataFrame([(1, "par4"), (1, "par5"), (1, "par9")], "doc_id long, value string")
    found = {r.value: (r.status, r.node_id) for r in structure.unique_targets(wanted, nodes).collect()}
    assert found == {"par4": ("found", "p1"), "par5": ("ambiguous", None), "par9": ("missing", None)}
    assert one(spark, structure.bare_label(F.col("l")), l="(iv).)") == "iv"


def test_item_ends_of_one_large_group(spark):
    """A frame that begins after each row was read anew for every row: a minute and more for this group."""
    n = 150_000
    rows = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("item"), (F.col("id") * 3).alias("start"), F.lit(9 * n).alias("last"))
    began = time.monotonic()
    found = structure.item_ends(rows, "g", "last")
    ends = F.when(F.col("item") < n - 1, F.col("start") + 3).otherwise(F.col("last"))
    assert found.where(F.col("item_end") == ends).count() == n
    assert time.monotonic() - began < 30
    few = spark.createDataFrame([(None, 1, 5, 99), (None, 2, 5, 99), (None, 3, 7, 99), ("a", 4, 6, 50), ("a", 5, None, 50)], "g string, item long, start long, last long")
    assert {r["item"]: r.item_end for r in structure.item_ends(few, "g", "last").collect()} == {1: 7, 2: 7, 3: 99, 4: 50, 5: 50}


def test_redirect_limit(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "source string, target string")
    ends = {r.url: (r.final, r.n_hops, r.status) for r in resolve.redirect_ends(spark.createDataFrame([("0",), ("5",), ("z",)], "url string"), chain).collect()}
    assert ends == {"0": ("5", 5, "too_many"), "5": ("9", 4, "done"), "z": ("z", 0, "done")}


def test_files(spark, tmp_path):
    (tmp_path / "alias.tsv").write_text("# a comment\n\n2001 SCC 1\tfirst\nkey\tother\n2001 SCC 1\tlast\n")
    lines = files.alias_lines(spark, str(tmp_path / "alias.tsv"))
    assert {r.key: r.target for r in resolve.last_alias(lines).collect()} == {"2001 SCC 1": "last", "key": "other"}
    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"v{i}", i / 2) for i in range(50)])
    con.commit()
    got = files.sqlite_table(spark, str(tmp_path / "s.db"), "t")
    assert sorted(r.a for r in got.collect()) == list(range(50)) and got.schema["c"].dataType.simpleString() == "double"
    con.execute("CREATE VIEW v AS SELECT 1")
    con.commit()
    with pytest.raises(Exception, match="views"):
        files.sqlite_table(spark, str(tmp_path / "s.db"), "t").collect()
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>Body </w:t><w:t>text</w:t></w:r></w:p><w:p/></w:body></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{word}"><w:footnote><w:p><w:r><w:t>2018 SCC 31</w:t></w:r></w:p></w:footnote></w:footnotes>')
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.docx").write_bytes(buffer.getvalue())
    assert [(r.kind, r.text) for r in files.docx_files(spark, str(tmp_path / "d")).collect()] == [("body", "Body text"), ("footnote", "2018 SCC 31")]
    (tmp_path / "d" / "x.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    assert [(r.name, r.admitted) for r in files.pdf_files(spark, str(tmp_path / "d")).collect()] == [("x.pdf", True)]


def test_archives(spark):
    rows = spark.createDataFrame([("g", "b.txt", b"two"), ("g", "a.txt", b"one")], "g string, name string, content binary")
    assert sorted(r.part for r in sinks.archives(rows, "g", most=1).collect()) != [0]
    made = sinks.archives(rows, "g").first()
    with zipfile.ZipFile(io.BytesIO(made.archive)) as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"two" and z.testzip() is None


def until(done, seconds=90):
    """Streams with times of their own never end by themselves: wait for what they must have put out."""
    import time

    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.3)
    return done()


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(200):
        (folder / f"{i:03d}.pdf").write_bytes(b"1")
    (folder / "skip.txt").write_bytes(b"1")
    (folder / "below").mkdir()
    (folder / "below" / "deep.PDF").write_bytes(b"1")
    rows: list = []
    got = lambda: list(rows)

    def start(choice):
        rows.clear()
        files = state.unseen(watch.watched(spark, str(folder), choice=choice, depth=1), buckets=4)
        keep = lambda batch, i: rows.extend((r.name, r.size) for r in batch.collect())
        return files.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="1 second").start()

    running = start(1)
    try:
        assert until(lambda: len(got()) == 201) and ("below/deep.PDF", 1) in got()
        (folder / "000.pdf").write_bytes(b"22")
        (folder / "new.pdf").write_bytes(b"3")
        assert until(lambda: len(got()) == 203) and {("000.pdf", 2), ("new.pdf", 1)} <= set(got())
    finally:
        running.stop()
    sizes = [f.stat().st_size for f in (tmp_path / "c" / "offsets").iterdir() if f.name.isdigit()]
    assert max(sizes) < 2500  # whatever the number of files
    (folder / "late.pdf").write_bytes(b"4")
    running = start(1)  # what was seen stays seen
    try:
        assert until(lambda: len(got()) >= 1) and got() == [("late.pdf", 1)]
    finally:
        running.stop()
    running = start(2)  # the folder is chosen anew: all of it again
    try:
        assert until(lambda: len(got()) >= 203) and sorted(n for n, _ in got())[:1] == ["000.pdf"] and len(got()) == 203
    finally:
        running.stop()


def test_streams_like_batches_at_every_trigger(spark, tmp_path):
    """Latest rows and the breaker against their batch forms over what had come by each trigger; with
    rows that come late, and with state that ends."""
    import datetime as d

    at = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    batches = [[("a", "x", 1, at(5)), ("a", "y", 2, at(1)), ("b", "x", 3, at(3))], [("a", "x", 4, at(4)), ("a", "y", 5, at(9))], [("b", "x", 6, at(8)), ("c", "z", 7, at(1)), ("a", "x", 8, at(20))]]
    schema = "user string, item string, n long, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        import time

        time.sleep(1.1)  # files come in the order of their times
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got: dict = {}

    def keep(name):
        return lambda batch, i: got.setdefault(name, []).append([tuple(r) for r in batch.collect()])

    def run(name, df, mode):
        running = df.writeStream.foreachBatch(keep(name)).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert running.awaitTermination(120)

    run("latest", state.latest(stream(), "user", "item", ["ts", "n"], idle_ms=0), "update")
    run("breaker", state.after_block(stream(), "user", "item", ["ts", "n"], F.col("n") % 2 == 1, F.concat(F.lit("by "), F.col("n").cast("string")), ttl_ms=0), "append")
    held, seen, outcomes = {}, [], []
    for i, rows in enumerate(batches):
        seen += rows
        held |= {(u, k): (n, t) for u, k, n, t in got["latest"][i]}
        batch = stateful.latest(spark.createDataFrame(seen, schema), ["user", "item"], ["ts", "n"])
        assert held == {(r.user, r.item): (r.n, r.ts) for r in batch.collect()}
        outcomes += got["breaker"][i]
    by_arrival = spark.createDataFrame([(*r, i) for i, rows in enumerate(batches) for r in rows], schema + ", batch int")
    marked = resolve.after_block(by_arrival.withColumn("origin", F.concat("user", "item")), "origin", ["batch", "ts", "n"], F.col("n") % 2 == 1, F.concat(F.lit("by "), F.col("n").cast("string")))
    assert sorted((n, o, s) for _, _, n, _, o, s in outcomes) == sorted((r.n, r.outcome, r.skipped) for r in marked.collect())
    rows = state.latest(stream(), "user", "item", ["ts", "n"], idle_ms=600_000)
    running = rows.writeStream.foreachBatch(keep("timed")).outputMode("update").option("checkpointLocation", str(tmp_path / "timed")).start()
    try:
        assert until(lambda: sum(map(len, got.get("timed", []))) == sum(map(len, got["latest"])))
    finally:
        running.stop()


def test_only_lines_of_the_bands_need_a_key(spark):
    rows = [(1, page, i, f"[{i}] x" if i == 1 else "Head" if i == 0 else "words", i / 20, (i + 1) / 20) for page in range(3) for i in range(20)]
    lines = layout.keyed(spark.createDataFrame(rows, "doc long, page long, line_no long, line string, top double, bottom double"))
    band = (F.col("top") < layout.TOP) | (F.col("bottom") > layout.BOTTOM)
    lines = lines.withColumn("key", F.when(band, F.col("key")).otherwise(F.raise_error(F.lit("not in a band"))))
    kept = layout.strip_running(lines, layout.running_headers(lines, "doc", "page"), "doc", "page")
    assert sorted((r.page, r.line_no) for r in kept.collect()) == [(p, i) for p in range(3) for i in range(1, 20)]


def test_nfkc_by_pieces(spark, monkeypatch):
    """Python was handed whole texts; now their pieces of characters that have other forms."""
    import unicodedata

    rng = random.Random(9)
    chars = [*"aeo< K1\x1f\n", "\u0301", "\u0327", "\u0338", "\ufb01", "\uff21", "\u2460", "\u3131", "\u1100", "\u1161", "\u11a8", "\u212b", "\u3000", "\ufdfa", "\U0001f600", "\U0001d400", "\u05d0", "\u00e9", "\u30ab", "\u3099", "\u0344", "\u00a8", "\u1e9b"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(12))) for _ in range(3000)] + ["", "\x1f\u0301\x1f", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", text.nfkc(F.col("t")).alias("n")).collect()
    import re

    plain = lambda t: None if t is None else re.sub(f"[{text.SPACES}]+", " ", unicodedata.normalize("NFKC", t)).strip(" ")
    assert [(texts[r.i], r.n) for r in found] == [(texts[r.i], plain(texts[r.i])) for r in found]
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: lambda c: F.concat(c, F.length(c).cast("string")))
    assert one(spark, text.nfkc(F.col("t")), t="x" * 5000 + "\ufb01") == "x" * 5000 + "\ufb013"  # three characters, with what parts them


def test_many_keys_of_a_stream_are_few_calls(spark, tmp_path):
    """Each key was a call of its own, some milliseconds each: minutes for these."""
    n = 40_000
    rows = spark.range(n).select((F.col("id") % 20_000).alias("user"), (F.col("id") % 3).alias("item"), "id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    message = F.when(F.col("id") == 0, "").otherwise("x")
    for name, df, mode in (
        ("breaker", state.after_block(stream, "item", "user", ["id"], F.col("id") < 20_000, message, ttl_ms=0), "append"),
        ("latest", state.latest(stream, "user", "item", ["id"], idle_ms=0), "update"),
    ):
        began, got = time.monotonic(), []
        running = df.writeStream.foreachBatch(lambda batch, i, got=got: got.extend(batch.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert running.awaitTermination(240)
        assert time.monotonic() - began < 60
        if name == "latest":
            assert len(got) == len({(r.user, r["item"]) for r in got}) and max(r.id for r in got) == n - 1
        else:
            marked = resolve.after_block(rows.withColumn("origin", F.struct("item", "user")), "origin", ["id"], F.col("id") < 20_000, message)
            assert sorted((r.id, r.outcome, r.skipped) for r in got) == sorted((r.id, r.outcome, r.skipped) for r in marked.collect())


def test_stream_sessions(spark, tmp_path):
    import datetime as d

    at = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    for i, rows in enumerate([[("s", at(0)), ("s", at(100)), ("t", at(0))], [("s", at(400)), ("u", at(5000))], [("u", at(5001))]]):
        spark.createDataFrame(rows, "session string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    reads = spark.readStream.schema("session string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withWatermark("ts", "0 seconds")
    running = watch.closed_sessions(reads).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    closed = {(r.session, r.n) for r in spark.table("closed").collect()}
    assert ("t", 1) in closed and ("s", 2) in closed and not any(s == "u" for s, _ in closed)


def test_archives_of_a_whole_table(spark):
    """crc_zip has no SQL: every document comes back from the archives, whose CRC-32 is right."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    given = docs.select("source", F.format_string("%08d.txt", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    back = []
    for r in sinks.archives(given, "source", most=1 << 18).collect():
        assert r.crc == zlib.crc32(r.archive)
        with zipfile.ZipFile(io.BytesIO(r.archive)) as z:
            assert z.testzip() is None and z.namelist() == sorted(z.namelist())
            back += [(r.source, n, z.read(n)) for n in z.namelist()]
    order = lambda rows: sorted((str(a), b, bytes(c)) for a, b, c in rows)
    assert order(back) == order(given.collect())


def test_a_circle_of_parents_raises(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent_id long")
    with pytest.raises(ValueError):
        structure.subtree(nodes)
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(34)], "id long, parent_id long")
    assert structure.subtree(deep).where("root = 0").count() == 34


def test_gaps_are_measured_in_the_page_s_unit(spark):
    rows = [(1, 1, 0, "a", 0.1, 0.4, 0.2, 0.5, 50.0, 10.0, False, 600.0), (1, 1, 1, "b", 0.24, 0.4, 0.3, 0.5, 50.0, 10.0, False, 600.0), (1, 1, 2, "c", 0.36, 0.4, 0.4, 0.5, 50.0, 10.0, False, 600.0)]
    schema = "doc_id long, page long, item_no long, text string, x0 double, y0 double, x1 double, y1 double, baseline double, height double, has_eol boolean, width double"
    found = layout.assemble_lines(spark.createDataFrame(rows, schema)).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in found] == [(0, "a b"), (1, "c")]


ITEM = "doc_id long, page long, item_no long, text string, x0 double, y0 double, x1 double, y1 double, baseline double, height double, has_eol boolean, width double"


def test_items_in_order_are_not_dealt(spark):
    """The operator read its items five times and sorted them; items that are in order are read once."""
    rng = random.Random(5)
    for size, long in ((1, 40), (7, 40), (500, 40), (64, 700)):
        rows, expected = [], []
        for page in range(30):
            line = None
            for no in range(rng.randrange(long)):
                x0 = rng.choice([None, *[rng.randrange(60) / 100] * 9])
                text, base, height, eol = rng.choice(["a", "b ", "\u00a0", "", None, "cd"]), float(rng.randrange(4)), 8.0, rng.random() < 0.1
                rows.append((page % 3 or None, page, no, text, x0, 0.1 * (no % 3), (x0 or 0) + 0.05, 0.5, base, height, eol, 200.0))
                blank = not (text or "").strip(text_spaces)
                if blank:
                    line = None if eol else line
                    continue
                if x0 is None:
                    continue
                if line is not None and abs(line[4] - base) < 0.25 * height and x0 >= line[2] - 0.005 and (x0 - line[3]) * 200 < 3 * height:
                    space = (x0 - line[3]) * 200 > 0.15 * height and line[0][-1] not in text_spaces
                    line[:4] = [line[0] + " " * space + text, line[1] + 1, min(line[2], x0), max(line[3], x0 + 0.05)]
                else:
                    line = [text, 1, x0, x0 + 0.05, base, page]
                    expected.append(line)
                line = None if eol else line
        items = spark.createDataFrame(rows, ITEM).coalesce(1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = layout.assemble_lines(items, in_order=True)
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            got = [[r.text, r.n_items, r.x0, r.x1, r.baseline, r.page] for r in found.collect()]
            assert got == expected
            dealt = layout.assemble_lines(items.repartition(3)).orderBy("page", "line_no").collect()
            assert [[r.text, r.n_items, r.x0, r.x1, r.baseline, r.page] for r in dealt] == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


text_spaces = text.SPACES


def assembled(spark, rows, **settings):
    found = layout.assemble_lines(spark.createDataFrame(rows, ITEM).repartition(3), **settings).collect()
    return [r.text for r in sorted(found, key=lambda r: (str(r.doc_id), r.page, r.line_no))]


def test_lines_go_on_over_overlaps_and_break_on_drift(spark):
    assert assembled(spark, [item(0, "AB", 0.10, 0.20), item(1, "C", 0.19, 0.25)]) == ["ABC"]
    drift = [(1, 1, i, t, 0.1 + 0.1 * i, 0.4, 0.2 + 0.1 * i, 0.5, b, 10.0, False, 100.0) for i, (t, b) in enumerate([("a", 100.0), ("b", 102.0), ("c", 104.0), ("d", 106.0), ("e", 106.4)])]
    assert assembled(spark, drift) == ["ab", "cde"]
    # the box is a union: a short item inside it neither ends the line nor moves its right end back
    union = [item(0, "long", 0.10, 0.50), item(1, "in", 0.20, 0.25), item(2, "on", 0.51, 0.55)]
    assert assembled(spark, union) == ["longinon"]
    # left of the box by over .005
    assert assembled(spark, [item(0, "a", 0.10, 0.2), item(1, "b", 0.0949, 0.15), item(2, "c", 0.0951, 0.15)]) == ["a", "bc"]
    # an item without a box is passed over with its end of line; a blank one's end counts
    assert assembled(spark, [item(0, "a", 0.1, 0.2), item(1, "x", None, 0.2, eol=True), item(2, "b", 0.2, 0.3), item(3, "\u00a0", 0.3, 0.4, eol=True), item(4, "c", 0.3, 0.4)]) == ["ab", "c"]
    # no space after one, of any kind
    assert assembled(spark, [item(0, "a\u00a0", 0.1, 0.2), item(1, "b", 0.25, 0.3), item(2, "c", 0.35, 0.4)]) == ["a\u00a0b c"]
    assert assembled(spark, []) == []


def test_a_large_page_is_dealt_where_lines_end(spark):
    """Stretches of five items against one pass, with ends of lines close and far, and null pages."""
    rows = [(k, 1, i, f"w{i}", 0.05 * (i % 13), 0.1, 0.05 * (i % 13) + 0.03, 0.2, i // 13 * 0.3, 0.1, i % e == e - 1, 1.0) for k, e in ((1, 3), (2, 17), (3, 1000), (None, 4)) for i in range(90)]
    assert assembled(spark, rows, stretch=5) == assembled(spark, rows) != []


def test_keys_are_normalised(spark):
    key = lambda t: one(spark, text.running_key(F.col("t")), t=t)
    assert key("Report\u00a0of\u3000X") == key(" Report of X\ufeff") == "Report of X"
    assert key("Page\u00a05") == key("\uff30age 5") == key("\uff0d 5 -") == key("PAGE 12") == "#page-number"
    assert key("\ufb01rst") == "first" and key("[1]\u00a0x") is None and key("\u00a0") == ""
    assert one(spark, text.nfkc(F.col("t")), t="a\x1cb\x85c") == "a\x1cb\x85c"
    native = spark.createDataFrame([(1, "Same \ufb01ne", 0.5)], "doc_id long, line string, y double")
    read = spark.createDataFrame([(1, "Same\u00a0fine", 0.51), (1, "Same fine", 0.6), (1, "other", 0.5)], "doc_id long, line string, y double")
    assert sorted(r.y for r in layout.drop_recognised(native, read, ["doc_id"]).collect()) == [0.5, 0.6]


def test_stable_characters_are_stable():
    import re
    import unicodedata

    stable = [c for c in map(chr, range(0x3000)) if re.match(f"[{text.STABLE}]", c)]
    assert len(stable) > 250
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    joined = "".join(stable)
    assert unicodedata.normalize("NFKC", joined) == joined and unicodedata.normalize("NFKC", joined[::-1]) == joined[::-1]


def test_headers_go_in_their_bands(spark):
    pages = [(p, i, t, top, top + 0.05) for p in range(1, 5) for i, (t, top) in enumerate([("Head\u00a0line" if p % 2 else "Head line", 0.01), ("[1] text", 0.3), ("Head line", 0.5), ("\u2013 %d \u2013" % p, 0.94)])]
    lines = layout.keyed(spark.createDataFrame([(9, *r) for r in pages], "doc long, page long, line_no int, line string, top double, bottom double"))
    running = layout.running_headers(lines, "doc", "page")
    assert sorted(r.key for r in running.collect()) == ["#page-number", "Head line"]
    kept = layout.strip_running(lines, running, "doc", "page")
    assert sorted((r.page, r.line_no) for r in kept.collect()) == [(p, i) for p in range(1, 5) for i in (1, 2)]
    assert set(kept.columns) == {"doc", "page", "line_no", "line", "top", "bottom"}


SPAN = "unit string, seq long, start long, end long"


def plain_fold(rows):
    kept = []
    for u, q, s, e in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] if r[2] is not None else -1, r[3] or 0)):
        if s is None or e is None or e < s or not any(k[0] == u and None not in k[2:] and k[2] <= k[3] and s < k[3] and k[2] < e for k in kept):
            kept.append((u, q, s, e))
    return sorted(kept, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_like_one_fold(spark, seed):
    """Many stretches against a plain loop: random spans, long ones over many stretches, chains in which
    each overlaps the next, repeats, empty and reversed ones, nulls."""
    import random

    rng = random.Random(seed)
    rows = [("u", i, s, s + rng.choice([0, 1, 5, 20, 60])) for i, s in enumerate(rng.randrange(600) for _ in range(300))]
    rows += [("c", i, 4 * i, 4 * i + 6) for i in range(150)] + [("d", 150 - i, 4 * i, 4 * i + 6) for i in range(150)]
    rows += [("u", 7, 3, 3), ("u", 7, 3, 3), ("v", 1, None, 3), ("v", 2, 5, 1), ("v", 3, 0, 900), (None, 1, 0, 5), (None, 2, 4, 9), ("u", -1, 290, 330)]
    rows += [("same", i, 10, 20) for i in range(60)] + [("far", 1, -(10**12), -(10**12) + 5), ("far", 2, 10**12, 10**12 + 5)]
    spans = spark.createDataFrame(rows, SPAN).repartition(4)
    one_pass = sorted(map(tuple, links.without_overlaps(spans, "unit").collect()), key=str)
    assert one_pass == plain_fold(rows)
    assert sorted(map(tuple, links.without_overlaps(spans, "unit", target=10).collect()), key=str) == one_pass


def test_a_million_spans_of_one_unit(spark):
    """One key in several tasks, against the sorted pass over all of it."""
    start = F.pmod(F.xxhash64("id"), F.lit(4_000_000))
    spans = spark.range(1_000_000).select(F.lit("u").alias("unit"), F.col("id").alias("seq"), start.alias("start"), (start + 1 + F.col("id") % 9).alias("end"))
    in_rounds, whole = links.without_overlaps(spans, "unit"), links.without_overlaps(spans, "unit", target=10**9)
    total = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("seq", "start", "end").cast("decimal(38,0)")).alias("h")).first()
    assert total(in_rounds) == total(whole) and total(whole).n > 300_000


@pytest.mark.parametrize("seed", range(3))
def test_pointers_like_one_fold(spark, seed):
    import random

    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(400):
        at += rng.choice([0, 0, 1, 3, 10, 59, 60, 61, 200, 700])
        rows.append(("k", i, at))
    rows += [("l", 900, 5), ("l", 901, None), ("l", 902, None), (None, 903, 7), (None, 904, 30), (None, 905, 99)]
    requests = spark.createDataFrame(rows, "key string, request_id long, s long").repartition(3).withColumn("ts", F.timestamp_seconds("s"))
    of = lambda **k: sorted((r.request_id, r.leader) for r in stateful.shared_requests(requests, ["key"], "ts", 60, **k).collect())
    leader, since, given = None, None, []
    for _, i, t in rows[:400]:
        if since is None or t - since >= 60:
            leader, since = i, t
        given.append((i, leader))
    timed = lambda found: [x for x in found if x[0] not in (901, 902)]
    assert timed(of()) == given + [(900, 900), (903, 903), (904, 903), (905, 905)]
    assert timed(of(target=5)) == timed(of())


def test_pairs_of_lines_and_ranges_once(spark):
    import random

    rng = random.Random(3)
    lines = [(d, i, " " if i % 11 == 5 else "x", s, s + rng.randrange(0, 90)) for d in (1, 2, None) for i, s in enumerate(rng.randrange(500) for _ in range(60))]
    ranges = [(d, i, s, s + rng.choice([-3, 0, 1, 40, 500])) for d in (1, 2, None) for i, s in enumerate(rng.randrange(500) for _ in range(20))] + [(1, 99, None, 4)]
    a = spark.createDataFrame(lines, "doc_id long, line_no long, line string, start long, end long")
    b = spark.createDataFrame(ranges, "doc_id long, range_id long, start long, end long")
    given = sorted((d, i, r) for d, i, t, s, e in lines for k, r, f, g in ranges if d is not None and d == k and t.strip() and None not in (f, g) and e > f and s < g)
    for stretch in (1, 7, 64, 100_000):
        assert sorted((x.doc_id, x.line_no, x.range_id) for x in structure.overlapping(a, b, stretch=stretch).collect()) == given


def test_a_document_of_many_lines_and_ranges(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.lit("x").alias("line"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 49).alias("end"))
    ranges = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("range_id"), (F.col("id") * 50 + 25).alias("start"), (F.col("id") * 50 + 75).alias("end"))
    assert structure.overlapping(lines, ranges).count() == 2 * n - 1


def test_points_in_cells_like_all_pairs(spark):
    import random

    rng = random.Random(6)
    u = lambda: rng.choice([0.0, 0.25, 0.5, 1.0, rng.random(), rng.random(), -0.2, 1.3])
    marks = [(i, rng.choice([1, 1, 1, 2, None]), i // 2, *(rng.choice([(0.0, 1.0), (0.5, 0.75), tuple(sorted((u(), u())))]) + tuple(sorted((u(), u()))))) for i in range(300)]
    marks = [(i, p, q, a, c, b, d) for i, p, q, a, b, c, d in marks] + [(900, 1, 99999, None, 0.0, 1.0, 1.0), (901, 1, 99999, 0.9, 0.0, 0.1, 1.0)]
    points = [(i, rng.choice([1, 2, 3, None]), u(), u()) for i in range(200)] + [(999, 1, None, 0.5)]
    m = spark.createDataFrame(marks, "mark_id long, page long, seq long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "point_id long, page long, x double, y double")
    given = {}
    for i, page, x, y in points:
        held = [(q, k) for k, g, q, a, b, c, d in marks if page is not None and page == g and None not in (a, x) and a <= x <= c and b <= y <= d]
        given[i] = max(held, default=(None, None))[1]
    for few in (1000, 0, 50):
        assert {r.point_id: r.mark_id for r in layout.topmost_at(p, m, few=few).collect()} == given


def test_addresses_of_both_families(spark):
    import ipaddress
    import random

    rng = random.Random(4)
    given = {"::": "0" * 32, "1:2:3:4:5:6:7:8": "00010002000300040005000600070008", "1:2:3:4::5:6:7:8": "00010002000300040005000600070008", "FE80::A:1": "fe80" + "0" * 20 + "000a0001", "::1.2.3.4": "0" * 24 + "01020304", "1:2:3:4:5:6:1.2.3.4": "00010002000300040005000601020304"}
    for text_, digits in given.items():
        assert one(spark, web.ip_key(F.col("a")), a=text_) == "6:" + digits
    for bad in ("1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3.256", "1.2.3", "01.2.3.4", "", "::1%lo", "1:2:3:4:5:6:7:8::9"):
        assert one(spark, web.ip_key(F.col("a")), a=bad) is None, bad
    assert one(spark, web.ip_number(F.col("a")), a="01.2.3.4") is None
    rules, plain = [], []
    for family, size in ((ipaddress.IPv4Address, 32), (ipaddress.IPv6Address, 128)):
        for _ in range(12):
            a = rng.getrandbits(size)
            b = min((1 << size) - 1, a + rng.getrandbits(rng.randrange(1, size)))
            rules.append((str(family(a)), str(family(b)), None))
            plain.append((size, a, b))
            bits = rng.randrange(0 if rng.random() < 0.05 else 3, size + 1)
            rules.append((str(family(a)), None, bits))
            low = a >> size - bits << size - bits
            plain.append((size, low, low + (1 << size - bits) - 1))
    plain = plain[:-1]
    rules = rules[:-1] + [("9.9.9.9", "1.1.1.1", None)]
    addresses = []
    for size, a, b in plain:
        addresses += [(size, n) for n in (a, b, a - 1, b + 1, rng.getrandbits(size), (a + b) // 2) if 0 <= n < 1 << size]
    rows = [(i, str((ipaddress.IPv4Address if s == 32 else ipaddress.IPv6Address)(n)), i) for i, (s, n) in enumerate(addresses)]
    df = spark.createDataFrame([*rows, (-1, None, 0), (-2, "no", 0), (0, rows[0][1], 5)], "n long, address string, bits long")
    r = spark.createDataFrame(rules, "first string, last string, bits int")
    found = resolve.blocked_by_rules(df, r).collect()
    assert len(found) == len(rows) + 3 and found[0].__fields__ == ["n", "address", "bits", "blocked"]
    for x in found:
        size, n = addresses[x.n] if x.n >= 0 else (0, 0)
        assert x.blocked == any(s == size and a <= n <= b for s, a, b in plain), x
    none = spark.createDataFrame([], "first string, last string, bits int")
    assert not any(x.blocked for x in resolve.blocked_by_rules(df, none).collect())
    with pytest.raises(Exception, match="one family"):
        resolve.blocked_by_rules(df, spark.createDataFrame([("1.2.3.4", "::1", None)], r.schema)).collect()


def test_links_are_written_or_refused(spark, tmp_path):
    path = f"file://{tmp_path}/links"
    planned = spark.createDataFrame([("a", 1, 0, 3, "one", "u1"), ("a", 2, 4, 7, "two", "u2"), ("b", 1, 0, 3, "one", "u3"), ("gone", 1, 0, 1, "x", "u4"), ("a", 3, 90, 95, "far", "u5"), ("a", 4, 4, 7, None, "u6")], "unit_id string, n long, start long, end long, expected string, url string").repartition(4)
    units = spark.createDataFrame([("a", "one two"), ("b", "0ne")], "unit_id string, text string")
    assert linked.write_links(planned, units, path) == {"written": 2, "refused": 4}
    assert {(r.unit_id, r.n) for r in linked.read_links(spark, path).where("written").collect()} == {("a", 1), ("a", 2)}
    assert linked.write_links(planned, units, path) == {"written": 2, "refused": 4}
    assert linked.read_links(spark, path).count() == 12
    assert linked.write_links(planned.limit(0), units, path) == {"written": 0, "refused": 0}
    assert linked.write_links(planned.where("n = 1"), units, path, mode="overwrite") == {"written": 1, "refused": 2}
    assert linked.read_links(spark, path).count() == 3 == len({r.url for r in linked.read_links(spark, path).collect()})
    files = {f.name for f in (tmp_path / "links").iterdir() if f.suffix == ".parquet"}
    writer = linked.LinkWriter(path, False)
    import pyarrow as pa

    lost = writer.write(iter([pa.RecordBatch.from_pydict({"expected": ["a"], "found": ["a"]})]))
    assert linked.read_links(spark, path).count() == 3  # what no commit lists doesn't count
    writer.abort([lost, None])
    assert {f.name for f in (tmp_path / "links").iterdir() if f.suffix == ".parquet"} == files
    with pytest.raises(Exception, match="need expected"):
        planned.write.format("linked_units").option("path", path).mode("append").save()


def test_a_change_clears_what_could_be_redone(spark):
    ops = ["undo", "change", "change", "undo", "redo", "undo", "change", "redo", "undo", "undo", "undo", "other", None]
    rows = spark.createDataFrame([("k", i, o, f"v{i}") for i, o in enumerate(ops)], "key string, seq long, op string, value string").repartition(3)
    found = [(r.current, r.undos, r.redos) for r in sorted(stateful.replayed_history(rows, "key", ["seq"]).collect(), key=lambda r: r.seq)]
    assert found == [(None, 0, 0), ("v1", 1, 0), ("v2", 2, 0), ("v1", 1, 1), ("v2", 2, 0), ("v1", 1, 1), ("v6", 2, 0), ("v6", 2, 0), ("v1", 1, 1), (None, 0, 2), (None, 0, 2), (None, 0, 2), (None, 0, 2)]
    many = spark.createDataFrame([(1, i, "change", i) for i in range(100)] + [(1, 100 + i, "undo", None) for i in range(60)], "key long, seq long, op string, value long")
    last = max(stateful.replayed_history(many, "key", ["seq"]).collect(), key=lambda r: r.seq)
    assert (last.current, last.undos, last.redos) == (59, 0, 40)


def test_scratch_folders_go(spark):
    import os

    path = scratch.scratch_folder(spark, "t")
    spark.range(3).write.parquet(path)
    spark.range(3).write.parquet(path + "-state")
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    kept, scratch._folders[:] = scratch._folders[:-1], scratch._folders[-1:]
    scratch.sweep()
    scratch._folders[:] = kept
    assert not os.path.exists(local) and not os.path.exists(local + "-state")
