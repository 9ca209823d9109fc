"""Lines of pages and documents: offsets, running headers, margins, assembly, reading order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from math import log2
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as T
from ..sources.scratch import durable
from .folds import sorted_pass


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line) for each line feed separated line."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def running_lines(lines: DataFrame, page: str = "doc_id", line: str = "line", least: Column | int = 2) -> DataFrame:
    """(line, n_pages): tidied lines on at least so many different pages.

    Pairs are made distinct before they are counted, so a line that one page repeats is combined on
    the map side, and a line of every page costs one row per page.
    """
    pairs = lines.select(page, T.tidy(F.col(line)).alias("line")).where("line <> ''").distinct()
    return pairs.groupBy("line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)


#: The bands at a page's top and bottom, in shares of its height.
TOP, BOTTOM = 0.075, 0.935


def keyed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with key, what they are compared by, and numbered, whether they begin with a paragraph's
    number: what running_headers and strip_running read, the key in the bands only."""
    return lines.withColumns({"key": T.running_key(F.col(line)), "numbered": T.numbered(F.col(line))})


def running_headers(lines: DataFrame, document: str, page: str, share: float = 0.5) -> DataFrame:
    """(document, key): keys that stand in the top or bottom band of max(2, half the pages, or another
    share, rounded up) pages of a document.

    lines: of keyed(), with document, page, and top and bottom of their box from 0 to 1."""
    in_band = (F.col("top") < TOP) | (F.col("bottom") > BOTTOM)
    pages = lines.select(document, page).distinct().groupBy(document).agg(F.count("*").alias("pages"))
    counts = lines.where(in_band).where("key is not null").select(document, page, "key").distinct().groupBy(document, "key").agg(F.count("*").alias("n"))
    return counts.join(pages, document).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share))).select(document, "key")


def strip_running(lines: DataFrame, running: DataFrame, document: str, page: str) -> DataFrame:
    """The lines without running headers and page numbers.

    A line of a running key goes if it is a page's number in one of the bands, or stands in the top
    band before the page's first numbered line. Elsewhere the same words stay: only the lines of the
    bands are joined with what decides, the others pass as they are and need no key.
    lines: of keyed(), also with line_no, by which the lines of a page are ordered; running: of
    running_headers.
    """
    in_band = F.coalesce((F.col("top") < TOP) | (F.col("bottom") > BOTTOM), F.lit(False))
    first = lines.where("numbered").groupBy(document, page).agg(F.min("line_no").alias("_first"))
    placed = lines.where(in_band).join(first, [document, page], "left")
    number, top = F.col("key") == "#page-number", F.col("top") < TOP
    may_go = F.coalesce((top & (number | (F.col("line_no") < F.col("_first")))) | ((F.col("bottom") > BOTTOM) & number), F.lit(False))
    goes = running.select(document, "key", F.lit(True).alias("_running"))
    judged = placed.withColumn("_may", may_go).join(goes, [document, "key"], "left")
    kept = judged.where(~(F.col("_may") & F.coalesce("_running", F.lit(False))))
    columns = [c for c in lines.columns if c not in ("key", "numbered")]
    return lines.where(~in_band).select(*columns).unionByName(kept.select(*columns))


def strip_lines(lines: DataFrame, running: DataFrame, line: str = "line") -> DataFrame:
    """The lines whose tidied form isn't running."""
    return lines.join(running.select(F.col("line").alias("_running")), T.tidy(F.col(line)) == F.col("_running"), "left_anti")


def line_offsets(lines: DataFrame, order: Sequence[str] = ("line_no",), key: str = "doc_id", line: str = "line") -> DataFrame:
    """lines with start and end in the text that joins them by line feeds; end excludes its feed."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(line) + 1).over(before), F.lit(0)).cast("long")
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length(line))


def page_offsets(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """line_offsets over pages: a blank line follows each page."""
    order = Window.partitionBy(key).orderBy("page", "line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    page_breaks = F.max("page_rank").over(order)
    ranked = lines.withColumn("page_rank", F.dense_rank().over(Window.partitionBy(key).orderBy("page")) - 1)
    start = (F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)) + page_breaks).cast("long")
    return ranked.withColumn("start", start).withColumn("end", F.col("start") + F.length("line")).drop("page_rank")


def left_margins(lines: DataFrame, x: Column, key: str = "doc_id", line: str = "line") -> DataFrame:
    """(key, margin): element floor(n / 5) of the ascending x of non-blank lines; 0 without such lines."""
    xs = F.array_sort(F.collect_list(F.when(F.trim(line) != "", x)))
    return lines.groupBy(key).agg(xs.alias("xs")).select(key, F.coalesce(F.get("xs", F.floor(F.size("xs") * 0.2).cast("int")), F.lit(0)).alias("margin"))


def first_marked(lines: DataFrame, pattern: str, key: str = "doc_id", line: str = "line") -> DataFrame:
    """(key, first_line): the first line that matches, -1 if none does."""
    return lines.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(line).rlike(pattern), F.col("line_no"))), F.lit(-1)).cast("long").alias("first_line"))


def needs_recognition(pages: DataFrame, useful: str = "useful", body: str = "body", has_image: str = "has_image") -> Column:
    """Whether a page's own text is too little: under 60 useful characters, or under 40 in the body
    with an image on the page."""
    return (F.col(useful) < 60) | ((F.col(body) < 40) & F.coalesce(F.col(has_image), F.lit(False)))


def drop_recognised(native: DataFrame, recognised: DataFrame, keys: Sequence[str], y: str = "y", line: str = "line", within: float = 0.04) -> DataFrame:
    """The recognised lines that aren't a native line of the same page, normalised text and place."""
    there = native.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(y).alias("_y"), T.nfkc(F.col(line)).alias("_line"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    read = recognised.withColumn("_key", T.nfkc(F.col(line)))
    return read.join(there, [*same, F.col("_key") == F.col("_line"), F.abs(F.col(y) - F.col("_y")) < within], "left_anti").drop("_key")


#: A line goes on within this share of an item's height round its first baseline, at most
#: so far left of its box in shares of the page, and over less than so many heights; a gap of over so
#: many heights gives a space.
BASELINE, BACK, FAR, SPACED = 0.25, 0.005, 3, 0.15
#: Items of a page that one task puts together at least, if a line ends among them.
STRETCH = 4096

LINE = "line_no long, first_item long, last_item long, n_items long, text string, x0 double, y0 double, x1 double, y1 double, baseline double"
#: Runs of items side by side from which numpy steps through them at once.
LANES = 16


def begun(starts: np.ndarray, sizes: np.ndarray, x0: np.ndarray, x1: np.ndarray, baseline: np.ndarray, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items begin a line and which have a gap before them. Runs begin at `starts` and begin a
    line each; an item depends on its run's earlier ones only, so all runs go step by step side by
    side, and the few that are longer than the others go by themselves."""
    new, gap = np.ones(len(x0), bool), np.zeros(len(x0), bool)
    runs = np.argsort(-sizes, kind="stable")
    at, sizes = starts[runs], sizes[runs]
    left, right, base = x0[at], x1[at], baseline[at]
    step = 1
    while (n := int(np.searchsorted(-sizes, -step, "left"))) >= LANES:
        i, left, right, base = at[:n] + step, left[:n], right[:n], base[:n]
        a, b, h, far = x0[i], x1[i], height[i], (x0[i] - right) * width[i]
        joins = (np.abs(base - baseline[i]) < BASELINE * h) & (a >= left - BACK) & (far < FAR * h)
        new[i], gap[i] = ~joins, joins & (far > SPACED * h)
        left, right, base = np.where(joins & ~(a < left), left, a), np.where(joins & ~(b > right), right, b), np.where(joins, base, baseline[i])
        step += 1
    for k in range(n):
        l, r, o, rest = float(left[k]), float(right[k]), float(base[k]), slice(int(at[k]) + step, int(at[k] + sizes[k]))
        for i, a, b, c, h, w in zip(range(rest.start, rest.stop), x0[rest].tolist(), x1[rest].tolist(), baseline[rest].tolist(), height[rest].tolist(), width[rest].tolist()):
            far = (a - r) * w
            if abs(o - c) < BASELINE * h and a >= l - BACK and far < FAR * h:
                new[i], gap[i], l, r = False, far > SPACED * h, min(l, a), max(r, b)
            else:
                l, r, o = a, b, c
    return new, gap


def joined_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fold of assemble_lines over a task's items, sorted by page and number. Between two batches the
    open line is kept, as one item with its box and its first baseline, whatever the page's size."""
    numbers = ("x0", "y0", "x1", "y1", "baseline", "height", "width")
    own = ("item_no", "text", *numbers, "has_eol")
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    line_fields = [pa.field(n, kinds[t]) for n, t in (c.split(" ") for c in LINE.split(", "))]
    open_line: pa.Table | None = None
    place, lines_before = None, 0
    for batch in batches:
        keys = [n for n in batch.schema.names if n not in own]
        schema = pa.schema([*(batch.schema.field(n) for n in keys), *line_fields])
        items = pa.Table.from_arrays([*batch.columns, batch.column("item_no"), pa.array(np.ones(len(batch), np.int64))], [*batch.schema.names, "first_item", "n_items"])
        if open_line is not None:
            items = pa.concat_tables([open_line, items.select(open_line.schema.names)])
        items = items.combine_chunks()
        text = pc.fill_null(items["text"].combine_chunks(), "")
        blank = pc.equal(pc.utf8_trim(text, T.SPACES), "").to_numpy(zero_copy_only=False)
        boxed = np.logical_and.reduce([pc.is_valid(items[n]).to_numpy() for n in numbers])
        ends = items["has_eol"].to_numpy() & (blank | boxed)
        counted = np.flatnonzero(~blank & boxed)
        if not len(counted):
            continue
        codes = [items[n].combine_chunks().dictionary_encode("encode").indices.to_numpy()[counted] for n in keys]
        turns = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in codes])]) if keys else np.arange(len(counted)) == 0
        closings = np.concatenate([[0], np.cumsum(ends)])[:-1][counted]  # before each item
        starts = np.flatnonzero(turns | np.concatenate([[True], closings[1:] != closings[:-1]]))
        at = {n: items[n].to_numpy()[counted].astype(float) for n in numbers}
        text = text.take(pa.array(counted))
        new, gap = begun(starts, np.diff(np.append(starts, len(counted))), at["x0"], at["x1"], at["baseline"], at["height"], at["width"])
        spaced = pc.is_in(pc.utf8_slice_codeunits(text, -1), value_set=pa.array(list(T.SPACES))).to_numpy(zero_copy_only=False)
        gap[1:] &= ~spaced[:-1]
        lines = np.flatnonzero(new)
        last = np.append(lines[1:], len(counted)) - 1
        pieces = pc.binary_join_element_wise(pa.array(np.where(gap, " ", "")), text, "")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(lines, len(counted)).astype(np.int32)), pieces), "")
        box = [np.where(np.isnan(at[n][lines]), at[n][lines], f.reduceat(at[n], lines)) for n, f in (("x0", np.fmin), ("y0", np.fmin), ("x1", np.fmax), ("y1", np.fmax))]
        heads = items.take(pa.array(counted[lines]))
        here = tuple(heads[n][0].as_py() for n in keys)
        # the lines' numbers in their page
        page = np.flatnonzero(turns[lines])
        no = np.arange(len(lines)) - np.repeat(page, np.diff(np.append(page, len(lines))))
        no[: page[1] if len(page) > 1 else len(lines)] += lines_before if here == place else 0
        columns = [*(heads[n].combine_chunks() for n in keys), no, heads["first_item"].combine_chunks(), items["item_no"].to_numpy()[counted[last]], np.add.reduceat(items["n_items"].to_numpy()[counted], lines), joined, *box, at["baseline"][lines]]
        found = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        place = tuple(heads[n][len(lines) - 1].as_py() for n in keys)
        stays = not ends[counted[-1] :].any()
        lines_before = int(no[-1]) + (not stays)
        open_line = None
        if stays:
            found, rest = found.slice(0, len(lines) - 1), found.slice(len(lines) - 1)
            names = [{"last_item": "item_no"}.get(n, n) for n in schema.names]
            open_line = pa.Table.from_arrays([*rest.columns, *(pa.array([v]) for v in (0.0, 0.0, False))], [*names, "height", "width", "has_eol"]).drop_columns(["line_no"])
        yield found
    if open_line is not None:
        rest = open_line.append_column("last_item", open_line["item_no"]).append_column("line_no", pa.array([lines_before]))
        yield pa.RecordBatch.from_arrays([rest[n].combine_chunks() for n in schema.names], schema=schema)


def assemble_lines(items: DataFrame, keys: Sequence[str] = ("doc_id", "page"), stretch: int = STRETCH, in_order: bool = False) -> DataFrame:
    """(keys, line_no, text, first_item, last_item, n_items, box, baseline): a page's items as its lines.

    items: keys, item_no, text, x0, y0, x1, y1 in shares of the page, baseline, height and width, the
    page's, in one unit, has_eol. In the items' order an item joins the open line if its baseline is
    within a quarter of its height of that of the line's first item, it begins at most .005 left of the
    line's box, and the gap to the box's right end is under three heights; a gap of over .15 heights
    gives a space unless one is there. An item that ends a line closes it. Blank items have no text but
    may close a line; items without a box are passed over, and close nothing.

    in_order: the items of a page already follow each other in one partition by item_no, as those do
    that are exploded from one row; then nothing is dealt or sorted. Otherwise a page is one sorted
    pass, and one of more than `stretch` items is dealt over tasks where a line ends: the last end of
    each stretch, one row per stretch, says where the next begins. Columns besides these are dropped;
    items without a number have no place and go.
    """
    keys, columns = list(keys), ["item_no", "text", "x0", "y0", "x1", "y1", "baseline", "height", "width"]
    numbers = [F.col(c).cast("double").alias(c) for c in columns[2:]]
    rows = items.select(*keys, F.col("item_no").cast("long").alias("item_no"), F.col("text").cast("string").alias("text"), *numbers, F.coalesce("has_eol", F.lit(False)).alias("has_eol"))
    rows = rows.where("item_no is not null")

    def put_together(dealt: DataFrame, by: list[str]) -> DataFrame:
        schema = StructType([*dealt.select(*by).schema.fields, *_parse_datatype_string(LINE).fields])
        return dealt.select(*by, *columns, "has_eol").mapInArrow(joined_items, schema)

    line = ["line_no", "text", "first_item", "last_item", "n_items", "x0", "y0", "x1", "y1", "baseline"]
    if in_order:
        return put_together(rows, keys).select(*keys, *line)
    far = rows.where(F.col("item_no") >= stretch)
    large = durable(far.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct())
    if large.isEmpty():
        return put_together(rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "item_no"), keys).select(*keys, *line)
    box = reduce(and_, [F.col(c).isNotNull() for c in columns[2:]])
    ends = F.col("has_eol") & ((F.btrim(F.coalesce("text", F.lit("")), F.lit(T.SPACES)) == "") | box)
    part = F.floor(F.col("item_no") / stretch)
    near = rows.where(F.col("item_no") < stretch).withColumn("owner", F.lit(0).cast("long"))
    # beyond the first stretch: the stretch of the last end before an item
    far = far.withColumn("_part", part)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    closed = rows.where(ends).join(large, same, "left_semi").groupBy(*keys, part.alias("_part")).agg(F.min("item_no").alias("_first"))
    parts = far.select(*keys, "_part", F.lit(None).cast("long").alias("_first")).distinct().unionByName(closed).groupBy(*keys, "_part").agg(F.min("_first").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_first").isNotNull(), F.col("_part")), ignorenulls=True).over(before)
    known = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_own"), "_first", last.alias("_before"))
    owner = F.when(F.col("item_no") > F.col("_first"), F.col("_part")).otherwise(F.coalesce("_before", F.lit(0).cast("long")))
    later = far.join(known, same & (F.col("_part") == F.col("_own"))).withColumn("owner", owner).select(*rows.columns, "owner")
    dealt = near.unionByName(later).repartition(F.xxhash64(*keys, "owner")).sortWithinPartitions(*keys, "owner", "item_no")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first_item")) - 1
    return put_together(dealt, [*keys, "owner"]).withColumn("line_no", place.cast("long")).select(*keys, *line)


def merge_rects(rects: DataFrame, keys: Sequence[str], top: float = 0.006, bottom: float = 0.01, gap: float = 0.012) -> DataFrame:
    """Selected rectangles put together along a line, in their order: one sorted pass per key that keeps
    the open rectangle only.

    rects: keys, seq, x0, y0, x1, y1. A rectangle extends the last one if tops, bottoms and the gap
    are within the limits; only x1 grows. Rectangles with a null corner are passed over.
    """
    keys = list(keys)
    n = len(keys)
    corners = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = rects.select(*keys, "seq", *corners).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")

    def step(state: list, row: tuple) -> list[tuple]:
        x0, y0, x1, y1 = row[n + 1 :]
        last = state[1:]
        if last and abs(last[1] - y0) < top and abs(last[3] - y1) < bottom and x0 <= last[2] + gap:
            state[3] = max(last[2], x1)
            return []
        state[:] = [state[0] + 1 if state else 0, x0, y0, x1, y1]
        return [(state[0] - 1, *last)] if last else []

    kinds = _parse_datatype_string("rect_no long, x0 double, y0 double, x1 double, y1 double").fields
    out = StructType([*rows.select(*keys).schema.fields, *kinds])
    return sorted_pass(rows, keys, ["seq", "x0", "y0", "x1", "y1"], out, list, step, lambda state: [tuple(state)])


def bounds(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the smallest rectangle round all of each key."""
    return rects.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Marks of a page up to which points are compared with all of them.
FEW_MARKS = 256
#: A page of more has about so many marks per cell, and so many cells to each side at most, a power of two.
CELL_MARKS, CELLS = 16, 64


def topmost_at(points: DataFrame, marks: DataFrame, page: str = "page", few: int = FEW_MARKS) -> DataFrame:
    """(point_id, mark_id): the mark drawn last that holds each point, null if none does.

    points: point_id, page, x, y. marks: mark_id, page, seq, x0, y0, x1, y1. Points and marks meet by
    page where no page has over `few` marks. Else a page is a grid, finer the more marks it has: marks
    are dealt to the cells that they reach, points to the one that they are in, and meet by page and
    cell. Of the marks that fill a cell only the last one drawn is left, by partial aggregation, so a
    page of many large marks costs what its edges do. A ring of outer cells takes what is beyond the
    page. Of marks of one seq that of the largest mark_id counts; null corners and places hold nothing.
    """
    box = ["seq", "mark_id", "x0", "y0", "x1", "y1"]
    sound = marks.where("x0 <= x1 and y0 <= y1").select(F.col(page).alias("_page"), *box)
    placed = points.select("point_id", page, "x", "y")
    sizes = sound.groupBy("_page").agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    meets = (F.col(page) == F.col("_page")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    held = sound
    if largest > few:
        finer = F.ceil(F.log2(F.sqrt(F.col("_n") / CELL_MARKS)))
        grids = sizes.select(F.col("_page").alias("_grid"), F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(int(log2(CELLS))), finer))).cast("int").alias("_cells"))

        def cell(v: Column) -> Column:
            return F.greatest(F.lit(-1), F.least(F.col("_cells"), F.floor(v * F.col("_cells")))).cast("int")

        dealt = sound.join(grids, F.col("_page") == F.col("_grid"))
        for c in "xy":
            dealt = dealt.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"{c}0")), cell(F.col(f"{c}1")))))
        inner = F.col("_cx").between(0, F.col("_cells") - 1) & F.col("_cy").between(0, F.col("_cells") - 1)
        filled = inner & reduce(and_, [(F.col(f"{c}0") * F.col("_cells") <= F.col(f"_c{c}")) & (F.col(f"{c}1") * F.col("_cells") >= F.col(f"_c{c}") + 1) for c in "xy"])
        full = dealt.where(filled).groupBy("_page", "_cx", "_cy").agg(F.max(F.struct(*box)).alias("m")).select("_page", "_cx", "_cy", "m.*")
        held = full.unionByName(dealt.where(~filled).select("_page", "_cx", "_cy", *box))
        placed = placed.join(grids, F.col(page) == F.col("_grid"), "left").withColumns({"_px": cell(F.col("x")), "_py": cell(F.col("y"))})
        meets = meets & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
    hits = placed.join(held, meets, "left")
    return hits.groupBy("point_id").agg(F.max(F.when(F.col("seq").isNotNull(), F.struct("seq", "mark_id"))).alias("m")).select("point_id", "m.mark_id")


def last_before(events: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """events with the value of the last mark at or before them, per key: an as-of join by one window
    over the union, so that neither side is held in memory."""
    both = events.select(key, at, "event_id", F.lit(None).cast(marks.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(
        marks.select(key, at, F.lit(None).cast("long").alias("event_id"), value, F.lit(0).alias("side"))
    )
    order = Window.partitionBy(key).orderBy(at, "side", value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last(value, ignorenulls=True).over(order)).where("side = 1").select("event_id", key, F.col("found").alias(value))
