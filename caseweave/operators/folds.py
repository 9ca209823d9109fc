"""Folds over the sorted rows of each key: one pass, with a state that doesn't grow with the key."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a key up to which it is one pass of one task; keys of more are cut, see the callers.
TARGET = 20_000


def sorted_pass(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: StructType, start: Callable[[], Any], step: Callable[[Any, tuple], Iterable[tuple]], end: Callable[[Any], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """What step yields for each row of a key in order, and end after its last; out is their schema.

    Rows are tuples in the order of their columns, which begin with `by`; what is yielded begins with
    the columns of out that follow `by`, which are put before it. Null keys are keys.

    Rows are dealt by a hash of the key and not by the key: where rows are a union, adaptive execution
    otherwise takes its sides to be dealt by the key already, though they aren't dealt alike.
    """
    n, arrow = len(by), to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: Any = None

        def packed(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    if key is not None:
                        done += [key + x for x in end(state)]
                    key, state = row[:n], start()
                done += [key + x for x in step(state, row)]
            yield packed(done)
        if key is not None:
            yield packed([key + x for x in end(state)])

    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, out)


class Disjoint:
    """Spans none of which overlaps another, sorted: a new one meets one of them at most by a search."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.spans, (end,)) - 1  # the last that begins before the end
        return at >= 0 and self.spans[at][1] > start

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))

    def cover(self, start: int, end: int) -> None:
        """Add a span that may overlap others: what it overlaps becomes one span with it."""
        at = bisect_left(self.spans, (end,))
        low = at
        while low and self.spans[low - 1][1] > start:
            low -= 1
        if low < at:
            start, end = min(start, self.spans[low][0]), max(end, self.spans[at - 1][1])
        self.spans[low:at] = [(start, end)]
