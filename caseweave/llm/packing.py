"""Packing token streams into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WIDE_BYTES, id_and_text, slices
from .tokens import REMEMBERED, encoder

#: Tokens of the stream that one dynamic programme sees; its last window opens the next one.
BLOCK = 1 << 20

PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def choose_cuts(size: int, tiers: list[tuple[float, list[int]]], anywhere: float, window: int) -> list[int]:
    """The places from 1 to size to cut at, size included.

    tiers: penalties in ascending order, each with its places in ascending order; a cut at any other
    place costs anywhere, which is the highest. Size itself is free.

    Cost of a window: its padding and the penalty of the place where it ends. With cost(i) the least
    cost of all up to place i, cost(i) = penalty(i) + window - i + min(cost(j) + j) over the j at most
    a window before; the minimum is the head of a monotone queue of cost(j) + j.

    Places that have the same head differ by their penalties only, so of those of one penalty the last
    outlives and equals the others: it alone enters the queue. Every place counts, but the work is a
    few steps per head.
    """
    back: dict[int, int] = {}
    queue = deque([(0, 0.0)])
    offered = 0  # the places up to here
    while True:
        head, least = queue.popleft()
        reach = head + window
        if reach >= size:
            back[size] = head
            break
        for penalty, places in [*tiers, (anywhere, None)]:
            place = reach if places is None else places[k - 1] if (k := bisect_right(places, reach)) else 0
            if place > offered:  # else a cheaper and later one is in
                value = least + penalty + window
                while queue and queue[-1][1] >= value:
                    queue.pop()
                queue.append((place, value))
                back[place] = head
                offered = place
    cuts, i = [], size
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


class Stream:
    """Documents of one partition in their order, cut into windows as blocks of them are complete.

    ends: the ids that may end a sentence; opens: those that begin a word or are no part of one. A
    sentence ends between the two.
    """

    def __init__(self, ends: np.ndarray, opens: np.ndarray, window: int, sentence_penalty: float, token_penalty: float, first_sequence: int):
        self.ends, self.opens, self.window = ends, opens, window
        self.sentence_penalty, self.token_penalty = sentence_penalty, token_penalty
        self.sequence = first_sequence
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, place of its first token, tokens
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((doc_id, self.size, len(ids)))
        self.size += len(ids)

    def places(self, ids: np.ndarray) -> list[tuple[float, list[int]]]:
        """The ends of documents and of sentences, with their penalties."""
        sentences = np.flatnonzero(self.ends[ids[:-1]] & self.opens[ids[1:]]) + 1
        return [(0.0, [s + n for _, s, n in self.docs]), (self.sentence_penalty, sentences.tolist())]

    def cut(self, last: bool) -> pa.RecordBatch | None:
        """Rows of the windows that are settled: all at the end, else all but the last one."""
        if not self.size:
            return None
        ids = np.concatenate(self.parts)
        cuts = np.array(choose_cuts(len(ids), self.places(ids), self.token_penalty, self.window))
        if not last:
            cuts = cuts[:-1]
        if not len(cuts):
            self.parts = [ids]
            return None
        done = int(cuts[-1])
        begins = np.array([s for _, s, _ in self.docs])
        edges = np.unique(np.concatenate([[0], begins[(begins > 0) & (begins < done)], cuts]))
        start, length = edges[:-1], np.diff(edges)
        doc = np.searchsorted(begins, start, side="right") - 1
        window = np.searchsorted(cuts, start, side="right")
        window_start = np.concatenate([[0], cuts[:-1]])[window]
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), length.tolist())]
        rows = [
            pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
            *(pa.array(x, pa.int64()) for x in (start - begins[doc], length, crc, np.array([n for _, _, n in self.docs])[doc], self.sequence + window, start - window_start)),
        ]
        self.sequence += len(cuts)
        self.parts = [ids[done:]]
        self.docs = [(k, s - done, n) for k, s, n in self.docs if s + n > done]
        self.size -= done
        return pa.RecordBatch.from_arrays(rows, schema=PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = 1024, sentence_penalty: float = 2.0, token_penalty: float = 6.0, kept: int | None = None, batch_bytes: int = WIDE_BYTES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document is its ids by the vocabulary file of the tokenizers library and end_id. The documents
    of an input partition are one stream in their order; it is cut into windows so that padding plus
    penalties are least. A cut at a document's end is free, one at a sentence's end costs
    sentence_penalty tokens, one at any other token token_penalty, which is the highest of the three.
    Every id lies in exactly one piece.

    There is no shuffle: partitions are packed by themselves, and a sequence id holds its partition's
    number above 40 bits. Each partition's last window may be short.

    kept: how many pieces of text a worker remembers, if not tokens.REMEMBERED. Where other stages run
    in the same application, an idle worker's memory stands beside theirs, and few are better.
    batch_bytes: text that is encoded at once; a piece that isn't remembered is encoded once per batch.

    A null or empty text is the end_id alone. Repeated rows are packed as often as they come, rows
    without an id keep a null id, and an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        encode.remembered = REMEMBERED if kept is None else kept
        names = [encode.tokenizer.id_to_token(i) or "" for i in range(encode.tokenizer.get_vocab_size())]
        ends = np.array([n.rstrip("\"')").endswith((".", "!", "?", "Ċ")) for n in names])
        opens = np.array([i == end_id or n.startswith(("Ġ", "Ċ", "ĉ", "č")) for i, n in enumerate(names)])
        context = TaskContext.get()
        stream = Stream(ends, opens, window, sentence_penalty, token_penalty, (context.partitionId() if context else 0) << 40)
        end = np.array([end_id], "<u4")
        for whole in batches:
            for batch in slices(whole, size=batch_bytes):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                    stream.add(doc_id, np.concatenate([ids, end]))
                    if stream.size >= BLOCK and (rows := stream.cut(last=False)):
                        yield rows
        if rows := stream.cut(last=True):
            yield rows
        encode.end_of_task(kept)

    return id_and_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in PIECES.names))
