"""Encoding whole texts with the tokenizers library, each distinct piece of text once per worker.

A text is cut only where the tokenizer's own pre-splitting always cuts, so the ids of the pieces in
a row are the ids of the text; the tests hold this against encoding the text as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

#: The characters with Unicode's White_Space property, as a regex class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A piece is a word with the white space before it. In the byte-level patterns white space is a
#: token's beginning or a token by itself, hence a cut before a run of it is always one of theirs.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Where a text isn't just words with single spaces and line feeds before them.
UNEVEN = r"[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]|[ \n][ \n]"

#: Latin letters that stay one letter each in lower case.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A letter, a stop and then white space: pre-splitting always cuts before that stop.
STOP = f"([{LATIN}])([.,])"
#: A piece that is one pre-split word.
WORD = re.compile(f" ?[{LATIN}]+")
#: Words on which the two ways to encode a word are compared before the shorter one is used.
PROBES = ["the", "Word", "élan", "Straße", "tokenization", "ÀÇÉ", "a"]

#: Distinct pieces that a worker remembers, the first that it meets; the others it encodes once per
#: call.
REMEMBERED = 800_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: the printable ones of
    Latin-1 for themselves, the others by the code points from 256 on in ascending order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


BYTE_LEVEL = {b: c for c, b in byte_characters().items()}


class PieceEncoder:
    """ids of texts by one vocabulary file; keeps the ids of pieces it has met."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaces, self.remembered = spaces, REMEMBERED
        self.known: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        probes = [s + p for p in PROBES for s in (["", " "] if spaces else [""])]
        self.short = [self.word(p) for p in probes] == [e.ids for e in self.tokenizer.encode_batch(probes, add_special_tokens=False)]

    def word(self, piece: str) -> list[int]:
        """The ids of one pre-split word, straight from the tokenizer's model."""
        return [t.id for t in self.tokenize((piece if self.spaces else piece.lower()).encode().decode("latin-1").translate(BYTE_LEVEL))]

    def end_of_task(self, kept: int | None = None) -> None:
        """Keep the first so many pieces, or all, for the worker's later tasks."""
        if kept is not None and len(self.known) > kept:
            self.known = dict(islice(self.known.items(), kept))
        release()

    def learn(self, pieces: list[str]) -> None:
        if self.short:
            words = set(filter(WORD.fullmatch, pieces))
            self.known.update((p, array("I", self.word(p)).tobytes()) for p in words)
            pieces = [p for p in pieces if p not in words]
        for i in range(0, len(pieces), 20000):
            part = pieces[i : i + 20000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(part, encoded))

    def ids_of(self, pieces: pa.ListArray) -> list[np.ndarray]:
        """The ids of each list of pieces."""
        flat = pieces.flatten().dictionary_encode()
        distinct, which = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        raw = list(map(self.known.get, distinct))
        if None in raw:
            new = [p for p, r in zip(distinct, raw) if r is None]
            self.learn(new)
            raw = list(map(self.known.get, distinct))
            for p in new[max(0, self.remembered - len(self.known) + len(new)) :]:
                del self.known[p]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(raw), "<u4")[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + n, n)]
        at = np.concatenate([[0], ends])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; null is the empty text."""
        texts = [t or "" for t in texts]
        if not self.spaces:
            words = pc.replace_substring_regex(pa.array(texts, pa.string()), STOP + "([ \\n])", r"\1 \2\3")
            return self.ids_of(pc.split_pattern(pc.replace_substring(words, "\n", " "), " "))
        uneven = pc.match_substring_regex(pa.array(texts, pa.string()), UNEVEN).to_pylist()
        even = pa.array(["" if u else t for t, u in zip(texts, uneven)], pa.string())
        for space in (" ", "\n"):
            even = pc.replace_substring(even, space, "\0" + space)
        even = pc.replace_substring_regex(even, STOP + "\\x00", "\\1\0\\2\0")
        out = self.ids_of(pc.split_pattern(even, "\0"))
        odd = [i for i, u in enumerate(uneven) if u]
        for i, ids in zip(odd, self.ids_of(pa.array([PIECE.findall(texts[i]) for i in odd], pa.list_(pa.string())))):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, spaces: bool = True) -> PieceEncoder:
    """The worker's encoder of this file; it stays for the tasks that the worker runs later, each of
    which calls end_of_task.

    spaces: whether the vocabulary's tokens hold white space; if not, it is dropped.
    """
    return PieceEncoder(path, spaces)
