"""Byte-pair encoding by a tokenization automaton built from merge gadgets, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices
from .tokens import PieceEncoder, byte_characters

#: Fixed value: the published pre-splitting pattern of byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: What a worker remembers at most: pieces, words besides them, and transitions written out.
REMEMBERED, REMEMBERED_WORDS, WRITTEN = 300_000, 100_000, 600_000


class Automaton:
    """The deterministic automaton over tokens that accepts the correct tokenizations and no others.

    It starts as one state with an arc to itself for each byte. The merges are put in in their order.
    The gadget of a merge of u and v: the state after u gets a copy without the arc v, to which all
    arcs u now lead, and every state that had u followed by v gets an arc uv, to where v led before.
    As all arcs of a label lead to one state, states are named by tokens. A merge whose two arcs are
    never in a row makes no arc; its token is dead and so is what would be made of it.

    The table of transitions is kept in factors, since written out it would have an entry for nearly
    every pair of tokens. A state was copied from that of its right half, as that was when the token was
    made, and so on down to a byte: its line of copies, each with the merge up to which removals were
    inherited. An arc was made from that of its left half: its line of makings, each with the merge up
    to which it had to be there. A state lacks an arc if a merge of one of its line with one of the
    arc's line removed it in time. The first WRITTEN transitions that are met are written out and stay.

    Bytes are read by a second table, that of the labels' prefixes with links to the longest suffix of
    each that is one too; so it is known at every byte which labels end there.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocabulary.values()) + 1
        if size > 1 << 20:
            raise ValueError(f"{size} tokens: transitions are numbered for at most {1 << 20}")
        never = len(merges)
        self.removed: dict[int, int] = {}  # state << 20 | token: the merge that removed the arc
        self.copies: list[tuple] = [()] * size  # of a state: (state << 20, removals inherited before)
        self.makings: list[tuple] = [()] * size  # of a token: (token, removals that count up to)
        arcs = {bytes([b]): vocabulary[bytes([b])] for b in range(256) if bytes([b]) in vocabulary}
        for t in arcs.values():
            self.copies[t], self.makings[t] = ((t << 20, never),), ((t, never),)
        for rank, (u, v) in enumerate(merges):
            a, b, c = vocabulary[u], vocabulary[v], vocabulary[u + v]
            if self.makings[a] and self.makings[b] and not self.makings[c] and self.has_arc(a, b, rank - 1):
                self.copies[c] = ((c << 20, never), *((s, min(r, rank)) for s, r in self.copies[b]))
                self.makings[c] = ((c, never), *((t, min(r, rank)) for t, r in self.makings[a]))
                arcs[u + v] = c
            self.removed.setdefault(a << 20 | b, rank)
        self.whole, self.sizes = arcs, [0] * size
        self.written: dict[int, bool] = {}
        self.compile(arcs)

    def has_arc(self, state: int, token: int, until: int = 1 << 30) -> bool:
        """Whether the state has an arc of the token, after the merges up to that one."""
        removed = self.removed.get
        for t, made in self.makings[token]:
            for s, copied in self.copies[state]:
                rank = removed(s | t)
                if rank is not None and rank <= made and rank <= until and rank < copied:
                    return False
        return True

    def compile(self, arcs: dict[bytes, int]) -> None:
        """The table by which bytes are read: per prefix its successors, the arcs whose labels end
        there, the longest first, and where to go on when a byte doesn't fit."""
        prefixes: dict[int, int] = {}  # prefix << 8 | byte: prefix
        own, parents = [-1], [(0, 0)]
        for label, token in arcs.items():
            self.sizes[token], node = len(label), 0
            for byte in label:
                node = prefixes.setdefault(node << 8 | byte, len(own))
                if node == len(own):
                    own.append(-1)
                    parents.append((0, 0))
            own[node] = token
        for key, node in prefixes.items():
            parents[node] = key >> 8, key & 255
        depth = [0] * len(own)
        for node in range(1, len(own)):  # a prefix has a greater number than what it continues
            depth[node] = depth[parents[node][0]] + 1
        back = [0] * len(own)
        ending: list[tuple[int, ...]] = [()] * len(own)
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, byte = parents[node]
            if parent:
                at = back[parent]
                while at and at << 8 | byte not in prefixes:
                    at = back[at]
                back[node] = prefixes.get(at << 8 | byte, 0)
            ending[node] = ((own[node],) if own[node] >= 0 else ()) + ending[back[node]]
        self.prefixes, self.back, self.ending = prefixes, back, ending

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one accepted path that spells the word.

        Every prefix of the word has one accepted path, so its last arc is found from those of the
        shorter prefixes: of the labels that end at a byte it is the one whose arc the state before its
        begin has. There is no going back.
        """
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        prefixes, back, ending, sizes, written = self.prefixes.get, self.back, self.ending, self.sizes, self.written.get
        last, node = [-1], 0
        for i, byte in enumerate(word, 1):
            found = prefixes(node << 8 | byte)
            while found is None and node:
                node = back[node]
                found = prefixes(node << 8 | byte)
            node = found or 0
            for token in ending[node]:
                before = last[i - sizes[token]]
                if before >= 0:
                    leads = written(before << 20 | token)
                    if leads is None:
                        leads = self.has_arc(before, token)
                        if len(self.written) < WRITTEN:
                            self.written[before << 20 | token] = leads
                    if not leads:
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no tokenization of {word!r}")
        path, i = [], len(word)
        while i:
            path.append(last[i])
            i -= sizes[last[i]]
        return path[::-1]


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """(tokens, merges, special tokens) of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as source:
        content = json.load(source)
    to_byte = byte_characters()
    spelt = lambda token: bytes(to_byte[c] for c in token)
    model, splits = content["model"], str(content.get("pre_tokenizer"))
    if content.get("normalizer") or "ByteLevel" not in splits or "'add_prefix_space': True" in splits or "Regex" in splits:
        raise ValueError(f"{path}: only byte-level vocabularies with the published pre-splitting and no normaliser")
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    tokens = {spelt(t): i for t, i in model["vocab"].items() if t not in special}
    return tokens, [(spelt(a), spelt(b)) for a, b in pairs], special


class AutomatonEncoder(PieceEncoder):
    """ids of texts by the automaton; every distinct piece is split into words and run once."""

    def __init__(self, path: str):
        tokens, merges, special = read_vocabulary(path)
        self.automaton = Automaton(tokens, merges)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.spaces, self.known, self.words, self.remembered = True, {}, {}, REMEMBERED

    def learn(self, pieces: list[str]) -> None:
        words, encode = self.words, self.automaton.encode
        for piece in pieces:
            ids = array("I")
            for i, part in enumerate(self.cut.split(piece) if self.cut else [piece]):
                if i % 2:
                    ids.append(self.special[part])
                    continue
                for word in WORDS.findall(part):
                    found = words.get(word)
                    if found is None:
                        found = array("I", encode(word.encode()))
                        if len(words) < REMEMBERED_WORDS:
                            words[word] = found
                    ids += found
            self.known[piece] = ids.tobytes()


@lru_cache(maxsize=2)
def automaton_encoder(path: str) -> AutomatonEncoder:
    """The worker's automaton of this file; it stays for the tasks that the worker runs later."""
    return AutomatonEncoder(path)


@lru_cache(maxsize=2)
def labels(path: str) -> list[bytes]:
    """The label of each arc, by its id: the bytes of a token, the text of a special one."""
    tokens, _, special = read_vocabulary(path)
    named = {i: label for label, i in tokens.items()} | {i: text.encode() for text, i in special.items()}
    return [named.get(i, b"") for i in range(max(named) + 1)]


def decoded(ids: list[int], path: str) -> str:
    return b"".join(map(labels(path).__getitem__, ids)).decode("utf-8", "replace")


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)))


def encode(docs: DataFrame, vocabulary: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as the tokenizers library gives them.

    decode: also decoded, the text that the ids spell, in the same pass over the texts.
    A null or empty text has no ids. Repeated rows and rows without an id are encoded like any other;
    an empty table gives an empty result. There is no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = automaton_encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ids = encoder(batch.column("text").to_pylist())
                out = {"doc_id": batch.column("doc_id"), "ids": lists(ids)}
                if decode:
                    out["decoded"] = pa.array([decoded(x.tolist(), vocabulary) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])
        encoder.end_of_task()

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded with a column decoded: the labels of the arcs of ids, special tokens included.

    Bytes that aren't UTF-8 become replacement characters. Null ids are decoded as none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = part.column("ids")
                flat, at = found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy()
                texts = [decoded(flat[a:b].tolist(), vocabulary) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decode(encode(...)), or of encode with decode."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
