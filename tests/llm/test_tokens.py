import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from caseweave.llm import packing, tokenfile, tokens  # noqa: E402

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ODD = ["", " ", "  ", "\n\n a", "don't stop. I'll. we've", "a  b", "x\x1cy !\x1c z", "İ. İstanbul.", "é. a ́b", "éa.b,c;d", "tab\tand\x0bmore \r\n", "<|endoftext|> a<|endoftext|>b.<|endoftext|>", "日本語 テスト。1234 5.6", "a  b   c", "word́. x", "ɏabc.", "Straße. ß", "???!!! ...a", "'s 't '", "1st. 2nd,3", " x　y", "<|startoftext|>q", "x" * 5000, "ab " * 4000, "Ω. ΑΣ. ς"]


def texts(n=400):
    rng = random.Random(5)
    bits = ["the", "Word", " ", "  ", "\n", ".", ",", "é", "É", "ü", "n't", "'s", "1", "23", "!", "\t", " ", "日", "İ", "́", "<|endoftext|>", "_", "-", "😀", "\x1c", "а", "?"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def whole(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda xs: [e.ids for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_whole_text(name, monkeypatch):
    path, given = public_tokenizers.path(name), texts()
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    encode = tokens.PieceEncoder(path, FILES[name])
    for _ in range(2):
        assert [x.tolist() for x in encode(given)] == whole(path)(given)
        assert len(encode.known) <= 100


def rows(spark, given):
    return spark.createDataFrame([(i, t, -1, "x") for i, t in given], "doc_id long, text string, start int, part string")


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    given = list(enumerate([*texts(60), None, *(" ".join(rng.choice(["some", "words.", "and", "more"]) for _ in range(rng.randrange(1, 900))) for _ in range(80)), "y " * 6000]))
    given += [(given[-1][0], given[-1][1]), (None, "no id")]
    found = packing.pack(rows(spark, given).repartition(3), path).collect()
    by_id = {i: [*ids, 0] for (i, _), ids in zip(given, whole(path)([t for _, t in given]))}
    pieces: dict = {}
    for r in found:
        ids = by_id[r.doc_id]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids) and len(part) == r.length > 0
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, ids in by_id.items():
        times = sum(1 for k, _ in given if k == i)
        assert sorted(x for s, n in pieces[i] for x in range(s, s + n)) == sorted(list(range(len(ids))) * times)
    sequences: dict = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        fills.append(sum(n for _, n in parts))
    assert max(fills) <= 1024 and 1024 * len(fills) - sum(fills) < 3 * 1024 + 0.002 * sum(fills)  # three partitions end with a rest
    assert packing.pack(rows(spark, []), path).collect() == []


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(400):
        size, window = rng.randrange(1, 90), rng.randrange(1, 24)
        kinds = [rng.choice([0, 2, 2, 6, 6, 6, 6]) for _ in range(size)] + [0]
        cost = {0: 0.0}
        for p in range(1, size + 1):
            cost[p] = kinds[p] + min(cost[j] + window - (p - j) for j in range(max(0, p - window), p))
        tiers = [(0.0, [p for p in range(1, size + 1) if kinds[p] == 0]), (2.0, [p for p in range(1, size + 1) if kinds[p] == 2])]
        cuts = packing.choose_cuts(size, tiers, 6.0, window)
        assert cuts[-1] == size and all(0 < b - a <= window for a, b in zip([0, *cuts], cuts))
        assert sum(window - (b - a) + kinds[b] for a, b in zip([0, *cuts], cuts)) == pytest.approx(cost[size])


def test_sentences_end_before_a_word():
    stream = packing.Stream(np.array([False, True, False]), np.array([True, False, False]), 64, 2.0, 6.0, 0)
    stream.add(0, np.array([1, 1, 0, 2, 1, 0], "<u4"))
    assert stream.places(stream.parts[0]) == [(0.0, [6]), (2.0, [2, 5])]


def test_blocks_join(spark, monkeypatch):
    ends, opens = np.zeros(10, bool), np.ones(10, bool)
    ends[3] = True
    stream = packing.Stream(ends, opens, 64, 2.0, 6.0, 0)
    rng, total, got = np.random.default_rng(0), {}, []
    for i in range(50):
        ids = rng.integers(0, 10, rng.integers(1, 200)).astype("<u4")
        total[i] = ids
        stream.add(i, ids)
        if stream.size >= 100 and (b := stream.cut(False)):
            got += b.to_pylist()
    got += stream.cut(True).to_pylist()
    assert stream.cut(True) is None
    for i, ids in total.items():
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert [x for s, n in mine for x in range(s, s + n)] == list(range(len(ids)))


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    given = [(7 * i % 1009, t) for i, t in enumerate(texts(150))] + [(5000, None), (None, "no id"), (None, ""), (5000, None), (5, "one text"), (5, "another text of that id"), (5, "one text")]
    found = tokenfile.round_trip(rows(spark, given).repartition(5), path, folder=f"file://{tmp_path}/t").collect()
    expected, at = [], 0
    assert {r.doc_id for r in tokenfile.round_trip(rows(spark, given).repartition(2), path, folder=f"file://{tmp_path}/u").exceptAll(spark.createDataFrame(found)).collect()} == set()
    ids = {k: [*x, 2] for k, x in zip(given, whole(path)([t for _, t in given]))}
    place = {r.text: r.h for r in rows(spark, given).selectExpr("text", "xxhash64(text) AS h").collect()}
    for key in sorted(given, key=lambda k: (k[0] is not None, k[0] or 0, place[k[1]])):
        expected.append((key[0], at, len(ids[key]), zlib.crc32(np.array(ids[key], "<u4").tobytes())))
        at += len(ids[key])
    known = lambda xs: sorted(x for x in xs if x[0] is not None)
    assert known(map(tuple, found)) == known(expected)
    assert sorted(r.n_tokens for r in found if r.doc_id is None) == sorted(n for i, _, n, _ in expected if i is None)
    again = tokenfile.read(tokenfile.open_manifest(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}/t").collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert tokenfile.round_trip(rows(spark, []), path, folder=f"file://{tmp_path}/e").collect() == []
