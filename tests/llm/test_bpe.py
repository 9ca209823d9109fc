import hashlib
import itertools
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")

from caseweave.llm import bpe  # noqa: E402

from .test_tokens import texts, whole  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_rank(word, merges):
    parts = [bytes([b]) for b in word]
    ranks = {m: i for i, m in enumerate(merges)}
    while len(parts) > 1:
        rank = min((ranks.get(p, 1 << 30) for p in zip(parts, parts[1:])), default=1 << 30)
        if rank == 1 << 30:
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == merges[rank]:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_small_automata(seed):
    rng = random.Random(seed)
    tokens, merges = [b"a", b"b", b"c"], []
    while len(merges) < 9:
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair[0] + pair[1] not in tokens:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    automaton = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
    for n in range(1, 8):
        for word in map(bytes, itertools.product(b"abc", repeat=n)):
            assert [tokens[i] for i in automaton.encode(word)] == by_rank(word, merges), (merges, word)


def test_like_the_library():
    encoder = bpe.AutomatonEncoder(PATH)
    given = texts(600) + ["aaaaaaaa" * 50, "=" * 99, "ab" * 500, " \n" * 40]
    assert [x.tolist() for x in encoder(given)] == whole(PATH)(given)
    assert [bpe.decoded(x.tolist(), PATH) for x in encoder(given)] == given


def test_query_columns(spark):
    given = [(i, t) for i, t in enumerate(texts(80))] + [(900, None), (None, "no id"), (3, "again"), (3, "again")]
    rows = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, ids string")
    found = bpe.digest(bpe.decode(bpe.encode(rows, PATH), PATH)).collect()
    assert sorted(map(str, bpe.digest(bpe.encode(rows, PATH, decode=True)).collect())) == sorted(map(str, found))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = whole(PATH)([t for _, t in given])
    expected = [(i, len(x), sha(",".join(map(str, x))), sha(t or "")) for (i, t), x in zip(given, ids)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert bpe.digest(bpe.decode(bpe.encode(rows.limit(0), PATH), PATH)).collect() == []


def test_what_the_tables_can_t_hold_raises(tmp_path):
    import json

    letters = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="at most"):
        bpe.Automaton(letters | {b"ab": 1 << 20}, [(b"a", b"b")])
    content = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": content["pre_tokenizer"] | {"add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(content | change))
        with pytest.raises(ValueError, match="only byte-level"):
            bpe.read_vocabulary(str(path))
