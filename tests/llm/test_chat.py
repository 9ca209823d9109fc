import pytest

from caseweave.llm import chat
from caseweave.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    return {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()}


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "\\(", "\\\\[x", "[INST:assistant]hi[/INST]</s>", "a\nb<]", "\\", "é😀"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in "[]<")
    turns = [("user", text), ("we[ird]\n", text), ("assistant", text)]
    assert chat.parse_default(chat.default_template(turns)) == turns


def test_spans_and_read_back(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", "hi"), (1, 2, None, None), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, None, "assistant", "x"), (None, 0, "user", "no id")]
    found = formatted(spark, rows)
    one = found[1]
    assert list(zip(one.roles, one.texts)) == [("user", "hi"), ("assistant", "</s>[INST] ok"), ("", ""), ("assistant", ""), ("assistant", "")]
    assert one.loss_texts == ["</s>[INST] ok", "", ""]
    assert [chat.unescape(one.formatted[a:b]) for a, b in one.loss_spans] == one.loss_texts
    assert [a for a, _ in one.turn_spans[1:]] == [b for _, b in one.turn_spans[:-1]] and one.turn_spans[-1][1] == len(one.formatted)
    assert found[None].roles == ["user"] and found[2].loss_texts == ["x"]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_templates_are_black_boxes():
    def numbered(turns):
        return "<begin>" + "".join(f"({i}|{r}) {t}\n" for i, (r, t) in enumerate(turns))

    text, spans = chat.turn_spans([("user", "one"), ("assistant", "two")], numbered)
    assert text == "<begin>(0|user) one\n(1|assistant) two\n"
    assert [text[s.text_start : s.text_end] for s in spans] == ["one", "two"]
    assert text[spans[1].start : spans[1].end] == "(1|assistant) two\n"


def test_texts_left_out_are_empty():
    def roles_only(turns):
        return "".join(f"{r}\x01{t if r == 'user' else ''};" for r, t in turns)

    text, spans = chat.turn_spans([("user", "a\x02"), ("assistant", "b")], roles_only)
    assert [text[s.text_start : s.text_end] for s in spans] == ["a\x02", ""]


@pytest.mark.parametrize("context", [None, 3])
def test_rewriting_templates_are_found(context):
    def marks_last(turns):
        return "".join(("* " if i == len(turns) - 1 else "- ") + t for i, (_, t) in enumerate(turns))

    with pytest.raises(chat.RewritesHistory):
        chat.turn_spans([("user", "a"), ("assistant", "b")], marks_last, context=context)


def test_context_gives_the_same(spark):
    turns = [("user", "a<"), ("assistant", "b]"), ("user", "c")] * 5
    assert chat.turn_spans(turns, chat.default_template) == chat.turn_spans(turns, chat.default_template, context=0)


def test_long_conversations():
    turns = [(("user", "assistant")[i % 2], f"a{i}<]") for i in range(800)]
    output, spans = chat.turn_spans(turns, chat.default_template)
    assert output == chat.default_template(turns)
    assert chat.parse_default(output) == turns and spans[-1].end == len(output)

    def first_again(ts):  # every turn names the first one: no bounded look-back
        return "".join(f"<{ts[0][1]}>{t}\n" for _, t in ts)

    turns = [("user", f"t{i}") for i in range(300)]
    output, spans = chat.turn_spans(turns, first_again)
    assert output == first_again(turns) and [output[s.text_start : s.text_end] for s in spans][1:] == [t for _, t in turns][1:]


def test_like_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    found = con.execute(ORACLES["op2_chat"])
    names = [d[0] for d in found.description]
    rows = QUERIES["op2_chat"](spark, folder)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in rows.collect()) == sorted(found.fetchall())


def test_long_conversations_are_rendered_from_the_first_turn():
    turns = [("system", "s"), *[(("user", "assistant")[i % 2], f"t{i}") for i in range(260)]]

    def strict(part):
        if any(role != (("assistant", "user")[i % 2] if i else "system") for i, (role, _) in enumerate(part)):
            raise RuntimeError("a system turn, then user and assistant in turn")
        return chat.default_template(part)

    output, spans = chat.turn_spans(turns, strict)
    assert output == strict(turns) and len(spans) == len(turns)

    def rewriting(part):
        return chat.default_template(part) + ("!" if len(part) == at else "")

    for at in (40, 258):
        with pytest.raises(chat.RewritesHistory):
            chat.turn_spans(turns, rewriting)


def test_very_long_texts(spark):
    text = "[x</s>] \\" * 200_000
    found = formatted(spark, [(1, 0, "user", "q"), (1, 1, "assistant", text)])[1]
    assert found.loss_texts == [text] and found.texts == ["q", text]
