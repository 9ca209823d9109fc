"""Chat formatting: a template is rendered as a black box on growing prefixes of a conversation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The control strings of the template below.
ROLE_OPEN, ROLE_CLOSE, TURN_END = "[INST:", "[/INST]", "</s>"

#: Code points to probe with: control characters, then the private-use planes.
PROBES = [*range(1, 9), *range(0xF0000, 0xFFFFE)]

Turn = tuple[str, str]
Renderer = Callable[[list[Turn]], str]


class RewritesHistory(ValueError):
    """A template whose output for a prefix isn't a prefix of its output for more turns."""


def escape(text: str) -> str:
    """Reversible, one code point more per character that could begin a control string."""
    return text.replace("\\", "\\\\").replace("[", "\\(").replace("]", "\\)").replace("<", "\\{")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"(": "[", ")": "]", "{": "<"}.get(m[1], m[1]), text, flags=re.S)


def default_template(turns: list[Turn]) -> str:
    """[INST:role]text[/INST]</s> per turn; roles and texts are escaped."""
    return "".join(f"{ROLE_OPEN}{escape(r)}]{escape(t)}{ROLE_CLOSE}{TURN_END}" for r, t in turns)


def parse_default(output: str) -> list[Turn]:
    """The turns of default_template's output."""
    return [(unescape(r), unescape(t)) for r, t in re.findall(r"\[INST:([^\]]*)\]([^\[]*)\[/INST\]</s>", output)]


@dataclass
class Span:
    """Where a turn and its text lie in the output, in code points."""

    role: str
    start: int
    end: int
    text_start: int
    text_end: int


def turn_spans(turns: list[Turn], render: Renderer, context: int | None = None) -> tuple[str, list[Span]]:
    """The output and the span of each turn, without any knowledge of the template.

    Prefixes of one turn, two turns and so on are rendered; what an output has beyond the one before
    is the turn's span. An output that doesn't begin with the one before means that the template
    rewrites history: RewritesHistory is raised. In a span, the text is what stands where a probe
    stands when the same turn is rendered with a probe for its text: a character that the output
    doesn't hold. A template that leaves a turn's text out has an empty text at the turn's end.

    context: prefixes are rendered from so many turns back only, which is right for a template whose
    output for a turn depends on no turn further back; the work then grows with the conversation and
    not with its square. None: from the first turn, at every length.
    """
    outputs: list[str] = []
    spans: list[Span] = []
    at, whole = 0, render([])
    for i, (role, text) in enumerate(turns):
        before = turns[:i] if context is None else turns[max(0, i - context) : i]
        head = whole if context is None else render(before)
        whole = render([*before, (role, text)])
        probe = next(p for p in map(chr, PROBES) if p not in whole)
        probed = render([*before, (role, probe)])
        if not (whole.startswith(head) and probed.startswith(head)):
            raise RewritesHistory(f"turn {i}: the output before it changed")
        left, added = probed.find(probe, len(head)), len(whole) - len(head)
        begin, right = (left - len(head), len(probed) - left - 1) if left >= 0 else (added, 0)
        spans.append(Span(role, at, at + added, at + begin, at + added - right))
        outputs.append(whole[len(head) :])
        at += added
    opening = render([])
    return opening + "".join(outputs), [Span(s.role, *(x + len(opening) for x in (s.start, s.end, s.text_start, s.text_end))) for s in spans]


def format_conversations(
    rows: DataFrame,
    template: Renderer = default_template,
    parse: Callable[[str], list[Turn]] = parse_default,
    undo: Callable[[str], str] = unescape,
    trained_role: str = "assistant",
    context: int | None = None,
) -> DataFrame:
    """One row per conversation: (conv_id, formatted, turn_spans, loss_spans, roles, texts, loss_texts).

    rows: conv_id, turn, role, text, one per turn. turn_spans and loss_spans are [start, end) in code
    points of formatted; the latter cover each text of trained_role. roles and texts are read back
    from formatted by parse; loss_texts are the loss spans' text with the escapes undone.

    Turns are put in order by turn, then role, then text, nulls first; repeated rows are turns of
    their own. A null text or role is empty. Rows without conv_id are one conversation with a null id.
    A conversation is one value of the result, so its turns meet in one task; different ones don't.
    An empty table gives an empty result.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = whole.select("conv_id", F.col("t.role").alias("role"), F.col("t.text").alias("text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for roles, texts in zip(batch["role"], batch["text"]):
                formatted, spans = turn_spans(list(zip(roles, texts)), template, context=context)
                back = parse(formatted)
                loss = [[s.text_start, s.text_end] for s in spans if s.role == trained_role]
                out.append((formatted, [[s.start, s.end] for s in spans], loss, [r for r, _ in back], [t for _, t in back], [undo(formatted[a:b]) for a, b in loss]))
            columns = ["formatted", "turn_spans", "loss_spans", "roles", "texts", "loss_texts"]
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    return whole.mapInPandas(run, "conv_id long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, roles array<string>, texts array<string>, loss_texts array<string>")


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both of its texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of format_conversations."""
    turns = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return formatted.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
