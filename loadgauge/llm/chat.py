"""Chat formatting around a black-box template.

A template is a function from turns (role, text) to one string; nothing else is known of it.
Rendering successive prefixes of a conversation and comparing consecutive outputs locates each
turn: what a prefix adds belongs to its last turn.  An output that does not begin with the one
before shows a template that rewrites history, and no span is trusted then.  A turn's own text
inside its span is found by rendering the turn once more with a mark that occurs nowhere else.

Conversations are gathered as rows, one each; conversations spread over all tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat formats; in a text each gets a backslash after its first character.
_AFTER_FIRST = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
_PLAIN = re.compile(r"([<\[])(\\*)" + _AFTER_FIRST)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _AFTER_FIRST)
_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
# Above this many turns whole prefixes are rendered at the ends of blocks only.
BLOCK = 256


def escape(text: str) -> str:
    """No control string is left; one that had k backslashes has k + 1."""
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked(turns: Sequence[Turn]) -> str:
    """The default template: a start mark, the role, a line break, the text, an end mark."""
    return "".join(f"{START}{_role_out(role)}\n{escape(text)}{END}\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``marked``."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((_role_in(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def turn_spans(template: Template, turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int]] | None]:
    """(output, span of each turn); spans are None if a later turn changes earlier output."""
    if len(turns) > 2 * BLOCK:
        return _spans_by_block(template, turns)
    before, spans = "", []
    for i in range(len(turns)):
        out = template(turns[: i + 1])
        if not out.startswith(before):
            return template(turns), None
        spans.append((len(before), len(out)))
        before = out
    return before, spans


def _spans_by_block(template: Template, turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int]] | None]:
    """The spans of a very long conversation without rendering its every prefix.

    Whole prefixes are rendered at block ends.  Inside a block the history is its first turn and
    the one before the block; what the turns add must spell the block exactly as the whole
    prefixes do, else the block's own prefixes are rendered whole.
    """
    before, spans = "", []
    for begin in range(0, len(turns), BLOCK):
        end = min(begin + BLOCK, len(turns))
        out = template(turns[:end])
        if not out.startswith(before):
            return template(turns), None
        head = list(turns[:1]) + list(turns[max(1, begin - 1) : begin]) if begin else []
        for short in (True, False):
            history = head if short else list(turns[:begin])
            try:
                last, found = template(history) if begin else "", []
                for i in range(begin, end):
                    now = template(history + list(turns[begin : i + 1]))
                    if not now.startswith(last):
                        found = []
                        break
                    found.append(now[len(last) :])
                    last = now
            except Exception:  # a template may refuse a history that never was
                if not short or not begin:
                    raise
                found = []
            if "".join(found) == out[len(before) :] and len(found) == end - begin:
                break
        else:
            return template(turns), None
        at = len(before)
        for piece in found:
            spans.append((at, at + len(piece)))
            at += len(piece)
        before = out
    return before, spans


def text_span(template: Template, turns: Sequence[Turn], i: int, output: str, span: tuple[int, int]) -> tuple[int, int] | None:
    """Where the text of turn i lies in its span, by rendering the turn with a mark in its place.

    From turn BLOCK on the history is first cut to two turns.  That counts only if the turn then
    reads exactly as in its span; else, or if the template refuses it, the true history is used.
    """
    role, text = turns[i]
    mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text and c not in output[span[0] : span[1]])
    piece = output[span[0] : span[1]]

    def found(history: list[Turn], cut: bool) -> tuple[int, int] | None:
        start = len(template(history)) if history else 0
        if cut and template([*history, (role, text)])[start:] != piece:
            return None
        shown = template([*history, (role, mark)])
        at = shown.find(mark, start)
        if at < 0:
            return None
        before, after = shown[start:at], shown[at + 1 :]
        if not (piece.startswith(before) and piece.endswith(after) and len(piece) >= len(before) + len(after)):
            return None
        return span[0] + len(before), span[1] - len(after)

    if i >= BLOCK:
        try:
            place = found(list(turns[:1]) + list(turns[i - 1 : i]), True)
        except Exception:  # a template may refuse a history that never was
            place = None
        if place is not None:
            return place
    return found(list(turns[:i]), False)


def rendered(template: Template, turns: Sequence[Turn], learned: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(output, turn spans, loss spans, rewrites history).

    A learned turn whose text is not found in its span raises: its loss would be missing.
    """
    output, spans = turn_spans(template, turns)
    if spans is None:
        return output, [], [], True
    loss = [text_span(template, turns, i, output, spans[i]) for i, (role, _) in enumerate(turns) if role == learned]
    if None in loss:
        turn = [i for i, (role, _) in enumerate(turns) if role == learned][loss.index(None)]
        raise ValueError(f"the text of turn {turn} is not found in what the template makes of it")
    return output, spans, loss, False


_SPANS = "array<struct<start:int,stop:int>>"


def format_chats(rows: DataFrame, template: Template = marked, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns, loss (spans in code points), rewrites: a row per conversation.

    Turns are ordered by number, role and text, so repeated rows stay repeated and ties do not
    matter.  Null roles and texts count as empty, null turn numbers come first, null conv_ids are
    one conversation.  A conversation whose template rewrites history has no spans.  An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                piece = batch.slice(part, 500)
                made = [
                    rendered(template, [(t["role"], t["text"]) for t in turns], learned) for turns in piece.column(1).to_pylist()
                ]
                pairs = [[[{"start": a, "stop": b} for a, b in m[k]] for m in made] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(pairs[0], span),
                     pa.array(pairs[1], span), pa.array([m[3] for m in made], pa.bool_())],
                    ["conv_id", "formatted", "turns", "loss", "rewrites"],
                )

    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, formatted string, turns {_SPANS}, loss {_SPANS}, rewrites boolean"
    return chats.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back: numbers and digests of turns and loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                learned = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                row = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                       hashlib.sha256(learned.encode()).hexdigest(), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
