"""Chat formatting by a grammar round trip.

    conversation := turn*        turn := <|im_start|> role \\n text <|im_end|> \\n

A deterministic parser reads rendered text back.  Each turn is rendered plainly, parsed and compared with its source;
where the two differ, the text and then the role are escaped and the turn is rendered again, until they are identical.
A turn that parses alone parses the same way inside its conversation, as the grammar keeps no state between turns, so
turns are formatted where they lie: no shuffle, and a hot conversation is only more rows.

Escaping puts a backslash behind the ``<`` of a control string, and one more where there are some: ``<\\|im_end|>``.
A line feed inside a role becomes ``<|nl|>``.

Null texts and roles count as empty.  Rows of a conversation are ordered by turn (nulls first), then role and text, so
repeated turns have a fixed order; repeated rows are kept.  An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_TEXT = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ROLE = re.compile(r"<(\\*)\|(im_start|im_end|nl)\|>")
_TEXT_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end|nl)\|>")
_CONTROL = re.compile(re.escape(START) + "|" + re.escape(END))


def escape_text(text: str) -> str:
    return _TEXT.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return _TEXT_ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return _ROLE.sub(r"<\\\1|\2|>", role).replace("\n", LINE)


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(r"<\1|\2|>", role.replace(LINE, "\n"))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of ``rendered``: role, text, and where the text's rendered form starts and ends. ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        stop = _CONTROL.search(rendered, at + len(START))
        line = rendered.find("\n", at + len(START))
        if stop is None or stop[0] != END or not 0 <= line < stop.start() or not rendered.startswith("\n", stop.end()):
            raise ValueError(f"no turn ends after {at}")
        turns.append((unescape_role(rendered[at + len(START) : line]), unescape_text(rendered[line + 1 : stop.start()]), line + 1, stop.start()))
        at = stop.end() + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendered form, and where the text is in it."""
    for shown_role, shown_text in ((role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))):
        rendered = f"{START}{shown_role}\n{shown_text}{END}\n"
        try:
            back = parse(rendered)
        except ValueError:
            continue
        if [t[:2] for t in back] == [(role, text)]:
            return rendered, back[0][2], back[0][3]
    raise ValueError("the turn can't be rendered so that it parses back")


FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``FORMATTED``: each turn's part of its conversation's text, in code points where the loss mask covers it (nulls: nowhere)."""

    def run(batches):
        for b in batches:
            out = [render(role, text) for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            masked = [r == loss_role for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] if m else None for o, m in zip(out, masked)], pa.int64()), pa.array([o[2] if m else None for o, m in zip(out, masked)], pa.int64())],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
            )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"))
    return rows.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """``DIGESTS`` of each conversation, parsed from its formatted text.

    The digest of a text is sequential, so a conversation's turns stream through one task in their order; the task holds
    one turn and two digests, whatever the conversation's length.
    """

    def run(batches):
        now, have, rows = None, False, []

        def begin():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        state = begin()

        def end():
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch():
            columns = list(zip(*rows))
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])

        for b in batches:
            for conv_id, shown, start, stop in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if not have or conv_id != now:
                    if have:
                        end()
                    now, have, state = conv_id, True, begin()
                for role, text, _, _ in parse(shown):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    loss = unescape_text(shown[start:stop])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(shown)
            if len(rows) >= 2048:
                yield batch()
        if have:
            end()
        if rows:
            yield batch()

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, DIGESTS)
