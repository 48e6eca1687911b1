r"""Chat formatting by grammar round trip.

A turn is written ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.  Each rendered turn is parsed again by
the deterministic reader below and compared with its source; where they differ, the conflicting content is
escaped one level further, until they are identical.  Escaping puts a backslash into each control string
(``<\|im_end|>``), one more into each that has some already, so that the reader takes exactly one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batches, records

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE = re.compile(r"\\(.)", re.S)


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|")


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the raw text) of each turn; ValueError if the text isn't in the grammar."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END, line)
        if line < 0 or end < 0 or not rendered.startswith("\n", end + len(END)):
            raise ValueError(f"open turn at {at}")
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in text or START in role or END in role:
            raise ValueError(f"control string inside the turn at {at}")
        out.append((unescape_role(role), unescape_text(text), line + 1, end))
        at = end + len(END) + 1
    return out


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's rendering and the escape level that its round trip needed: 0 none, 1 text, 2 text and role."""
    for level in (0, 1, 2):
        rendered = f"{START}{escape_role(role) if level > 1 else role}\n{escape_text(text) if level else text}{END}\n"
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered, level
        except ValueError:
            pass
    raise ValueError("turn can't be rendered")


_TURNS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("rendered", pa.string()), ("char_start", pa.int64()), ("loss_start", pa.int64()), ("loss_chars", pa.int64()), ("escape_level", pa.int32())])
TURNS = "conv_id long, pos long, rendered string, char_start long, loss_start long, loss_chars long, escape_level int"


def _format(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now, pos, start = object(), 0, 0
        for conv_id, role, text in records(arrow):
            if conv_id != now:
                now, pos, start = conv_id, 0, 0
            rendered, level = render_turn(role, text)
            _, _, a, b = parse(rendered)[0]
            loss = role == "assistant"
            yield conv_id, pos, rendered, start, start + a if loss else None, b - a if loss else 0, level
            pos, start = pos + 1, start + len(rendered)

    yield from batches(rows(), _TURNS)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, each conversation's rows together and in order: its rendered text is their concatenation.

    loss_start and loss_chars mark the raw text of assistant turns inside the conversation's rendering (null and 0
    for other roles).  A conversation is streamed through its task, never held as a whole, so a very long one
    needs no memory.  Null role or text counts as empty; rows with equal turn are ordered by role, then text, and
    repeated rows are turns of their own; rows without conv_id form one conversation with a null id; an empty
    table gives no rows; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format, TURNS)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_escaped", pa.int64())])


def _digest(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held = None
        for conv_id, pos, rendered, start, loss_start, loss_chars, level in records(arrow):
            if pos == 0:
                if held:
                    yield finish(held)
                held = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text, _, _ in parse(rendered):
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss_start is not None:
                text = unescape_text(rendered[loss_start - start : loss_start - start + loss_chars])
                held[3] += len(text)
                held[4].update(text.encode("utf-8", "surrogatepass"))
            held[5] += len(rendered)
            held[6] += level > 0
        if held:
            yield finish(held)

    def finish(x: list) -> tuple:
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6]

    yield from batches(rows(), _DIGEST)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digests of format_turns' own rows, in its order, read back from the rendered text and the loss mask."""
    return turns.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long")
