"""Heading-aware greedy chunking: a left fold over the lengths of a text's units gives the cuts, slices the chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import HEADING_WORDS, ORDINALS
from docloom.functions.text import bounded_sentences, is_blank, is_heading, let


def chunks(text: Column, size: int = 300, max_sentence: int = 150, overlap: int = 0) -> Column:
    """Chunks of a text: units joined by spaces while they fit in `size`; a heading opens a new chunk.

    There is no overlap by default, as delimiters are gone before packing.  overlap=n is an option of its own: a
    chunk that overflows is followed by one that repeats its last n units, if they leave room for the next.
    """
    if overlap:
        return _with_overlap(text, size, max_sentence, overlap)
    units = bounded_sentences(text, max_sentence)
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(let(units, lambda u: let(_starts(u, size), lambda at: _cut(u, at))))


def _starts(units: Column, size: int) -> Column:
    """Where chunks begin, from 1, and behind the last unit: a fold over lengths and heading flags only."""
    sizes = F.transform(units, lambda x: F.struct(F.length(x).alias("n"), is_heading(x).alias("heading")))
    state = "struct<at:array<int>,n:int,k:int>"
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"), F.lit(1).alias("k")).cast(state)

    def step(a: Column, x: Column) -> Column:
        grown = a["n"] + x["n"] + F.when(a["k"] == 1, 0).otherwise(1)
        opens = (a["k"] == 1) | x["heading"] | (grown > size)
        n = F.when(x["heading"], x["n"] + 1).when(grown > size, x["n"]).otherwise(grown)
        return F.struct(F.when(opens, F.array_append(a["at"], a["k"])).otherwise(a["at"]).alias("at"), n.alias("n"), (a["k"] + 1).alias("k")).cast(state)

    return F.aggregate(sizes, start, step, lambda a: F.array_append(a["at"], a["k"]))


def _cut(units: Column, at: Column) -> Column:
    """The units from each start to the next, joined by spaces."""
    stretch = lambda s, k: F.array_join(F.slice(units, s, F.element_at(at, k + 2) - s), " ")
    return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), stretch)


def _with_overlap(text: Column, size: int, max_sentence: int, overlap: int) -> Column:
    state = "struct<out:array<array<string>>,cur:array<string>>"
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("cur")).cast(state)
    width = lambda units: F.length(F.array_join(units, " "))
    flushed = lambda a: F.when(F.size(a["cur"]) == 0, a["out"]).otherwise(F.array_append(a["out"], a["cur"]))

    def step(a: Column, x: Column) -> Column:
        tail = F.slice(a["cur"], F.greatest(F.lit(1), F.size(a["cur"]) - overlap + 1), F.lit(overlap))
        opened = lambda units: F.struct(flushed(a).alias("out"), units.alias("cur")).cast(state)
        grown = F.array_append(a["cur"], x)
        return (
            F.when(is_heading(x), opened(F.array(x)))
            .when((F.size(a["cur"]) == 0) | (width(grown) <= size), F.struct(a["out"].alias("out"), grown.alias("cur")).cast(state))
            .when(width(F.array_append(tail, x)) <= size, opened(F.array_append(tail, x)))
            .otherwise(opened(F.array(x)))
        )

    packed = F.aggregate(bounded_sentences(text, max_sentence), start, step, flushed)
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.transform(packed, lambda u: F.array_join(u, " ")))


_ENDS, _COMMAS, _WORD, _ORDINAL = re.compile("[.!؟\n]+"), re.compile("[,،]+"), re.compile(rf"(?<!\w)(?:{'|'.join(HEADING_WORDS)})(?!\w)"), re.compile(rf"(?:{'|'.join(ORDINALS)})(?=\w)")


def _is_heading(line: str) -> bool:
    """is_heading() of one line."""
    if len(line) < 6:
        return False
    s = " ".join(line.split())
    if not 6 <= len(s) <= 80 or s.count(" ") > 10:
        return False
    return (len(s) <= 60 and s.count(":") == 1 and s[-1] not in ".!؟") or (any(w in s for w in HEADING_WORDS) and _WORD.search(s) is not None) or _ORDINAL.match(s) is not None


def _units(text: str, most: int) -> list[str]:
    """bounded_sentences() of one text."""
    out: list[str] = []
    for s in _ENDS.split(re.sub("[ \t]+", " ", text)):
        s = s.strip()
        if len(s) <= most:
            out.append(s)
            continue
        parts = [x for p in _COMMAS.split(s) if (x := p.strip())]
        out += parts if len(parts) > 1 else [s[k : k + most].strip() for k in range(0, len(s), most)]
    return [x for x in out if x]


def chunk_text(text: str, size: int = 300, max_sentence: int = 150) -> list[str]:
    """chunks() of one text without overlap, for tasks that hold texts in Python anyway."""
    out: list[list[str]] = []
    n = 0
    for x in _units(text, max_sentence):
        grown = n + len(x) + (1 if out else 0)
        heading = _is_heading(x)
        if not out or heading or grown > size:
            out.append([])
        out[-1].append(x)
        n = len(x) + 1 if heading else len(x) if grown > size else grown
    return [" ".join(x) for x in out]
