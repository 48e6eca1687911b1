"""Citations, references and sheet cells."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import PHRASES, Phrases
from docloom.functions.text import strip
from docloom.functions.urls import canonical_stripped

#: The zero of every script that has decimal digits; the other nine follow it.
_ZEROS = "".join(chr(k) for k in range(0x80, 0x110000) if unicodedata.decimal(chr(k), None) == 0)
_DIGITS = "".join(chr(ord(z) + k) for z in _ZEROS for k in range(10))


def citation_ids(text: Column) -> Column:
    """Distinct ids of [n] with one to three Unicode digits, ascending."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\p{Nd}{1,3})\]"), 1)
    ids = F.transform(found, lambda x: F.translate(x, _DIGITS, "0123456789" * len(_ZEROS)).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def citation_validity(text: Column, n_contexts: Column) -> Column:
    """struct<valid, used, invalid, notes>; an answer without citations isn't valid."""
    used = citation_ids(text)
    invalid = F.filter(used, lambda x: (x < 1) | (x > n_contexts))
    notes = F.when(F.size(used) == 0, "No citations found.").when(F.size(invalid) == 0, "").otherwise(F.concat(F.lit("Out-of-range citations: ["), F.array_join(invalid, ", "), F.lit("]")))
    return F.struct(((F.size(used) > 0) & (F.size(invalid) == 0)).alias("valid"), used.alias("used"), invalid.alias("invalid"), notes.alias("notes"))


def source_label(kind: Column, source: Column, page_url: Column) -> Column:
    """The generator's source label: web pages by address, PDFs by file name."""
    return (
        F.when(kind == "web_page", F.concat(F.lit("URL:"), F.coalesce(F.nullif(page_url, F.lit("")), F.lit("UNKNOWN_URL"))))
        .when(kind == "PDF_page", F.concat(F.lit("PDF:"), F.coalesce(source, F.lit("PDF"))))
        .otherwise(F.coalesce(source, F.lit("UNKNOWN")))
    )


def reference(kind: Column, source: Column, page: Column, page_url: Column, url: Column) -> Column:
    """The evaluation's reference: PDFs by file name and page."""
    address = F.coalesce(F.nullif(page_url, F.lit("")), F.nullif(url, F.lit("")))
    return (
        F.when(kind == "web_page", F.when(address.isNull(), "URL:UNKNOWN").otherwise(F.concat(F.lit("URL:"), canonical_stripped(address))))
        .when(kind == "PDF_page", F.concat(F.lit("PDF:"), F.coalesce(source, F.lit("PDF")), F.when(page.isNull(), "").otherwise(F.concat(F.lit(":p"), page.cast("int").cast("string")))))
        .otherwise(F.concat(F.lit("SRC:"), F.coalesce(source, F.lit("UNKNOWN"))))
    )


def split_answer(text: Column, phrases: Phrases = PHRASES) -> Column:
    """struct<answer, sources>: cut at the first sources header, both sides trimmed."""
    text = F.coalesce(text, F.lit(""))
    at = F.instr(text, phrases.sources_header)
    return F.struct(strip(F.when(at == 0, text).otherwise(F.left(text, at - 1))).alias("answer"), F.when(at == 0, "").otherwise(strip(F.substring(text, at, F.length(text)))).alias("sources"))


def abstained(text: Column, phrases: Phrases = PHRASES) -> Column:
    out = F.lit(False)
    for p in phrases.abstain:
        out = out | F.coalesce(text, F.lit("")).contains(p)
    return out


def parse_references(cell: Column) -> Column:
    """A JSON list of strings, or parts between semicolons; trimmed, without blanks.  Null and blank cells are empty."""
    cell = strip(F.coalesce(cell, F.lit("")))
    listed = F.when(cell.startswith("["), F.from_json(cell, "array<string>"))
    parts = F.coalesce(listed, F.split(cell, ";"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")
