"""Page-oriented documents and fetched pages to chunk rows of one superset schema."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.chunk import chunk_text
from docloom.functions.text import has_letters
from docloom.functions.text import normalized as normalized_text
from docloom.functions.urls import uid
from docloom.plugins import Fetcher, PageTextExtractor

METADATA = "struct<type:string,source:string,page:int,chunk:int,page_url:string>"


def metadata(kind: str, source: Column, page: Column | None = None, chunk: Column | None = None, page_url: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), source.alias("source"), (page if page is not None else null).cast("int").alias("page"), (chunk if chunk is not None else null).cast("int").alias("chunk"), (page_url if page_url is not None else null).cast("string").alias("page_url"))


def fetch(urls: DataFrame, fetcher: Fetcher | DataFrame, url: str = "url", delay: float = 0.0) -> DataFrame:
    """(url, content_type, body, error) of each address; failures are rows with an error.

    A table (url, content_type, body) in the fetcher's place is looked up by a join.
    """
    if isinstance(fetcher, DataFrame):
        held = fetcher.select("url", "content_type", "body", F.lit(True).alias("_held"))
        rows = urls.select(F.col(url).alias("url")).where("url is not null").join(held, "url", "left")
        return rows.select("url", "content_type", "body", F.when(F.col("_held").isNull(), "not found").alias("error"))
    schema = pa.schema([("url", pa.string()), ("content_type", pa.string()), ("body", pa.binary()), ("error", pa.string())])

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for u in batch.column(0).to_pylist():
                got = fetcher.fetch(u)
                time.sleep(delay)
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([got.content_type], pa.string()), pa.array([got.body], pa.binary()), pa.array([got.error], pa.string())], schema=schema)

    return urls.select(F.col(url)).where(F.col(url).isNotNull()).mapInArrow(run, "url string, content_type string, body binary, error string")


@F.pandas_udf(StringType())
def decoded(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    """Text of page bodies in the character set that the header names, else the page, else UTF-8; what can't be decoded is replaced."""
    out = []
    for body, kind in zip(bodies, content_types):
        named = re.search(r"charset=[\"']?([\w.:-]+)", kind or "") or re.search(rb"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", (body or b"")[:4096], re.I)
        name = named[1] if named else "utf-8"
        try:
            out.append(None if body is None else body.decode(name if isinstance(name, str) else name.decode(), "replace"))
        except LookupError:
            out.append(body.decode("utf-8", "replace"))
    return pd.Series(out, dtype="object")


def _pages(arrow: Iterable[pa.RecordBatch], extractor: PageTextExtractor) -> Iterator[tuple[str, int, str | None]]:
    """(path, page, text) of (path, content) batches; OCR runs only for pages whose own text says too little."""
    for batch in arrow:
        for path, content in zip(*batch.columns):
            path, content = path.as_py(), content.as_py()  # one document at a time
            try:
                pages = list(extractor.pages(content or b""))
            except Exception:  # noqa: BLE001  a broken document has no pages
                pages = []
            for k, text in enumerate(pages):
                if text is None:
                    try:
                        text = extractor.ocr(content, k)
                    except Exception:  # noqa: BLE001
                        text = ""
                yield path, k + 1, text


def _batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 2_000, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded size: a batch for each row costs more than the row."""
    held: list[tuple] = []
    chars = 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        held.append(row)
        chars += len(row[-1] or "")
        if len(held) >= most or chars >= most_chars:
            yield done()
            held, chars = [], 0
    if held:
        yield done()


def page_texts(files: DataFrame, extractor: PageTextExtractor) -> DataFrame:
    """(path, page, text) of (path, content) rows."""
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string())])
    return files.select("path", "content").mapInArrow(lambda arrow: _batched(_pages(arrow, extractor), schema), "path string, page int, text string")


def _chunked(files: DataFrame, extractor: PageTextExtractor, normalized: bool, min_chars: int, min_letters: int, size: int) -> DataFrame:
    """(path, page, chunk, content) of (path, content) rows, in one pass over the pages where they are read."""
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("chunk", pa.int32()), ("content", pa.string())])

    def rows(arrow: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for path, page, text in _pages(arrow, extractor):
            if text is not None and len(text.strip()) >= min_chars:
                text = normalized_text(text) if normalized else text
                if has_letters(text, min_letters):
                    for k, content in enumerate(chunk_text(text, size)):
                        yield path, page, k + 1, content

    return files.select("path", "content").mapInArrow(lambda arrow: _batched(rows(arrow), schema), "path string, page int, chunk int, content string")


def chunk_local_documents(spark: SparkSession, path: str, extractor: PageTextExtractor, normalized: bool = True, min_chars: int = 15, size: int = 300) -> DataFrame:
    """Chunks of the documents under `path`: id, url, page_number, chunk_index, content, metadata."""
    return chunk_files(spark.read.format("binaryFile").load(path), extractor, normalized, min_chars, size)


def chunk_files(files: DataFrame, extractor: PageTextExtractor, normalized: bool = True, min_chars: int = 15, size: int = 300) -> DataFrame:
    """The same of (path, content) rows."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = _chunked(files, extractor, normalized, min_chars, 10, size).withColumn("stem", stem)
    return rows.select(F.concat("stem", F.lit("_page_"), "page", F.lit("_chunk_"), "chunk").alias("id"), F.lit(None).cast("string").alias("url"), F.col("page").alias("page_number"), F.col("chunk").alias("chunk_index"), "content", metadata("PDF_page", F.col("stem"), F.col("page")).alias("metadata"))


def chunk_remote_documents(urls: DataFrame, fetcher: Fetcher, extractor: PageTextExtractor, normalized: bool = True, min_chars: int = 20, min_letters: int = 10, size: int = 300) -> DataFrame:
    """Chunks of fetched documents; addresses that fail give no rows."""
    got = fetch(urls, fetcher).where("error is null").select(F.col("url").alias("path"), F.col("body").alias("content"))
    rows = _chunked(got, extractor, normalized, min_chars, min_letters, size)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", "")
    own = F.concat(F.lit("_pdf_"), "page", F.lit("_chunk_"), "chunk")
    return rows.select(uid(F.col("path"), own).alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("chunk_index"), "content", metadata("PDF_page", stem, F.col("page"), F.col("chunk"), F.col("path")).alias("metadata"))


def web_rows(pages: DataFrame, site_name: str, text: str = "text") -> DataFrame:
    """One row for each web page with text (pages aren't chunked)."""
    rows = pages.where(F.coalesce(F.col(text), F.lit("")) != "")
    return rows.select(uid(F.col("url")).alias("id"), "url", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("chunk_index"), F.col(text).alias("content"), metadata("web_page", F.lit(site_name), page_url=F.col("url")).alias("metadata"))
