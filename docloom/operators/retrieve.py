"""Retrieval: exact cosine top-k, de-duplication, reranking, gate and final cut, for many queries at once.

A set of queries meets all rows of the collection in blocks: each task scores its part of the collection against a
block of queries in one matrix product and keeps its own best k for each query; only those are shuffled.  The
queries of a block are broadcast after a check of their number, so what is broadcast has a bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions.text import is_blank
from docloom.operators.persist import checkpointed
from docloom.plugins import Embedder, Reranker
from docloom.sources.store import embed_column, norm

#: Queries that meet the collection in one pass; more are dealt into several.
QUERY_BLOCK = 4096
#: Queries and rows whose scores a task holds at once (2 MB), whatever the block and the collection.
TILE = (256, 1024)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def nearest(queries: DataFrame, collection: DataFrame, k: int, block: int = QUERY_BLOCK, digits: int = 6) -> DataFrame:
    """(qid, id, pos, similarity): the k nearest rows of (id, embedding) for each (qid, embedding), pos from 1.

    Similarities are rounded to `digits`; ties go to the smaller id.  Vectors without length, or of another number of
    dimensions than the query's, match nothing; ids may be of any type that can be sorted.
    """
    spark = collection.sparkSession
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", collection.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    wanted = checkpointed(queries.select("qid", "embedding").where("size(embedding) > 0"))  # else each block would embed all again
    parts = -(-max(1, wanted.count()) // block)
    found = None
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part) if parts > 1 else wanted
        rows = own.collect()
        for dimensions in sorted({len(r["embedding"]) for r in rows}):
            same = [r for r in rows if len(r["embedding"]) == dimensions]
            x = np.array([r["embedding"] for r in same], np.float64)
            size = np.linalg.norm(x, axis=1)
            ok = np.isfinite(size) & (size > 0)
            if not ok.any():
                continue
            sent = spark.sparkContext.broadcast(([r["qid"] for r, good in zip(same, ok) if good], x[ok] / size[ok][:, None]))
            got = collection.select("id", "embedding").where(F.size("embedding") == dimensions).mapInArrow(_score(sent, k, digits, to_arrow_schema(schema)), schema)
            found = got if found is None else found.union(got)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("pos", rank).where(F.col("pos") <= k).select("qid", "id", "pos", "similarity")


def _score(sent, k: int, digits: int, schema: pa.Schema):
    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, x = sent.value
        best, ids = np.full((len(keys), k), -np.inf), np.full((len(keys), k), None, object)
        for batch in arrow:
            for at in range(0, batch.num_rows, TILE[1]):
                part = batch.slice(at, TILE[1])
                own = part.column(0).to_pylist()
                order = sorted(range(len(own)), key=lambda j: (own[j] is not None, own[j]))
                y = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)[order]
                size = np.linalg.norm(y, axis=1)
                ok = np.isfinite(size) & (size > 0)
                own, y = [own[j] for j, good in zip(order, ok) if good], y[ok] / size[ok][:, None]
                for q in range(0, len(keys) if own else 0, TILE[0]):
                    _keep(x[q : q + TILE[0]] @ y.T, own, best[q : q + TILE[0]], ids[q : q + TILE[0]], digits)
        q, at = np.nonzero(best > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array([keys[j] for j in q], schema.field(0).type), pa.array(ids[q, at].tolist(), schema.field(1).type), pa.array(best[q, at])], schema=schema)

    return run


def _keep(scores: np.ndarray, own: list, best: np.ndarray, ids: np.ndarray, digits: int) -> None:
    """Take the scores of a tile (queries by rows, the rows sorted by id) into each query's best k, in place."""
    k, rows = best.shape[1], scores.shape[1]
    floor, slack = best[:, -1], 10.0**-digits  # rounded scores that are equal differ by less than `slack`
    least, open_ = floor - slack, np.isneginf(floor)
    if rows > k and open_.any():
        least[open_] = np.partition(scores[open_], rows - k, axis=1)[:, rows - k] - slack
    q, j = np.nonzero(scores >= least[:, None])
    v = np.round(scores[q, j], digits)
    ok = v >= floor[q]
    q, j, v = q[ok], j[ok], v[ok]
    order = np.lexsort((j, -v, q))
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]  # `q` is sorted as it is
    q, j, v = q[order], j[order], v[order]
    for at in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else ():
        at_q = q[at[0]]
        both = [(-a, i is not None, i) for a, i in zip(best[at_q].tolist(), ids[at_q]) if a > -np.inf]
        both = sorted(both + [(-a, own[c] is not None, own[c]) for a, c in zip(v[at].tolist(), j[at])])[:k]
        best[at_q, : len(both)], ids[at_q, : len(both)] = [-a for a, _, _ in both], [i for *_, i in both]


def first_of_each(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row by `order` for each value of the keys; rows with a null order come last.

    Texts are grouped by 256 bits of them, so a group's key is short whatever the text.
    """
    texts = {f.name for f in rows.schema.fields if f.dataType.typeName() == "string"}
    short = [F.unhex(F.sha2(F.col(k), 256)) if k in texts else F.col(k) for k in keys]
    rank = F.row_number().over(Window.partitionBy(*short).orderBy(F.asc_nulls_last(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def rerank(candidates: DataFrame, reranker: Reranker, query: str = "question", text: str = "content") -> DataFrame:
    """`candidates` with `score`, from the reranker in Arrow batches."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in parts:
            yield pd.Series(reranker.score(list(zip(q, d))), dtype="float64")

    return candidates.withColumn("score", run(query, text))


def gate(ranked: DataFrame, least: float | None) -> DataFrame:
    """Nothing for a question whose best score is under `least`."""
    if least is None:
        return ranked
    best = F.max("score").over(Window.partitionBy("qid"))
    return ranked.withColumn("_best", best).where(F.col("_best") >= least).drop("_best")


def final_top(ranked: DataFrame, k: int) -> DataFrame:
    """The k best of each question as `rank`, ties in order of `pos`."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(questions: DataFrame, collection: DataFrame, embedder: Embedder | None, reranker: Reranker, top_k: int = 3, overfetch: int = 3, least: float | None = None, arabic_only: bool = True) -> DataFrame:
    """(qid, question, rank, score, pos, id, content, metadata) for (qid, question[, embedding]) questions.

    Blank contents and repeated texts go after the nearest have been cut, so fewer than top_k rows may come back.
    `arabic_only` has no effect.
    """
    del arabic_only
    if "embedding" not in questions.columns:
        questions = questions.withColumn("embedding", embed_column(embedder, "retrieval.query", F.col("question")))
    near = nearest(questions, collection, top_k * overfetch)
    rows = near.join(collection.select("id", "content", "metadata"), "id").where(~is_blank(F.col("content")))
    rows = first_of_each(rows, ["qid", "content"]).join(questions.select("qid", "question"), "qid")
    out = final_top(gate(rerank(rows, reranker), least), top_k)
    return out.select("qid", "question", "rank", "score", "pos", "id", "content", "metadata")
