"""The vector collection: a Parquet table of id, content, metadata, embedding and its norm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import is_blank
from docloom.plugins import Embedder
from docloom.sources.documents import METADATA

SCHEMA = f"id string, content string, metadata {METADATA}, embedding array<float>, norm double"


def embed_column(embedder: Embedder, task: str, c: Column, batch: int = 128) -> Column:
    """Vectors of texts; only `batch` texts are Python objects at a time, however many rows Arrow brings."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                x = np.asarray(embedder.embed([t or "" for t in part.slice(at, batch).to_pylist()], task), np.float32)
                out.append(pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))

    return run(c)


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def create(spark: SparkSession, name: str, path: str | None = None) -> None:
    """The table, unless it exists: in the warehouse, or in the folder `path`."""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA.replace(' array<float>', ' ARRAY<FLOAT>')}) USING parquet{place} TBLPROPERTIES ('metric' = 'cosine')")


def storable(chunks: DataFrame) -> DataFrame:
    """The rows with content, with the batch that each goes in: `batch_size` rows by id order is for reports only."""
    return chunks.where(~is_blank(F.col("content")))


def add(chunks: DataFrame, name: str, embedder: Embedder, batch: int = 128) -> None:
    """Embed the rows whose id the table lacks and append them; of rows that share an id one is stored."""
    spark = chunks.sparkSession
    new = storable(chunks).select("id", "content", "metadata").dropDuplicates(["id"]).join(spark.table(name).select("id"), "id", "left_anti")
    rows = new.withColumn("embedding", embed_column(embedder, "retrieval.passage", F.col("content"), batch)).withColumn("norm", norm(F.col("embedding")))
    rows.select("id", "content", F.col("metadata").cast(METADATA).alias("metadata"), "embedding", "norm").write.mode("append").format("parquet").saveAsTable(name)


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").count().where("count > 1")
