"""JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(df: DataFrame, path: str, one_file: bool = False) -> None:
    """One object a line, UTF-8, non-ASCII as it is, nulls written."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Well-formed object lines; blank and malformed ones are left out (see rejects())."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the non-blank lines which aren't JSON objects."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    return lines.where(~F.trim("line").startswith("{") | F.try_parse_json("line").isNull())


def preview(spark: SparkSession, path: str, n: int = 5, fields: list[str] | None = None) -> DataFrame:
    """The first n well-formed rows of the file in its order; fields that no row has are null."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    rows = lines.where(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()).orderBy("_at").limit(n)
    if fields:
        return rows.orderBy("_at").select(*[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])
    return rows.orderBy("_at").select(F.col("value").alias("row"))
