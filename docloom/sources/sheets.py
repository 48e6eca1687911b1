"""Question, gold and evaluation sheets: CSV or Parquet; Excel only if a reader for it is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = "qid string, question string"
GOLD = "qid string, question string, pool_rank int, reference string, rerank_score double, page_url string, source string, page int, example_chunk string, is_gold int, notes string"
EVALUATION = "qid string, question string, answerable int, reference string"

#: Rows that one driver-side file may have.
MOST_ROWS = 100_000


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path), schema)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_sheet(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; bom=True writes one driver-side file with a byte-order mark, for small results only."""
    if bom:
        if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise ValueError(f"more than {MOST_ROWS} rows for one file: write it without bom")
        df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")
    else:
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_report(per_question: DataFrame, summary: DataFrame, path: str) -> None:
    """Two tables under one directory."""
    write_sheet(per_question, f"{path}/per_question")
    write_sheet(summary, f"{path}/summary")


def require_columns(df: DataFrame, required: set[str]) -> DataFrame:
    missing = required - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df
