"""A corpus pipeline: each stage reads all that the stage before it kept, and writes what it keeps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, language_id, line_dedup, mixing, near_dup
from docloom.llm.common import checkpointed
from docloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; the others stay as they are."""
    return language_id.keep_known(docs).select(*COLUMNS)


#: A document goes if no more than this share of its characters is left: the rest stands in earlier documents.
DEPLETED = 0.2


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go, and so do documents of which that leaves a fifth or less.

    A near duplicate of the document that it shares most lines with keeps those lines, and loses only what that one loses
    too: without them it would resemble nothing, and the next stage, which drops it, couldn't know it.
    """
    cut = checkpointed(line_dedup.aligned_lines(docs.select("doc_id", "text")))
    node = F.struct("doc_id", "key")
    copies = near_dup.similar_pairs(cut.select(node.alias("d"), F.col("partner").alias("e")), docs.select("doc_id", "text"))
    copies = copies.select("d.doc_id", "d.key", F.lit(True).alias("copy")).distinct()
    lines = F.when(F.col("copy"), F.col("others")).otherwise(F.col("lines"))
    cut = cut.join(copies, ["doc_id", "key"], "left").select("doc_id", "key", lines.alias("lines")).where("size(lines) > 0")
    out = line_dedup.dedup_lines(docs, cut).where(f"_n_removed = 0 or _n_left > {DEPLETED} * _n_chars")
    return out.selectExpr("doc_id", "text", "lang", "source", "case when _n_removed = 0 then n_chars else cast(length(text) as bigint) end as n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dup.drop_near_duplicates(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents are drawn never, once or twice, one in each source in part."""
    return mixing.mix(docs).select("doc_id", "text", "lang", "source", "n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each drawn document."""
    return bpe.round_trip_digests(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Language ID, signatures and byte pairs are beyond SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written to the shared folder and read again.

    A stage's folder is removed once the next stage is written; the last one holds the rows that are returned and is
    left, in a folder `pipeline-...` of spark.checkpoint.dir, to whoever reads them.  Nulls, ties, repeated rows and
    empty tables are as each stage's operator states; an empty `documents` gives no rows.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        shared = tempfile.mkdtemp(prefix="docloom-pipeline-")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
