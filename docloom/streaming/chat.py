"""Questions as a stream: the batch plan inside foreachBatch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import PHRASES, Phrases
from docloom.functions.text import is_blank
from docloom.operators.answer import answer_questions
from docloom.operators.retrieve import retrieve
from docloom.plugins import Embedder, LLMClient, Reranker

MESSAGES = "conv_id long, turn long, role string, text string"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", per_trigger: int = 1, since: datetime | None = None) -> DataFrame:
    """Messages as a stream; with `since`, what stood there before (the backlog of a bot that starts) is discarded."""
    rows = spark.readStream.format(fmt).schema(MESSAGES).option("maxFilesPerTrigger", per_trigger).load(path)
    return rows if since is None else rows.where(F.col("_metadata.file_modification_time") >= F.lit(since))


def user_questions(messages: DataFrame) -> DataFrame:
    """(qid, question, command) of the user's non-blank messages."""
    rows = messages.where((F.col("role") == "user") & ~is_blank(F.col("text")))
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("question"), F.col("text").startswith("/start").alias("command"))


def replies(messages: DataFrame, collection: DataFrame, embedder: Embedder, reranker: Reranker, client: LLMClient, phrases: Phrases = PHRASES) -> DataFrame:
    """(qid, reply, status) for a batch of messages: greeted, answered or failed."""
    asked = user_questions(messages)
    greeted = asked.where("command").select("qid", F.lit(phrases.greeting).alias("reply"), F.lit("greeted").alias("status"))
    questions = asked.where(~F.col("command")).select("qid", "question")
    ranked = retrieve(questions, collection, embedder, reranker, top_k=10)
    got = answer_questions(questions, ranked, client, phrases)
    said = got.select("qid", F.coalesce(F.when(F.col("error").isNull(), F.col("full_answer")), F.lit(phrases.apology)).alias("reply"), F.when(F.col("error").isNull(), "answered").otherwise("failed").alias("status"))
    return greeted.union(said)


def serve(messages: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's replies under out/batch=N: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
