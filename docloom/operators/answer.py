"""Context assembly, prompts, answers with numbered sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import PHRASES, Phrases
from docloom.functions.citations import citation_ids, reference, source_label, split_answer
from docloom.functions.text import strip
from docloom.plugins import LLMClient


def number_sources(ranked: DataFrame) -> DataFrame:
    """`ranked` (qid, rank, metadata, ...) with `label` and `cid`, the label's place by first appearance."""
    m = F.col("metadata")
    rows = ranked.withColumn("label", source_label(m["type"], m["source"], m["page_url"]))
    rows = rows.withColumn("_first", F.min("rank").over(Window.partitionBy("qid", "label")))
    return rows.withColumn("cid", F.dense_rank().over(Window.partitionBy("qid").orderBy("_first"))).drop("_first")


def ordered(value: Column, by: str = "rank") -> Column:
    """Aggregate: the group's values in order of `by`; for groups cut to a few rows beforehand."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), value.alias("v")))), lambda x: x["v"])


def assemble(ranked: DataFrame, most: int = 3) -> DataFrame:
    """(qid, context, labels, contexts, sources): the first `most` chunks of each question, numbered by source."""
    rows = number_sources(ranked.where(F.col("rank") <= most))
    m = F.col("metadata")
    ref = reference(m["type"], m["source"], m["page"], m["page_url"], F.lit(None).cast("string"))
    text = F.concat(F.lit("["), F.col("cid"), F.lit("] "), F.col("content"))
    return rows.groupBy("qid").agg(
        F.array_join(ordered(text), "\n\n").alias("context"),
        F.array_sort(F.collect_set(F.struct("cid", "label"))).alias("labels"),
        ordered(F.col("content")).alias("contexts"),
        F.array_distinct(ordered(ref)).alias("sources"),
    )


def prompt(question: Column, context: Column, phrases: Phrases = PHRASES) -> Column:
    return F.concat(F.lit(phrases.instructions + "\n\nالسؤال: "), question, F.lit("\n\nالمقاطع:\n"), context, F.lit("\n\nالجواب:\n"))


def complete(client: LLMClient, c: Column) -> Column:
    """struct<text, error>: the client's completion; a failure is an error in the row."""

    @F.pandas_udf("text string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part:
                try:
                    rows.append((client.complete(p), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return run(c)


def render_sources(answer: Column, labels: Column, phrases: Phrases = PHRASES) -> Column:
    """The answer with its sources section, if it cites anything; unknown ids are left out of the list."""
    cited = citation_ids(answer)

    def line(x: Column) -> Column:
        cid, label = x["cid"].cast("string"), x["label"]
        return (
            F.when(label.startswith("URL:"), F.concat(F.lit("- ["), cid, F.lit("] رابط: "), F.replace(label, F.lit("URL:"), F.lit(""))))
            .when(label.startswith("PDF:"), F.concat(F.lit("- ملف PDF: "), F.replace(label, F.lit("PDF:"), F.lit("")), F.lit(" ["), cid, F.lit("]")))
            .otherwise(F.concat(F.lit("- "), label, F.lit(" ["), cid, F.lit("]")))
        )

    shown = F.transform(F.array_sort(F.filter(labels, lambda x: F.array_contains(cited, x["cid"]))), lambda x: F.concat(line(x), F.lit("\n")))
    return F.when(F.size(cited) > 0, F.concat(answer, F.lit(f"\n\n{phrases.sources_header}\n"), F.array_join(shown, ""))).otherwise(answer)


def answer_questions(questions: DataFrame, ranked: DataFrame, client: LLMClient, phrases: Phrases = PHRASES, empty: str | None = None) -> DataFrame:
    """(qid, question, full_answer, answer, sources_text, contexts, sources, error): questions without results get `empty`, by default the refusal."""
    rows = questions.select("qid", "question").join(assemble(ranked), "qid", "left")
    asked = rows.where("context is not null").withColumn("got", complete(client, prompt(F.col("question"), F.col("context"), phrases)))
    asked = asked.withColumn("full_answer", render_sources(strip(F.col("got.text")), F.col("labels"), phrases)).withColumn("error", F.col("got.error"))
    rest = rows.where("context is null").withColumn("full_answer", F.lit(phrases.refusal if empty is None else empty)).withColumn("error", F.lit(None).cast("string"))
    columns = ["qid", "question", "full_answer", "contexts", "sources", "error"]
    both = asked.select(*columns).union(rest.select(*columns)).withColumn("_split", split_answer(F.col("full_answer"), phrases))
    none = F.array().cast("array<string>")
    return both.select("qid", "question", "full_answer", F.col("_split.answer").alias("answer"), F.col("_split.sources").alias("sources_text"), F.coalesce("contexts", none).alias("contexts"), F.coalesce("sources", none).alias("sources"), "error")


def top_report(ranked: DataFrame, most: int = 5, width: int = 400) -> DataFrame:
    """(qid, rank, score, source, text): the first results of each question as a console shows them, texts cut to `width`."""
    rows = ranked.where(F.col("rank") <= most)
    return rows.select("qid", "rank", F.col("score").cast("double").alias("score"), F.col("metadata.source").alias("source"), F.left("content", F.lit(width)).alias("text"))


def show_report(ranked: DataFrame, most: int = 5, width: int = 400) -> None:
    """Print top_report() of a few questions."""
    top_report(ranked, most, width).orderBy("qid", "rank").show(truncate=False, vertical=True)
