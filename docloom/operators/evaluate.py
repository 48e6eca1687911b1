"""Annotation pools, Hit and MRR, judged generation reports."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import PHRASES, VERDICT_PARTS, Phrases
from docloom.functions.citations import abstained, citation_validity, parse_references, reference
from docloom.functions.text import strip
from docloom.operators.answer import answer_questions, complete, ordered
from docloom.operators.retrieve import retrieve
from docloom.plugins import Embedder, LLMClient, Reranker
from docloom.sources.sheets import require_columns

VERDICT = "struct<faithfulness:struct<score:double,passed:boolean,unsupported_claims:array<string>,notes:string>,relevance:struct<score:double,notes:string>,correctness:struct<score:double,critical_error:boolean,notes:string>,fluency:struct<score:double,notes:string>>"


def with_reference(ranked: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return ranked.withColumn("reference", reference(m["type"], m["source"], m["page"], m["page_url"], F.lit(None).cast("string")))


def distinct_references(ranked: DataFrame, most: int) -> DataFrame:
    """The best row of each reference, at most `most` for each question, with `place` among them."""
    one = F.row_number().over(Window.partitionBy("qid", "reference").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return ranked.withColumn("_one", one).where("_one = 1").drop("_one").withColumn("place", place).where(F.col("place") <= most)


def annotation_pool(ranked: DataFrame, most: int = 10) -> DataFrame:
    """The 11-column annotation sheet.  It must not be written over a marked gold sheet."""
    m, rows = F.col("metadata"), distinct_references(with_reference(ranked), most)
    return rows.select("qid", "question", F.col("rank").alias("pool_rank"), "reference", F.col("score").alias("rerank_score"), m["page_url"].alias("page_url"), m["source"].alias("source"), m["page"].alias("page"), F.left("content", F.lit(500)).alias("example_chunk"), F.lit(None).cast("int").alias("is_gold"), F.lit("").alias("notes"))


def gold_sets(marked: DataFrame) -> DataFrame:
    """(qid, gold): the references marked 1, sorted."""
    rows = marked.where("is_gold = 1").select("qid", F.col("reference").cast("string").alias("reference")).distinct()
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list("reference")).alias("gold"))


def hit_and_mrr(questions: DataFrame, referenced: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """(qid, num_gold_refs, hit, mrr, retrieved): questions without gold or results count with zeros."""
    best = distinct_references(referenced, k).groupBy("qid").agg(ordered(F.col("reference"), "place").alias("refs"))
    rows = questions.select("qid").distinct().join(best, "qid", "left").join(gold, "qid", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("qid", F.coalesce("refs", none).alias("refs"), F.coalesce("gold", none).alias("gold"))
    at = F.array_min(F.transform(F.array_intersect("refs", "gold"), lambda r: F.array_position(F.col("refs"), r)))
    return rows.select("qid", F.size("gold").alias("num_gold_refs"), at.isNotNull().cast("int").alias("hit"), F.coalesce(F.lit(1.0) / at, F.lit(0.0)).alias("mrr"), F.array_join("refs", ";").alias("retrieved"))


def retrieval_summary(per_question: DataFrame) -> DataFrame:
    return per_question.agg(F.avg("hit").alias("hit_rate"), F.avg("mrr").alias("mrr"), F.avg("num_gold_refs").alias("avg_gold_refs"))


def parse_verdict(raw: Column) -> Column:
    """struct<verdict, error>: backticks and a leading json stripped; else the outermost braces; all four parts required."""
    text = strip(F.regexp_replace(strip(raw), "^`+|`+$", ""))
    text = strip(F.when(F.lower(F.left(text, F.lit(4))) == "json", F.substring(text, 5, 1 << 30)).otherwise(text))
    whole = F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    verdict = F.from_json(whole, VERDICT, {"mode": "PERMISSIVE"})
    keys = F.coalesce(F.json_object_keys(F.when(F.try_parse_json(whole).isNotNull(), whole)), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, VERDICT_PARTS)), keys)
    error = F.when(F.try_parse_json(F.nullif(whole, F.lit(""))).isNull(), "verdict isn't JSON").when(F.size(missing) > 0, F.concat(F.lit("verdict lacks "), F.element_at(missing, 1)))
    return F.struct(F.when(error.isNull(), verdict).alias("verdict"), F.coalesce(error, F.lit("")).alias("error"))


def judge_prompt(question: Column, answer: Column, contexts: Column, most: int = 2500) -> Column:
    shown = F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.left(x, F.lit(most))))
    return F.concat(F.lit("قيم الجواب بحسب المقاطع وحدها وأعد كائن JSON فيه faithfulness و relevance و correctness و fluency.\n\nالسؤال: "), question, F.lit("\n\nالجواب: "), answer, F.lit("\n\nالمقاطع:\n"), F.array_join(shown, "\n\n"))


class Retrying:
    """A client that tries again after a growing pause, also after the last try, and then raises the last error."""

    def __init__(self, client: LLMClient, tries: int = 3, pause: float = 1.5):
        self.client, self.tries, self.pause = client, tries, pause

    def complete(self, prompt: str) -> str:
        last: Exception | None = None
        for k in range(self.tries):
            try:
                return self.client.complete(prompt)
            except Exception as e:  # noqa: BLE001
                last = e
                time.sleep(self.pause * (k + 1))
        raise last or ValueError("no tries")


def run_rag(questions: DataFrame, collection: DataFrame, embedder: Embedder | None, reranker: Reranker, client: LLMClient, top_k: int = 3, overfetch: int = 5, phrases: Phrases = PHRASES) -> DataFrame:
    """Retrieval and answers for an evaluation sheet's questions: those without results are answered with `no_results`."""
    ranked = retrieve(questions, collection, embedder, reranker, top_k, overfetch)
    return answer_questions(questions, ranked, client, phrases, phrases.no_results)


def generation_report(sheet: DataFrame, answered: DataFrame, judge: LLMClient, phrases: Phrases = PHRASES, tries: int = 3, pause: float = 1.5) -> DataFrame:
    """The 21-column report of (qid, question, answerable, reference) and answered questions; failed judgements are nulls and an error.

    The judge is asked `tries` times.  A question that isn't among the answered ones counts as answered with `no_results`.
    """
    require_columns(sheet, {"qid", "question", "answerable", "reference"})
    rows = sheet.select("qid", strip(F.col("question")).alias("question"), F.col("answerable").cast("int").alias("answerable"), F.array_distinct(parse_references(F.col("reference"))).alias("gold"))
    none = F.array().cast("array<string>")
    rows = rows.join(answered.select("qid", "answer", "contexts", "sources"), "qid", "left")
    rows = rows.withColumns({"answer": F.coalesce("answer", F.lit(phrases.no_results)), "contexts": F.coalesce("contexts", none), "sources": F.coalesce("sources", none)})
    rows = rows.withColumn("got", complete(Retrying(judge, tries, pause), judge_prompt(F.col("question"), F.col("answer"), F.col("contexts"))))
    parsed = F.when(F.col("got.error").isNull(), parse_verdict(F.col("got.text")))
    rows = rows.withColumns({"_p": parsed, "_c": citation_validity(F.col("answer"), F.size("contexts")), "abstained": abstained(F.col("answer"), phrases)})
    v, joined = F.col("_p.verdict"), lambda c, s: F.array_join(c, s)
    notes = F.concat(F.lit("F:"), v["faithfulness"]["notes"], F.lit(" | R:"), v["relevance"]["notes"], F.lit(" | C:"), v["correctness"]["notes"], F.lit(" | L:"), v["fluency"]["notes"])
    return rows.select(
        "qid", "question", "answerable", "abstained",
        F.coalesce(F.col("answerable").isin(0, 1) & (F.col("abstained") == (F.col("answerable") == 0)), F.lit(False)).alias("abstention_correct"),
        F.when(F.size("gold") > 0, F.arrays_overlap("gold", "sources")).alias("used_gold_source"),
        joined(F.array_sort("sources"), ";").alias("retrieved_sources"), joined(F.array_sort("gold"), ";").alias("gold_sources"), "answer",
        F.col("_c.valid").alias("citation_valid"), joined(F.col("_c.used"), ",").alias("citation_used"), joined(F.col("_c.invalid"), ",").alias("citation_invalid"),
        v["faithfulness"]["score"].alias("faithfulness_score"), v["faithfulness"]["passed"].alias("faithfulness_passed"), joined(v["faithfulness"]["unsupported_claims"], " | ").alias("unsupported_claims"),
        v["relevance"]["score"].alias("relevance_score"), v["correctness"]["score"].alias("correctness_score"), v["correctness"]["critical_error"].alias("critical_error"), v["fluency"]["score"].alias("fluency_score"),
        notes.alias("judge_notes"), F.coalesce("got.error", "_p.error").alias("judge_error"),
    )


def generation_summary(report: DataFrame) -> DataFrame:
    """11 measures: citations and abstention over all rows, the others over judged rows; zeros where none was judged."""
    judged = F.col("faithfulness_score").isNotNull()
    rate = lambda c: F.avg(F.when(judged, F.col(c).cast("double")))
    zero = lambda c: F.coalesce(rate(c), F.lit(0.0))
    return report.agg(
        F.count(F.lit(1)).alias("n_total"), F.count("faithfulness_score").alias("n_scored"),
        F.avg(F.col("citation_valid").cast("double")).alias("citation_valid_rate"), F.avg(F.col("abstention_correct").cast("double")).alias("abstention_accuracy"),
        rate("used_gold_source").alias("gold_source_covered_rate"), zero("faithfulness_passed").alias("faithfulness_pass_rate"), zero("faithfulness_score").alias("avg_faithfulness"),
        zero("relevance_score").alias("avg_relevance"), zero("correctness_score").alias("avg_correctness"), zero("critical_error").alias("critical_error_rate"), zero("fluency_score").alias("avg_fluency"),
    )
