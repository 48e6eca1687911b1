"""Retrieval, answering, evaluation, crawling, sources, streaming; registered queries against their SQL."""

import json
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docloom.config import PHRASES, Site
from docloom.operators import answer as A
from docloom.operators import evaluate as E
from docloom.operators import retrieve as R
from docloom.operators.crawl import bfs_levels, crawl
from docloom.plans.oracles import ORACLES
from docloom.plans.queries import GOOD, QUERIES
from docloom.plugins import FirstContextLLM, FixedJudge, FormFeedText, HashingEmbedder, OverlapReranker, TableFetcher
from docloom.sources import documents, jsonl, sheets, store
from docloom.streaming import chat

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
META = "type string, source string, page int, chunk int, page_url string"


def cell(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert name in ORACLES
    got = QUERIES[name](spark, DATA)
    rows = [tuple(cell(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(cell(r[k]) for k in order)) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def ranked(spark, rows):
    return spark.createDataFrame([(q, f"question {q}", k, 1.0 / k, text, meta) for q, k, text, meta in rows], f"qid string, question string, rank int, score double, content string, metadata struct<{META.replace(' ', ':').replace(',:', ',')}>")


def pdf(name, page):
    return ("PDF_page", name, page, None, None)


def test_nearest_in_blocks_with_ties_and_empty_vectors(spark):
    rows = [(k, [1.0, float(k % 3)]) for k in range(30)] + [(30, [0.0, 0.0]), (31, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    queries = v.where("id in (0, 1, 30)").withColumnRenamed("id", "qid")
    got = sorted((r["qid"], r["pos"], r["id"]) for r in R.nearest(queries, v, 3, block=1).collect())
    assert got == [(0, 1, 0), (0, 2, 3), (0, 3, 6), (1, 1, 1), (1, 2, 4), (1, 3, 7)]
    assert R.nearest(queries.limit(0), v, 3).count() == 0 and R.nearest(queries, v.limit(0), 3).count() == 0


def test_retrieval_cuts_before_it_dedupes(spark):
    meta = f"struct<{META.replace(' ', ':').replace(',:', ',')}>"
    rows = [("a", "same text", [1.0, 0.0]), ("b", "same text", [0.99, 0.1]), ("c", " ", [0.98, 0.1]), ("d", "question q words", [0.9, 0.3]), ("e", "far", [0.0, 1.0])]
    collection = spark.createDataFrame([(i, t, e, pdf(i, 1)) for i, t, e in rows], f"id string, content string, embedding array<float>, metadata {meta}")
    questions = spark.createDataFrame([("q", "question q", [1.0, 0.0])], "qid string, question string, embedding array<float>")
    got = R.retrieve(questions, collection, None, OverlapReranker(), top_k=2, overfetch=2).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [("d", 1), ("a", 2)]
    assert R.retrieve(questions, collection, None, OverlapReranker(), 2, 2, least=1.01).count() == 0
    same = [sorted(map(tuple, R.retrieve(questions, collection, None, OverlapReranker(), 2, 2, arabic_only=x).select("id", "rank").collect())) for x in (True, False)]
    assert same[0] == same[1]


def test_final_cut_plans_a_group_limit(spark):
    df = spark.createDataFrame([("q", 1.0, 1)], "qid string, score double, pos int")
    assert "WindowGroupLimit" in R.final_top(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_answers_number_sources_and_render_them(spark):
    rows = [("q", 1, "one", pdf("r", 3)), ("q", 2, "two", pdf("r", 4)), ("q", 3, "three", ("web_page", None, None, None, "https://e.com/a")), ("q", 4, "four", pdf("z", 1))]
    got = A.assemble(ranked(spark, rows)).first()
    assert got["context"] == "[1] one\n\n[1] two\n\n[2] three" and got["sources"] == ["PDF:r:p3", "PDF:r:p4", "URL:https://e.com/a"]
    labels = spark.createDataFrame([("x [2] [1] [9]", [(1, "PDF:r"), (2, "URL:u"), (3, "s")]), ("none", [(1, "s")]), ("[7]", [(1, "s")])], "a string, l array<struct<cid:int,label:string>>")
    shown = [r[0] for r in labels.select(A.render_sources(F.col("a"), F.col("l"))).collect()]
    head = f"\n\n{PHRASES.sources_header}\n"
    assert shown == ["x [2] [1] [9]" + head + "- ملف PDF: r [1]\n- [2] رابط: u\n", "none", "[7]" + head]
    questions = spark.createDataFrame([("q", "question q"), ("p", "question p")], "qid string, question string")
    answers = {r["qid"]: r for r in A.answer_questions(questions, ranked(spark, rows), FirstContextLLM()).collect()}
    assert answers["p"]["answer"] == PHRASES.refusal and answers["p"]["contexts"] == []
    assert answers["q"]["answer"] == "one [1]" and answers["q"]["sources_text"].startswith(PHRASES.sources_header)


class Broken:
    def complete(self, prompt):
        raise ValueError("down")


def test_hit_mrr_and_pool(spark):
    rows = ranked(spark, [("q", 1, "a", pdf("A", None)), ("q", 2, "a2", pdf("A", None)), ("q", 3, "b", pdf("B", None))])
    gold = E.gold_sets(spark.createDataFrame([("q", "PDF:B", 1), ("q", "PDF:A", 0), ("q", "PDF:B", 1), ("z", "PDF:B", None)], "qid string, reference string, is_gold int"))
    questions = spark.createDataFrame([("q",), ("z",)], "qid string")
    got = {r["qid"]: r for r in E.hit_and_mrr(questions, E.with_reference(rows), gold).collect()}
    assert (got["q"]["hit"], got["q"]["mrr"], got["q"]["retrieved"]) == (1, 0.5, "PDF:A;PDF:B") and (got["z"]["hit"], got["z"]["mrr"]) == (0, 0.0)
    pool = E.annotation_pool(rows).orderBy("pool_rank").collect()
    assert [(r["reference"], r["pool_rank"]) for r in pool] == [("PDF:A", 1), ("PDF:B", 3)] and len(pool[0]) == 11


def test_report_with_and_without_verdicts(spark):
    sheet = spark.createDataFrame([("1", " q ", 0, '["s"]'), ("2", "q", 1, None)], sheets.EVALUATION)
    answered = spark.createDataFrame([("1", PHRASES.refusal, ["c"], ["s"]), ("2", "x [1]", ["c"], ["s"])], "qid string, answer string, contexts array<string>, sources array<string>")
    good = {r["qid"]: r for r in E.generation_report(sheet, answered, FixedJudge()).collect()}
    assert good["1"]["abstention_correct"] and good["1"]["used_gold_source"] and not good["1"]["citation_valid"]
    assert good["2"]["used_gold_source"] is None and good["2"]["citation_valid"] and len(good["2"]) == 21
    bad = E.generation_report(sheet, answered, Broken(), tries=2, pause=0.0)
    assert {(r["faithfulness_score"], r["judge_notes"], r["judge_error"]) for r in bad.collect()} == {(None, None, "down")}
    summary = E.generation_summary(bad).first()
    assert (summary["n_total"], summary["n_scored"], summary["avg_fluency"], summary["gold_source_covered_rate"]) == (2, 0, 0.0, None)
    assert E.generation_summary(bad.limit(0)).first()["n_total"] == 0
    with pytest.raises(ValueError, match="reference"):
        E.generation_report(sheet.drop("reference"), answered, FixedJudge())


def test_verdict_parsing(spark):
    lacking = json.dumps({k: v for k, v in json.loads(GOOD).items() if k != "fluency"})
    rows = spark.createDataFrame([(f"```json {GOOD}```",), (f"noise {GOOD} noise",), (lacking,), ("no",)], "raw string")
    got = [r["p"] for r in rows.select(E.parse_verdict(F.col("raw")).alias("p")).collect()]
    assert [p["verdict"] is not None for p in got] == [True, True, False, False] and "fluency" in got[2]["error"]


def test_bfs_and_crawl(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (9, 8)], "src long, dst long")
    assert {(r["node"], r["depth"]) for r in bfs_levels(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2)}
    site, page = Site(domain="e.com", section="/h/"), "<html><body><p>%s</p><a href='%s'>x</a><a href='/h/f.pdf'>y</a></body></html>"
    pages = {"https://e.com/h/a": ("text/html", (page % ("ابتثج", "/h/b")).encode()), "https://e.com/h/b": ("text/html", (page % ("latin", "/h/a#z")).encode()), "https://e.com/h/c": ("image/png", b"")}
    seeds = spark.createDataFrame([("https://e.com/h/a#top",), ("https://e.com/h/c",)], "url string")
    got, files = crawl(seeds, TableFetcher(pages), site)
    assert [(r["url"], r["depth"], r["text"]) for r in got.collect()] == [("https://e.com/h/a", 0, "ابتثج")]
    assert {r["url"] for r in files.collect()} == {"https://e.com/h/f.pdf"}
    assert crawl(seeds, TableFetcher(pages), site, max_pages=1)[1].count() == 0


def test_documents_to_store_and_back(spark, tmp_path):
    good, poor = "نص عربي طويل بما يكفي. جملة ثانية هنا", "latin only page text here"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book.txt").write_text(f"{good}\f{poor}\fص", encoding="utf-8")
    rows = documents.chunk_local_documents(spark, str(tmp_path / "in"), FormFeedText())
    assert [(r["id"], r["page_number"]) for r in rows.collect()] == [("book_page_1_chunk_1", 1)]
    url = "https://e.com/x/book.txt?q"
    remote = documents.chunk_remote_documents(spark.createDataFrame([(url,), ("gone",)], "url string"), TableFetcher({url: ("t", good.encode())}), FormFeedText())
    assert [(r["metadata"]["source"], r["metadata"]["chunk"]) for r in remote.collect()] == [("book", 1)]
    web = documents.web_rows(spark.createDataFrame([("u", "t"), ("v", "")], "url string, text string"), "site")
    both = rows.unionByName(remote).unionByName(web)
    spark.sql("DROP TABLE IF EXISTS vectors")
    store.create(spark, "vectors")
    for _ in range(2):
        store.add(both, "vectors", HashingEmbedder())
    assert spark.table("vectors").count() == 3 and store.duplicate_ids(spark.table("vectors")).count() == 0
    spark.sql("DROP TABLE vectors")


def test_jsonl_and_sheets(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": "é", "b": 1}\n\n{bad\n[1,2]\n{"a": "z"}\n', encoding="utf-8")
    assert [(r["a"], r["b"]) for r in jsonl.read(spark, str(path), "a string, b int").collect()] == [("é", 1), ("z", None)]
    assert {r["line"] for r in jsonl.rejects(spark, str(path)).collect()} == {"{bad", "[1,2]"}
    assert [tuple(r) for r in jsonl.preview(spark, str(path), 2, ["a", "c"]).collect()] == [("é", None), ("z", None)]
    jsonl.write(spark.createDataFrame([("ص",)], "a string"), str(tmp_path / "out"), one_file=True)
    assert "ص" in next((tmp_path / "out").glob("part*")).read_text(encoding="utf-8")
    df = spark.createDataFrame([("1", 'say "hi"\nthere')], sheets.QUESTIONS)
    sheets.write_report(df, df, str(tmp_path / "rep"))
    assert sheets.read_sheet(spark, str(tmp_path / "rep" / "summary"), sheets.QUESTIONS).collect() == df.collect()
    sheets.write_sheet(df, str(tmp_path / "bom.csv"), bom=True)
    assert (tmp_path / "bom.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_chat_stream_equals_batch(spark, tmp_path):
    meta = f"struct<{META.replace(' ', ':').replace(',:', ',')}>"
    e = HashingEmbedder()
    docs = [("a", "red apples grow"), ("b", "blue birds fly")]
    collection = spark.createDataFrame([(i, t, e.embed([t], "p")[0].tolist(), pdf(i, 1)) for i, t in docs], f"id string, content string, embedding array<float>, metadata {meta}")
    messages = spark.createDataFrame([(1, 0, "user", "/start"), (1, 1, "user", "apples"), (1, 2, "assistant", "x"), (2, 0, "user", " "), (2, 1, "user", "birds")], chat.MESSAGES)
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    reply = lambda batch: chat.replies(batch, collection, e, OverlapReranker(), FirstContextLLM())
    query = chat.serve(chat.read_messages(spark, str(tmp_path / "in")), reply, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("qid", "reply", "status").collect()))
    assert got == sorted(map(tuple, reply(messages).collect())) and {g[2] for g in got} == {"greeted", "answered"}
    broken = chat.replies(messages, collection, e, OverlapReranker(), Broken()).where("status = 'failed'").collect()
    assert {r["reply"] for r in broken} == {PHRASES.apology} and len(broken) == 2


def test_chunk_plan_has_no_python(spark):
    plan = QUERIES["chunk_documents"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|ArrowEval|MapIn", plan) and "Exchange" not in plan


def test_backlog_is_discarded(spark, tmp_path):
    import os
    from datetime import datetime, timedelta

    for k in range(2):
        spark.createDataFrame([(k, 0, "user", f"message {k}")], chat.MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not k:
            for old in (tmp_path / "in").glob("part*"):
                os.utime(old, (1_000_000_000, 1_000_000_000))
    got: list[int] = []
    stream = chat.read_messages(spark, str(tmp_path / "in"), since=datetime.now() - timedelta(hours=1))
    stream.writeStream.foreachBatch(lambda batch, _: got.extend(r["conv_id"] for r in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got == [1]


def test_nearest_with_other_ids_and_lengths(spark):
    rows = [("2024-01-01", [1.0, 0.0]), ("2024-01-02", [0.0, 1.0]), ("2024-01-03", [1.0]), ("2024-01-04", []), ("2024-01-05", [2.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, embedding array<double>").withColumn("id", F.to_date("id"))
    queries = spark.createDataFrame([(1.5, [1.0, 0.0]), (2.5, [3.0]), (3.5, [])], "qid double, embedding array<double>")
    got = [(r["qid"], str(r["id"]), r["pos"]) for r in R.nearest(queries, v, 2).orderBy("qid", "pos").collect()]
    assert got == [(1.5, "2024-01-01", 1), (1.5, "2024-01-05", 2), (2.5, "2024-01-03", 1)]


def test_unanswered_questions_are_reported(spark):
    sheet = spark.createDataFrame([("1", "q", 0, "s"), ("2", "q", 1, "s")], sheets.EVALUATION)
    answered = spark.createDataFrame([("2", "x [1]", ["c"], ["s"])], "qid string, answer string, contexts array<string>, sources array<string>")
    got = {r["qid"]: r for r in E.generation_report(sheet, answered, FixedJudge()).collect()}
    assert got["1"]["answer"] == PHRASES.no_results and got["1"]["abstention_correct"] and not got["1"]["used_gold_source"]


def test_evaluation_answers_with_its_own_refusal(spark):
    meta = f"struct<{META.replace(' ', ':').replace(',:', ',')}>"
    e = HashingEmbedder()
    collection = spark.createDataFrame([("a", "red apples", e.embed(["red apples"], "p")[0].tolist(), pdf("a", 1))], f"id string, content string, embedding array<float>, metadata {meta}")
    questions = spark.createDataFrame([("q", "red apples?")], "qid string, question string")
    ask = lambda c: E.run_rag(questions, c, e, OverlapReranker(), FirstContextLLM()).first()["answer"]
    assert ask(collection) == "red apples [1]" and ask(collection.limit(0)) == PHRASES.no_results


def test_pages_in_other_character_sets(spark):
    rows = [("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), ('<meta charset="windows-1256">'.encode() + "سلام".encode("cp1256"), "text/html"), ("é".encode(), None), (b"x", "text/html; charset=none-such"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary, t string").select(documents.decoded(F.col("b"), F.col("t"))).collect()]
    assert got[0] == got[2] == "é" and got[1].endswith("سلام") and got[3:] == ["x", None]


def test_composed_forms_are_nfkc():
    import unicodedata

    from docloom.plans.queries import FORMS

    assert all(unicodedata.normalize("NFKC", a) == b for a, b in FORMS)


def test_digits_of_any_script_are_citations(spark):
    from docloom.functions.citations import citation_ids

    assert spark.createDataFrame([("[᠓] [৪] [1٢]",)], "a string").select(citation_ids(F.col("a"))).first()[0] == [3, 4, 12]


class Counted:
    made = 0

    def __init__(self, dimension: int):
        Counted.made += 1
        self.dimension = dimension

    def embed(self, texts, task):
        return HashingEmbedder(self.dimension).embed(texts, task)


def test_models_are_made_once_and_not_sent():
    import pickle

    from docloom.plugins import PerWorker

    one, two = (pickle.loads(pickle.dumps(PerWorker(Counted, 8))) for _ in range(2))
    assert len(one.embed(["a"], "p")[0]) == two.dimension == 8 and Counted.made == 1
