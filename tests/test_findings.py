"""What reviews found: each test failed before its finding was settled."""

import random
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.config import Site
from docloom.functions import html as H
from docloom.functions import text as T
from docloom.functions.chunk import chunk_text, chunks
from docloom.operators import retrieve as R
from docloom.operators.crawl import crawl
from docloom.plans.oracles import ORACLES
from docloom.plans.queries import QUERIES
from docloom.plugins import FormFeedText
from docloom.sources import documents as D


def both(spark, name, folder, **tables):
    """Rows of a query and of its SQL over small tables (columns, rows)."""
    db = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in got.columns]
    return sorted(repr(tuple(r)) for r in got.collect()), sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


@pytest.mark.parametrize("cut", ["&", "&a", "&am", "&amp", "&ampx y", "&#3", "&#39", "&amp;", "&#39;"])
def test_references_cut_short_are_as_in_sql(spark, tmp_path, cut):
    page = "<html><body><article><h1>title" + cut + "</h1><p>" + "word &amp; " * 40 + "</p></article></body></html>"
    got, want = both(spark, "html_selected_text", tmp_path, pages=("page_id long, url string, html string", [(1, "u", page), (2, "u", page)]))
    assert got == want


def test_references_cut_short_are_decoded_by_default():
    page = "<p>a&amp</p><p>b &#39 c &lt;</p>"
    assert H.tree_text(page) == "a& b ' c <" and H.tree_text(page, open_references=False) == "a&amp b &#39 c <"


def test_scores_of_a_full_block_of_queries_take_little_memory():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 4, (n, 8)) + np.eye(8)[rng.integers(0, 8, n)] for n in (R.QUERY_BLOCK, 5000))  # with many ties
    y[::700] = 0
    names = [f"d{k}" for k in range(len(y))]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(y.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "embedding"])
    schema = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("similarity", pa.float64())])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    out = list(R._score(SimpleNamespace(value=(list(range(len(x))), unit)), 5, 6, schema)([batch]))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 40, f"{peak:.0f} MB"  # 204 MB before
    got = pa.Table.from_batches(out).to_pylist()
    assert len(got) == 5 * len(x)
    for q in range(0, len(x), 97):
        with np.errstate(invalid="ignore"):
            s = np.round(unit[q] @ (y / np.linalg.norm(y, axis=1)[:, None]).T, 6)
        want = sorted((-a, i) for a, i in zip(s, names) if not np.isnan(a))[:5]
        assert sorted((-r["similarity"], r["id"]) for r in got if r["qid"] == q) == want


def test_chunks_of_texts_in_python_are_those_of_columns(spark):
    r = random.Random(5)
    bits = [*"ابتثجحخ ي  ..,،؟!\n\n\t:a1_-/\x1c\x85\xa0ًـﻻﷲ①²٣é", "😀", "كلمة ", "طويلة جدا ", "\r\n", "الفصل ", "مقدمة", "خاتمة ", "أولاً", "\nثانياًب "]
    texts = ["", " \n", *("".join(r.choices(bits, k=r.choice((5, 40, 200, 900)))) for _ in range(300)), *("".join(r.choices("ابت ي", k=k)) for k in (149, 150, 151, 300, 301, 800))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n")).select("t", "n", chunks(F.col("n")).alias("c"), chunks(F.col("t")).alias("raw"), T.letter_gate(F.col("n")).alias("ok"))
    for x in rows.collect():
        assert T.normalized(x["t"]) == x["n"] and T.has_letters(x["n"], 10) == x["ok"]
        assert chunk_text(x["n"]) == x["c"] and chunk_text(x["t"]) == x["raw"]


def test_documents_are_chunked_where_their_pages_are_read(spark):
    files = spark.createDataFrame([("in/a.pdf", bytearray("نص عربي طويل بما يكفي\fx".encode()))], "path string, content binary")
    rows = D.chunk_files(files, FormFeedText())
    assert [(x["id"], x["content"]) for x in rows.collect()] == [("a_page_1_chunk_1", "نص عربي طويل بما يكفي")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "aggregate(" not in plan


def test_a_crawl_of_a_table_moves_no_bodies_at_each_level(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def seen(body):
        read.add(1)
        return body

    page = "<html><body><p>نص عربي</p><a href='/p/{}'>x</a></body></html>"
    rows = [(f"https://e.com/p/{k}", "text/html", bytearray(page.format(k + 1).encode())) for k in range(6)]
    held = spark.createDataFrame(rows, "url string, content_type string, body binary").withColumn("body", seen("body"))
    pages, files = crawl(spark.createDataFrame([(rows[0][0],)], "url string"), held, Site(domain="e.com", section="/p/"))
    assert sorted((r["depth"], r["url"]) for r in pages.collect()) == [(k, rows[k][0]) for k in range(6)] and files.count() == 0
    assert read.value <= 3 * len(rows)  # whatever the number of levels, of which there are six
