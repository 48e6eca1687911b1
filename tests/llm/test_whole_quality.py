"""Frequent lines leave the text."""

from docloom.llm import quality
from tests.llm.test_native_operators import SCHEMA


def test_frequent_lines_leave_the_text(spark):
    boiler = "Click here 12 for the best offers"
    own = lambda k: chr(97 + k % 26) * (1 + k // 26)  # noqa: E731  digits would make the lines alike
    rows = [(k, f"own {own(k)}\n{boiler}\n\nlast {own(k)}" if k < 30 else boiler, "h") for k in range(35)] + [(90, boiler, "other"), (91, None, "h")]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA), least_docs=20).collect()}
    assert all(got[k]["text"] == f"own {own(k)}\n\nlast {own(k)}" and got[k]["n_removed_words"] == 7 for k in range(30))
    assert all(got[k]["text"] == "" for k in range(30, 35)) and got[90]["text"] == boiler and got[91]["text"] == ""


def test_production_limits_decide_on_any_host(spark):
    """Lines that differ in white space, case and digits only are one line; short lines and lines without spaces count."""
    ends = ["\r", "", " \t", "\x0b"]
    own = lambda k: " ".join(chr(97 + k % 26) * (1 + k // 26) + chr(97 + i) for i in range(14))
    rows = [(k, f"{own(k)}\n{'HOME' if k % 2 else ' home'}{ends[k % 4]}\n日本語の行\nPage {k}\x0c of  9", "h") for k in range(12)]
    rows += [(20 + k, f"{own(k)}\nhome", "small") for k in range(5)] + [(20, f"{own(0)}\nhome", "small")] * 3
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k]["text"] == own(k) and got[k]["n_removed_words"] == 6 and got[k]["kept"] for k in range(12))
    assert all(got[20 + k]["n_removed_words"] == 0 for k in range(5))  # five documents, however often one is repeated


def test_hosts_beyond_a_broadcast(spark, monkeypatch):
    rows = [(k, f"line of all\nown {k}a b c d e f g h i j k l m n o p", f"h{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, quality.quality_rules(df).collect()))
    monkeypatch.setattr(quality, "MOST_LINES", 0)
    assert sorted(map(tuple, quality.quality_rules(df).collect())) == want and all(x[7] for x in want)


def test_the_line_rule_decides_on_the_tables(spark):
    got = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.where("n_removed_words > 0").count() > 100
