"""Quality rules in DataFrame functions only.

Base features are computed inside each row with array functions, so no text is shuffled.  The method's rule is
cross-document line frequency: lines are normalised and hashed, the distinct documents of each host that hold a
line are counted, lines above the host's limit are removed, and a document that loses too much is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, lookup, text_key

_WORDS = r"[\x20\x09-\x0D]+"
#: A line goes if more documents of its host hold it than either of these.
LEAST_DOCS, HOST_SHARE = 5, 0.02
#: Lines above limits that are broadcast at most, of all hosts together.
MOST_LINES = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _WORDS), "")


def line_hashes(text: Column) -> Column:
    """64 bits of each line of a text without case, digits, outer white space and runs of it; 0 for a line without a word."""
    even = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(even, "\n"), lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(x))))


def with_base(docs: DataFrame) -> DataFrame:
    """The base columns of every row, with `_text`, `_host` and `_key` for the line rule."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"))
    rows = rows.select("*", text_key(F.col("_text")).alias("_key"), words_of(F.col("_text")).alias("_words"))
    n = F.size("_words")
    # Window i is the hash of words i .. i + 4; equal windows are adjacent once sorted.
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "_text", "_host", "_key", n.cast("long").alias("n_words"), hashes.alias("_h"), lines.alias("_lines"), F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"))
    pairs = F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.transform("_h", lambda _, i: i).alias("i")))
    rows = rows.select(
        "doc_id", "_text", "_host", "_key", "n_words", "word_chars",
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).alias("_pairs"),
    )
    # A window counts if its neighbour on either side has its hash; covered words are summed over the sorted starts.
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_pairs", 1, F.size("_pairs") - 1))
    after = F.concat(F.slice("_pairs", 2, F.size("_pairs") - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    both = F.arrays_zip(F.col("_pairs").alias("p"), before.alias("b"), after.alias("a"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    starts = F.transform(F.filter(both, lambda z: same(z["p"], z["b"]) | same(z["p"], z["a"])), lambda z: z["p"]["i"])
    rows = rows.withColumn("_starts", F.when(F.col("_pairs").isNotNull(), F.sort_array(starts)))
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(5), x + F.lit(5) - acc["end"])).alias("n"), (x + F.lit(5)).alias("end"))
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_pairs", "_starts")


def lines_above_limit(docs: DataFrame, least_docs: int = LEAST_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(_host, _hash) of each line that a host has in more distinct documents than its limit.

    A host's limit is the larger of `least_docs` and `host_share` of its documents.  Lines are first counted once for
    each row, map-side; rows that repeat a document matter only for the few lines which pass that, so distinct
    documents are counted for those alone.
    """
    host, text = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), host, text_key(text).alias("_key"), F.explode(F.array_distinct(line_hashes(text))).alias("_hash")).where("_hash != 0")
    limits = docs.groupBy(host).agg(F.greatest(F.lit(float(least_docs)), F.count(F.lit(1)) * host_share).alias("_limit"))
    often = rows.groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > least_docs)
    often = checkpointed(lookup(often, checkpointed(limits), ["_host"], F.col("_hash")).where("_c > _limit").select("_host", "_hash", "_limit"))
    held = lookup(rows, often, ["_host", "_hash"], F.col("_key")).distinct().groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_held"), F.first("_limit").alias("_limit"))
    return held.where("_held > _limit").select("_host", "_hash")


def without_lines(text: Column, gone: Column) -> Column:
    """`text` without the lines whose hash is among `gone`; null `gone` removes none."""
    both = F.arrays_zip(F.split(text, "\n").alias("line"), line_hashes(text).alias("hash"))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(F.filter(both, lambda x: ~F.array_contains(gone, x["hash"])), lambda x: x["line"]), "\n"))


def quality_rules(docs: DataFrame, least_docs: int = LEAST_DOCS, host_share: float = HOST_SHARE, min_left: float = 0.3, min_words_left: int = 10) -> DataFrame:
    """One row per input row: base columns, n_removed_words, kept, and text without the lines above its host's limit.

    Every line with a word counts, whatever its length.  kept is false if the base rules fail, or if the text that is
    left has fewer than `min_words_left` words or less than `min_left` of them.  A null text is an empty one (0 words:
    it fails), a null source is the host "".  Rows that repeat doc_id and text are one document for the counts and each
    get a row; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text", "source")
    above = checkpointed(lines_above_limit(docs, least_docs, host_share))
    few = above.limit(MOST_LINES + 1).count() <= MOST_LINES  # the table that is sent has a bound in lines, not only in hosts
    above = above.groupBy("_host").agg(F.collect_list("_hash").alias("_gone"))
    full = lookup(with_base(docs), above, ["_host"], F.col("_key"), "left", 100_000 if few else 0)
    full = full.withColumn("text", without_lines(F.col("_text"), F.col("_gone")))
    left = F.when(F.col("_gone").isNull(), F.col("n_words")).otherwise(F.size(words_of(F.col("text"))).cast("long"))
    full = full.withColumn("_left", left)
    kept = ~F.col("base_failed") & (F.col("_left") >= min_words_left) & (F.col("_left") >= min_left * F.col("n_words"))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("n_words") - F.col("_left")).alias("n_removed_words"), kept.alias("kept"), "text")
