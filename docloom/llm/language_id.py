"""Language identification by Bayesian evidence fusion.

For each document four independent pieces of evidence are added in log space: the text's likelihood under
character-trigram models, the language that its markup declares, its address suffix, and its host's prior.  The last
three come from grouped aggregations of the text posteriors over the whole corpus.  A host's counts are smoothed towards
its registered domain's, those towards the corpus.  What a declaration or a suffix says is its share among the documents
of each language; a declaration is taken to be right nine times in ten before any document is seen (`trust`, worth
`smooth` documents), of a suffix nothing is known beforehand.  A class "und" with a uniform likelihood stands for text
in no known language; a document is rejected if that class wins.

The trigram models are fitted on a bounded sample of labelled rows (`sample_rows` for each language, however many
languages); all else uses every row and every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import batches, checkpointed, lookup, packed, records, small, text_key, unpacked

BINS = 1 << 16
UND = "und"
UNSEEN = 0.3
_LETTERS = np.array([1, 0x9E3779B1, 0x85EBCA77], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Bins of the character trigrams of the lower-cased text with a space at either end."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = a[:-2] * _LETTERS[1] + a[1:-1] * _LETTERS[2] + a[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Log likelihoods of trigram bins: one column for each language, the last for "und"."""

    languages: list[str]
    table: np.ndarray = field(default_factory=lambda: np.zeros((BINS, 1), np.float32))

    def likelihoods(self, text: str, step: int = 1 << 15) -> np.ndarray:
        bins, total = trigrams(text), np.zeros(self.table.shape[1])
        for at in range(0, len(bins), step):
            total += self.table[bins[at : at + step]].sum(0, dtype=np.float64)
        return total


def fit(rows: Iterable[tuple[str, str]]) -> Model:
    """(language, text) rows to a model; without rows it knows only "und"."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        if lang and text:
            counts.setdefault(lang, np.zeros(BINS))
            counts[lang] += np.bincount(trigrams(text), minlength=BINS)
    return _model({lang: (np.arange(BINS), n) for lang, n in counts.items()})


def _model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from the bins of each language and how often each occurs."""
    languages = sorted(counts)
    table = np.full((BINS, len(languages) + 1), np.log(UNSEEN * 8 / BINS), np.float32)
    for k, lang in enumerate(languages):
        bins, n = counts[lang]
        # A share of the uniform likelihood keeps numbers, names and secrets from outweighing the rest.
        table[bins, k] = np.log((1 - UNSEEN) * n / max(1.0, n.sum()) + UNSEEN * 8 / BINS)
    table[:, -1] = np.log(8 / BINS)
    return Model(languages, table)


def fit_on(docs: DataFrame, sample_rows: int = 400) -> Model:
    """Fit every label in `lang` on about `sample_rows` of its rows, twice as many at most, chosen by a hash of doc_id.

    Trigrams are counted where the rows are; the driver sees one row of counts for each label.
    """
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang != '' and text != ''")
    shares = labelled.groupBy(F.col("lang").alias("_l")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / sample_rows)).alias("_share"))
    some = labelled.join(small(checkpointed(shares)), F.col("lang") == F.col("_l")).where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.col("_share")) == 0)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id", text_key(F.col("text"))))
    some = some.select("lang", "text", turn.alias("_turn")).where(F.col("_turn") <= 2 * sample_rows).select("lang", "text")

    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def count(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for lang, text in records(arrow, 16):
            counts.setdefault(lang, np.zeros(BINS, np.int64))
            counts[lang] += np.bincount(trigrams(text), minlength=BINS)
        for lang, n in counts.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(n[bins])], schema=schema)

    got = some.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("x")).collect()
    return _model({r["lang"]: (np.array([x["bin"] for x in r["x"]], np.int64), np.array([x["n"] for x in r["x"]], np.int64)) for r in got})


def declared_language(text: Column) -> Column:
    """The language that the first lang attribute of an html or body tag declares, or null."""
    tags = F.array_join(F.regexp_extract_all(text, F.lit(r"(?i)<(?:html|body)\b([^<>]*+)>"), 1), " ")
    got = F.regexp_extract(tags, r"(?i)(?:^|[\s\"'])(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1)
    return F.when(text.contains("<"), F.nullif(F.lower(got), F.lit("")))


def host_of(address: Column) -> Column:
    """Host part of an address, or the address itself if it has none; null counts as an empty one."""
    bare = F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(bare, r"^(?:[^/?#]*@)?([^/:?#]*)", 1)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.[^.]*|[^.]*)$", 1)


def suffix_of(host: Column) -> Column:
    """The two-letter suffix of a host, or null."""
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit(""))


_SCORED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("host", pa.string()), ("declared", pa.string()), ("suffix", pa.string()), ("ll", pa.list_(pa.float64()))])


def says(votes: dict[str, np.ndarray], languages: list[str], trust: float | None, smooth: float) -> dict[str, np.ndarray]:
    """Log likelihood of each sign (a declared code, a suffix) under each class, from the votes of the documents that have it.

    A class's shares of signs are smoothed towards what is known beforehand: the sign's share in the corpus, and if
    `trust` is given, that much for the sign that names the language itself.
    """
    if not votes:
        return {}
    every = sum(votes.values())
    out = {}
    for sign, own in votes.items():
        share = own.sum() / every.sum()
        known = np.full(len(languages) + 1, share)
        if trust is not None:
            known[:-1] = [trust if x == sign else (1 - trust) * share for x in languages]
        out[sign] = np.log((own + smooth * known) / (every + smooth))
    return out


def identify_languages(docs: DataFrame, model: Model, address: str = "source", smooth: float = 20.0, trust: float = 0.9) -> DataFrame:
    """doc_id, key (hash of the text), lang_pred, confidence, declared, suffix, kept: one row per input row.

    Null and empty texts have no evidence of their own and are rejected ("und"), as is text whose trigrams fit no
    language better than chance; ties go to the first language in order.  Without a fitted language nothing can be
    rejected: lang_pred is null and kept true.  A null address is the host "".  Repeated rows repeat; an empty
    table gives no rows; other columns are ignored.  The driver sees the counts of declared codes and of suffixes, of
    two and three letters, so 18,252 at most, and one of each class; hosts stay where they are.
    """
    n = len(model.languages)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    host = host_of(F.col(address).cast("string"))
    plain = F.when(text.contains("<"), F.regexp_replace(text, r"</?[A-Za-z][^<>]*+>", " ")).otherwise(text)

    def score(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((*row[:5], model.likelihoods(row[5]).tolist()) for row in records(arrow)), _SCORED)

    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("key"), host.alias("host"), declared_language(text).alias("declared"), suffix_of(host).alias("suffix"), plain.alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, key long, host string, declared string, suffix string, ll array<double>")
    if not n:
        return scored.select("doc_id", "key", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("confidence"), "declared", "suffix", F.lit(True).alias("kept"))
    scored = checkpointed(scored)
    languages, log = model.languages, np.log

    @F.pandas_udf("array<long>")
    def votes(ll: pd.Series) -> pd.Series:
        x = np.stack(ll.to_numpy())
        p = np.exp(x - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[~x.any(1)] = 0  # a text without trigrams has no vote
        return pd.Series(list(np.rint(p * 1e6).astype(np.int64)))  # whole numbers: sums don't depend on their order

    # One row for each host and class with votes: the plan's size doesn't depend on the number of languages.
    cast = scored.select("host", "declared", "suffix", F.posexplode(votes("ll")).alias("k", "n")).where("n > 0")
    counts = checkpointed(cast.groupBy("host", "declared", "suffix", "k").agg(F.sum("n").alias("n")))

    def seen(sign: str) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for x, k, total in counts.where(F.col(sign).isNotNull()).groupBy(sign, "k").agg(F.sum("n")).collect():
            out.setdefault(x, np.zeros(n + 1))[k] = total / 1e6
        return out

    by_markup, by_suffix = says(seen("declared"), languages, trust, smooth), says(seen("suffix"), languages, None, smooth)
    every = np.zeros(n + 1)
    for k, total in counts.groupBy("k").agg(F.sum("n")).collect():
        every[k] = total / 1e6
    corpus = (every + 1) / (every.sum() + n + 1)
    hosts = counts.groupBy("host", "k").agg(F.sum("n").alias("n")).groupBy("host").agg(F.collect_list(F.struct("k", "n")).alias("own")).withColumn("domain", domain_of(F.col("host")))
    domains = counts.groupBy(domain_of(F.col("host")).alias("domain"), "k").agg(F.sum("n").alias("n")).groupBy("domain").agg(F.collect_list(F.struct("k", "n")).alias("above"))

    @F.pandas_udf("array<double>")
    def log_prior(k: pd.Series, votes: pd.Series, domain_k: pd.Series, domain_votes: pd.Series) -> pd.Series:
        out = []
        for row in zip(k, votes, domain_k, domain_votes):
            own, above = np.zeros(n + 1), np.zeros(n + 1)
            own[row[0]], above[row[2]] = row[1] / 1e6, row[3] / 1e6
            by_domain = (above + smooth * corpus) / (above.sum() + smooth)
            out.append(log((own + smooth * by_domain) / (own.sum() + smooth)))
        return pd.Series(out)

    priors = checkpointed(lookup(hosts, domains, ["domain"], F.col("host")).select("host", log_prior("own.k", "own.n", "above.k", "above.n").alias("prior")))

    @F.pandas_udf("lang_pred string, confidence double")
    def fuse(ll: pd.Series, prior: pd.Series, declared: pd.Series, suffix: pd.Series) -> pd.DataFrame:
        x = np.stack(ll.to_numpy()) + np.stack([log(corpus) if p is None else p for p in prior])
        for k, (d, s) in enumerate(zip(declared, suffix)):
            if d in by_markup:
                x[k] += by_markup[d]
            if s in by_suffix:
                x[k] += by_suffix[s]
        p = np.exp(x - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[~np.stack(ll.to_numpy()).any(1)] = [0] * n + [1]  # no text at all
        return pd.DataFrame({"lang_pred": [[*languages, UND][k] for k in p.argmax(1)], "confidence": p.max(1).round(4)})

    fused = lookup(scored, priors, ["host"], F.col("key"), "left").withColumn("got", fuse("ll", "prior", "declared", "suffix"))
    return fused.select("doc_id", "key", "got.lang_pred", "got.confidence", "declared", "suffix", (F.col("got.lang_pred") != UND).alias("kept"))


def keep_known(docs: DataFrame, sample_rows: int = 400) -> DataFrame:
    """The rows of `docs`, unchanged whatever their columns' names, whose language is known."""
    verdicts = identify_languages(docs, fit_on(docs, sample_rows))
    last = F.lit(2**63 - 1)
    gone = checkpointed(verdicts.where(~F.col("kept")).select(F.coalesce("doc_id", last).alias("own"), F.col("key").alias("hash")).distinct())
    rows = packed(docs, own=F.coalesce(F.col("doc_id").cast("long"), last), hash=text_key(F.col("text").cast("string")))
    return unpacked(lookup(rows, gone, ["own", "hash"], F.col("hash"), "left_anti"), docs)
