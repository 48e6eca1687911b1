"""Dedup operators against brute force, planted cases and edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from docloom.llm import common, line_dedup, near_dup, suffix_dedup

SCHEMA = "doc_id long, text string, source string"


def brute_repeats(docs):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking up every 50-byte string."""
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, x in rows:
        for i in range(len(x) - 49):
            s = x[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, x in rows:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "é", "日本", "x", "aaaa"]
    say = lambda k: " ".join(rnd.choice(words) + str(rnd.randrange(60)) for _ in range(k))
    shared = [say(k) for k in (8, 15, 40)]
    docs = []
    for d in range(n):
        parts = [say(rnd.randrange(1, 30))]
        for s in shared:
            if rnd.random() < 0.3:
                cut = rnd.randrange(0, len(s) // 2)
                parts.append(s[cut : len(s) - rnd.randrange(0, len(s) // 3)])
        rnd.shuffle(parts)
        docs.append((d, rnd.choice(["\n", " "]).join(parts)))
    docs += [(n + k, docs[k][1]) for k in range(10)]
    docs += [(n + 20, "a" * 300), (n + 21, "b" + "a" * 60), (n + 22, None), (n + 23, ""), (n + 24, "ab" * 200), (n + 25, "ba" * 40), (3, docs[5][1]), (None, docs[7][1]), (4, docs[4][1])]
    return docs


@pytest.mark.parametrize("hot", [2, 64])
def test_repeats_match_brute_force(spark, hot):
    docs = corpus(hot)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), blocks=6, hot_blocks=hot).collect()
    assert Counter((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == brute_repeats(docs)


def test_refinement_decides_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lambda **p: {(r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs, **p).collect()}
    whole, without = rows(), rows(refined=False)
    assert sum(x[1] for x in whole) > sum(x[1] for x in without) + 10_000
    shown = docs.select("doc_id", "text").collect()
    assert Counter({x: 1 for x in whole}) == Counter((d, removed, spans) for d, _, removed, spans, _ in brute_repeats([tuple(r) for r in shown]))


def test_packed_ids_return():
    for ids in ([5], [2**63 - 1, 0, -7], list(range(10)), [-(2**63), 2**63 - 1], [2**63 - 1, 2**63 - 3]):
        x = np.array(ids, np.int64)
        assert (suffix_dedup.unpack_ids(suffix_dedup.pack_ids(x)) == x).all()


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refined_buckets_match_a_dictionary():
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"ab") for _ in range(400))
    contexts = [base[(s := rnd.randrange(0, 300)) : s + rnd.randrange(50, 100)] for _ in range(60)]
    docs = np.array([rnd.randrange(100) for _ in contexts])
    least = {}
    for c, d in zip(contexts, docs.tolist()):
        for i in range(len(c) - 49):
            least[c[i : i + 50]] = min(d, least.get(c[i : i + 50], d))
    for c, got in zip(contexts, suffix_dedup.refine_buckets(contexts, docs)):
        assert got.tolist() == [least[c[i : i + 50]] for i in range(len(c) - 49)]


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def test_signatures_estimate_weighted_jaccard():
    rnd = random.Random(1)
    a = [rnd.randrange(300) for _ in range(900)]
    b = a[:700] + [rnd.randrange(300) for _ in range(300)]
    bag = lambda x: (np.array(sorted(set(x)), np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([Counter(x)[k] for k in sorted(set(x))]))
    order = lambda x: (x[0][np.argsort(x[0])], x[1][np.argsort(x[0])])
    x, y = order(bag(a)), order(bag(b))
    true = near_dup.weighted_jaccard(x, y)
    ca, cb = Counter(a), Counter(b)
    assert abs(true - sum((ca & cb).values()) / sum((ca | cb).values())) < 1e-12
    agree = np.mean(near_dup.bag_min_hash(*x, 4096) == near_dup.bag_min_hash(*y, 4096))
    assert abs(agree - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert (near_dup.bag_min_hash(*x) == near_dup.bag_min_hash(*x)).all()


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(7)
    docs, d = [], 0
    for _ in range(30):
        base = words(rnd, rnd.choice([4, 30, 120, 400]))
        for _ in range(rnd.choice([1, 1, 2, 5, 14])):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(base) // 30])):
                own[rnd.randrange(len(own))] = "new" + str(rnd.random())
            docs.append((d, " ".join(own) if rnd.random() < 0.5 else "\n ".join(own)))
            d += 1
    docs += [(d, None), (d + 1, ""), (d + 2, " \n"), (d + 3, "one two"), (d + 4, "one  two"), (None, docs[0][1]), (5, docs[9][1]), (6, docs[6][1])]
    bags = [near_dup.shingles(t or "") for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = [(2**63 - 1 if i is None else i) for i, _ in docs]
    for i in range(len(docs)):
        for j in range(i):
            if near_dup.weighted_jaccard(bags[i], bags[j]) >= 0.8 or docs[i] == docs[j]:
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i in range(len(docs)):
        least[find(i)] = min(least.get(find(i), order[i]), order[i])
    want = Counter((order[i], least[find(i)]) for i in {x: k for k, x in enumerate(docs)}.values())
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    null = lambda x: 2**63 - 1 if x is None else x
    assert Counter((null(r["doc_id"]), null(r["class_id"])) for r in got) == want
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_of_wandering_families_are_whole(spark, monkeypatch):
    """Texts that drift away from their family's first: large buckets hold many that aren't like their leader."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rnd = random.Random(11)
    docs = []
    for _ in range(3):
        family = [words(rnd, 400)]
        while len(family) < 45:
            own = list(rnd.choice(family[-6:]))
            for _ in range(rnd.choice([3, 8, 8, 9, 10])):
                own[rnd.randrange(len(own))] = "new" + str(rnd.random())
            family.append(own)
        docs += [" ".join(x) for x in family]
    rnd.shuffle(docs)
    bags = [near_dup.shingles(t) for t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and near_dup.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(root))


@pytest.mark.parametrize("bucket", [1, 3, 10_000])
def test_classes_dont_depend_on_the_bucket_size(spark, monkeypatch, bucket):
    """Links need a common band, however pairs meet: with few bands many similar pairs have none."""
    rnd = random.Random(13)
    docs, d = [], 0
    for _ in range(12):
        base = words(rnd, 60)
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.choice([1, 3, 4])):
                own[rnd.randrange(60)] = "new" + str(rnd.random())
            docs.append((d, " ".join(own)))
            d += 1
    bags = [near_dup.shingles(t) for _, t in docs]
    bands = [near_dup.bag_min_hash(*b).reshape(near_dup.BANDS, near_dup.ROWS) for b in bags]
    root = list(range(d))
    for i in range(d):
        for j in range(i):
            if root[i] != root[j] and near_dup.weighted_jaccard(bags[i], bags[j]) >= 0.6 and (bands[i] == bands[j]).all(1).any():
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", bucket)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.6).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(root))


def test_recall_of_similar_pairs_on_the_tables(spark):
    """All pairs of similarity 0.8 at sf0.01 are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shown = docs.selectExpr("doc_id", "coalesce(text, '') as text").collect()
    bags = {r["doc_id"]: near_dup.shingles(r["text"]) for r in shown}
    by: dict = {}
    for d, (items, _) in bags.items():
        for x in items.tolist():
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for held in by.values() for k, a in enumerate(held) for b in held[:k]}
    near = [(a, b) for a, b in pairs if near_dup.weighted_jaccard(bags[a], bags[b]) >= 0.8]
    of = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert len(near) > 50 and all(of[a] == of[b] for a, b in near)


def test_similar_pairs_are_those_of_the_exact_similarity(spark):
    rnd = random.Random(8)
    docs = [(k, " ".join(words(rnd, rnd.choice([5, 40, 300])))) for k in range(40)] + [(40, None), (41, "")]
    for k in range(40):
        own = docs[k][1].split()
        for _ in range(rnd.randrange(1 + len(own) // 15)):
            own[rnd.randrange(len(own))] = "new" + str(rnd.random())
        docs.append((100 + k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    node = F.struct(F.col("doc_id"), common.text_key(F.col("text")).alias("key"))
    one, two = df.select(node.alias("d")), df.where("doc_id < 42").select(node.alias("e"))
    pairs = one.join(two, F.col("d.doc_id") % 100 == F.col("e.doc_id") % 100)
    got = {(r["d"]["doc_id"], r["e"]["doc_id"]) for r in near_dup.similar_pairs(pairs, df).collect()}
    bags = {d: near_dup.shingles(t or "") for d, t in docs}
    assert got == {(a, b) for a in bags for b in bags if b < 42 and a % 100 == b and near_dup.weighted_jaccard(bags[a], bags[b]) >= 0.8}
    assert near_dup.similar_pairs(pairs.limit(0), df).count() == 0


def test_hot_keys_meet_in_several_tasks(spark):
    rows = spark.createDataFrame([(k, 1 if k < 900 else k) for k in range(1000)], "d long, h long")
    found = rows.groupBy("h").count().withColumnRenamed("count", "n")
    for most in (100_000, 0):
        joined = common.lookup(rows, found, ["h"], F.col("d"), most=most)
        assert sorted(map(tuple, joined.select("d", "n").collect())) == [(k, 900 if k < 900 else 1) for k in range(1000)]
    assert sorted(map(tuple, common.counted_join(rows, found, "h", F.col("d"), hot=100).select("d", "n").collect())) == [(k, 900 if k < 900 else 1) for k in range(1000)]


def test_dropping_keeps_one_of_each_class_and_other_columns(spark):
    rnd = random.Random(3)
    base = words(rnd, 60)
    near = base[:30] + ["other"] + base[31:]
    docs = [(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(words(rnd, 60)), "c"), (3, None, "d"), (4, " ".join(base), "e"), (1, " ".join(base), "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, e string").withColumnRenamed("e", "h")
    clash = df.selectExpr("*", *[f"1 as `{x}`" for x in ("own", "hash", "row", "key", "_id", "_key", "_own", "_hash", "a.b")])
    assert near_dup.drop_near_duplicates(clash).columns == clash.columns and near_dup.drop_near_duplicates(clash).count() == 3
    got = near_dup.drop_near_duplicates(df)
    assert sorted((r["doc_id"], r["h"]) for r in got.collect()) == [(1, "a"), (3, "c"), (3, "d")]


def test_components_of_a_chain_and_a_star(spark):
    edges = [((k, 0), (k + 1, 0)) for k in range(1, 12)] + [((100, 0), (k, 0)) for k in range(101, 130)]
    got = near_dup.components(spark.createDataFrame(edges, f"d {near_dup._NODE}, e {near_dup._NODE}")).collect()
    assert {r["node"]["doc_id"]: r["root"]["doc_id"] for r in got} == {**{k: 1 for k in range(2, 13)}, **{k: 100 for k in range(101, 130)}}


def test_patience_recurses_between_anchors():
    pairs = line_dedup.patience([1, 2, 3, 4], [9, 1, 2, 3, 8])
    assert pairs == [(0, 1), (1, 2), (2, 3)]
    assert line_dedup.patience([1, 5, 2, 3, 5, 4], [1, 30, 5, 31, 2, 3, 32, 5, 33, 4]) == [(0, 0), (1, 2), (2, 4), (3, 5), (4, 7), (5, 9)]
    assert line_dedup.patience([7, 7, 7], [7, 8, 7]) == [(0, 0), (1, 2)]
    assert line_dedup.patience([], [1]) == [] and len(line_dedup.patience([1, 2, 3], [3, 2, 1])) == 1
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randrange(30))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def brute_lines(docs, min_chars=32):
    """doc_id -> numbers of the lines that stand in a run of lines, long enough, which an earlier document holds: all pairs compared."""
    shown = {d: [(k, x) for k, line in enumerate((t or "").split("\n")) if (x := line.strip(" \t\n\x0b\x0c\r"))] for d, t in docs}
    out = {}
    for d in shown:
        gone = set()
        for e in shown:
            if e >= d:
                continue
            a, b = shown[e], shown[d]
            width = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i][1] == b[j][1]:
                        width[i + 1][j + 1] = n = width[i][j] + 1
                        if sum(len(b[j - k][1]) for k in range(n)) >= min_chars:
                            gone |= set(range(b[j - n + 1][0], b[j][0] + 1))
        out[d] = gone
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_deleted_lines_are_those_of_all_pairs(spark, seed):
    """Short lines, of which each is in many documents and whose first holders differ, blocks that move and repeat, blank lines."""
    rnd = random.Random(seed)
    lines = [f"short line nr {k:02d}" for k in range(20 if seed else 60)] + ["", " \t", "-" * 40]
    blocks = [[rnd.choice(lines) for _ in range(rnd.choice([2, 3]))] for _ in range(60)]
    docs = [(d, "\n".join(x + rnd.choice(["", "\r", "  "]) for _ in range(rnd.randrange(1, 6)) for x in [*rnd.choice(blocks), f"own {d} {rnd.random()}"])) for d in range(140)]
    got = {r["doc_id"]: set(r["lines"]) for r in line_dedup.aligned_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = brute_lines(docs)
    assert {d: x for d, x in want.items() if x} == {d: x for d, x in got.items() if x} and sum(map(len, want.values())) > 300


def test_blocks_in_another_order_go_unless_asked_not_to(spark):
    a, b, c = (f"a line that is long enough to be a block: {x}" for x in "abc")
    df = spark.createDataFrame([(1, f"{a}\n{b}\n{c}"), (2, f"{c}\nown\n{a}\n{b}")], "doc_id long, text string")
    text = lambda **p: {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, **p).collect()}
    assert text() == {1: f"{a}\n{b}\n{c}", 2: "own"} and text(moved=False)[2] == f"{c}\nown"


def test_long_documents_and_hot_lines_stay_linear(spark):
    import time

    hot = "a line that every one of the documents holds somewhere"
    rows = [(d, f"own {d}\n{hot}") for d in range(20_000)] + [(30_000, "\n".join(f"line {k} of a long document, long enough" for k in range(60_000)))]
    rows += [(30_001, "\n".join(f"line {k} of a long document, long enough" for k in reversed(range(60_000))))]
    began = time.perf_counter()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert got.agg({"_n_removed": "sum"}).first()[0] == 19_999 + 60_000 and time.perf_counter() - began < 90


def test_columns_of_any_name_are_carried(spark):
    names = ["_cut", "_id", "_key", "_own", "_hash", "_lines", "row", "cut", "own", "hash", "lines", "edges", "a.b", "_n_lines"]
    line = "a line that is long enough to be deleted"
    df = spark.createDataFrame([(1, line, *names), (2, f"{line}\nown", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[2]["text"] == "own" and all(got[2][n] == n for n in names[:-1]) and got[2]["_n_lines"] == 2


def test_lines_of_the_later_document_go(spark):
    block = [f"this is shared line number {k} of the block" for k in range(4)]
    own = lambda d: [f"document {d} has its own line {k}" for k in range(3)]
    docs = [(d, "\n".join([*own(d)[:1], *block, *own(d)[1:]]), "s") for d in range(1, 40)]
    docs += [(0, "\n".join(own(0)), None), (50, None, "s"), (51, "", "s"), (52, "yes\nno", "s"), (53, "yes\nno", "s"), (54, "\n".join(own(0)), "s"), (54, "\n".join(own(0)), "s"), (None, "\n".join(block), "s")]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(docs)
    assert text[1] == docs[0][1] and text[0] == "\n".join(own(0)) and text[50] is None and text[51] == ""
    assert all(text[d] == "\n".join(own(d)) for d in range(2, 40))
    assert text[52] == text[53] == "yes\nno" and text[54] == "" and text[None] == ""
    assert {r["_n_removed"] for r in got if r["doc_id"] == 54} == {3}
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
