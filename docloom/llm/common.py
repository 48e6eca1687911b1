"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator here: the six ASCII white-space characters.
SPACE = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return df.checkpoint()


def text_key(text: Column) -> Column:
    """64 bits of a text that tell apart the rows which repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], salt: Column, how: str = "inner", most: int = 100_000, spread: int = 64) -> DataFrame:
    """`rows` joined with a table that has few rows for each value of `keys`, where one value may be in a third of `rows`.

    The table is broadcast if it has at most `most` rows.  Beyond that it is shuffled, once for each of `spread` parts
    of a key's rows, which `salt` tells apart.
    """
    if found.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(found), keys, how)
    parts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(spread)).cast("int"))
    return rows.join(found.withColumn("_part", parts), [*keys, "_part"], how).drop("_part")


def counted_join(rows: DataFrame, found: DataFrame, key: str, salt: Column, count: str = "n", hot: int = 10_000) -> DataFrame:
    """`rows` joined with one row of `found` for each key, which says in `count` how many `rows` the key has.

    Keys of more than `hot` rows meet apart from the others (see `lookup`), so that none has all its rows in one task.
    """
    often = found.where(F.col(count) > hot)
    if often.isEmpty():
        return rows.join(found, key)
    names = checkpointed(often.select(key))
    cold = lookup(rows, names.withColumn("_hot", F.lit(True)), [key], salt, "left").where("_hot is null").drop("_hot")
    return lookup(rows, often, [key], salt).unionByName(cold.join(found.where(F.col(count) <= hot), key))


def packed(docs: DataFrame, without: tuple[str, ...] = (), **own: Column) -> DataFrame:
    """The columns of `own`, and in `row` the columns of `docs` but for `without`: whatever their names, they clash with none."""
    row = F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in docs.columns if c not in without])
    return docs.select(row.alias("row"), *[c.alias(name) for name, c in own.items()])


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` out of `row`, those named in `new` replaced, and the rest of `new` behind them."""
    kept = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]
    return df.select(*kept, *[c.alias(name) for name, c in new.items() if name not in docs.columns])


def batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 2_000, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded size; bytes and strings count with their length."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def records(arrow: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, turned to Python objects in small slices."""
    for batch in arrow:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def sample_rows(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """About `rows` rows, twice as many at most, chosen by a hash of `key`: the same ones on every run."""
    share = max(1, df.count() // max(1, rows))
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(share)) == 0).limit(2 * rows)
