"""Shards of bounded size by extendible hashing.

A row's address is 120 bits: 60 of the hash of its key, then 60 of the hash of its text. The
directory starts with one bucket; only a bucket above the byte limit splits on its next bit,
until every bucket fits. Equal keys separate by their text; rows equal in both are dealt out
by count.

Sizes are summed per address once, and then per prefix of a depth at which buckets will mostly
fit. Levels down to there are split on those sums, a few rows for each shard; deeper levels
look only at the addresses in buckets that are still too large. The directory has one entry
for each prefix of that depth; a row looks its shard up there, and, where it was split deeper,
once more for each deeper depth that occurs. The text is shuffled once, by shard, on its way
to the files.

Defined cases: a null key and a null text hash like empty ones, and a null text has 0 bytes; a
single row above the limit gets a shard of its own; an empty table has no shard; other columns
are written with the row (clashing ``shard``, ``depth`` and ``n_bytes`` are replaced).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import Stage

BITS = 60
SHARD_BYTES = 64 << 20
EXTRA_BITS = 3  # splits beyond the average that sums are kept for
MOST_BROADCAST_SHARDS = 1_000_000  # a row of the directory takes below 100 bytes


def bits(value: Column) -> Column:
    """60 bits of a text's hash as a whole number; null reads as empty."""
    digest = F.md5(F.coalesce(value, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def prefix(depth: int) -> list[Column]:
    """The first ``depth`` bits of an address, as two numbers."""
    first = F.shiftright("h1", max(0, BITS - depth))
    second = F.shiftright("h2", 2 * BITS - depth) if depth > BITS else F.lit(0).cast("long")
    return [first.alias("p1"), second.alias("p2")]


def _binary(depth: int) -> Column:
    """A prefix written in binary."""
    digits = F.concat(
        F.lpad(F.bin("p1"), BITS, "0").substr(F.lit(1 + max(0, BITS - depth)), F.lit(BITS)),
        F.lpad(F.bin("p2"), BITS, "0").substr(F.lit(1 + 2 * BITS - depth), F.lit(BITS))
        if depth > BITS
        else F.lit(""),
    )
    return F.when(F.lit(depth) == 0, F.lit("")).otherwise(digits)


def _with_prefix(rows: DataFrame, depth: int) -> DataFrame:
    return rows.withColumns(dict(zip(("p1", "p2"), prefix(depth))))


def _sum(rows: DataFrame) -> DataFrame:
    """Sizes per prefix, with the first and last addresses in it."""
    return rows.groupBy("p1", "p2").agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_rows").alias("n_rows"),
        F.max("widest").alias("widest"),
        F.min("h1").alias("h1"),
        F.min("h2").alias("h2"),
        F.max("last1").alias("last1"),
        F.max("last2").alias("last2"),
    )


def directory(stage: Stage, sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """For each depth to look up: (p1, p2, shard, depth, per_shard).

    ``sizes`` has n_bytes, n_rows, widest (the largest row) and h1, h2, last1, last2 per
    address. ``per_shard`` is the number of rows a shard takes where a bucket's rows are equal.
    """
    total = sizes.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    base = min(BITS, math.ceil(math.log2(max(1, total / limit))) + EXTRA_BITS)
    coarse = stage.table(_sum(_with_prefix(sizes, base)).drop("p1", "p2"), "coarse")
    found, deep, depth, step, current = [], [], 0, 0, coarse
    while True:
        buckets = stage.table(_sum(_with_prefix(current, depth)), f"level-{step}")
        step += 1
        fits = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1)
        one_key = F.col("h1") == F.col("last1")
        equal = one_key & (F.col("h2") == F.col("last2"))
        share = F.greatest(F.lit(1), F.lit(limit) / F.col("widest")).cast("long")
        done = buckets.where(fits | equal).select(
            "p1", "p2", _binary(depth).alias("shard"), F.lit(depth).alias("depth"),
            F.when(~fits, share).alias("per_shard"),
        )
        found.append((depth, done))
        over = buckets.where(~fits & ~equal)
        # Bits of the key cannot split one key: it goes on with the bits of the text.
        alone = over.where(one_key) if depth < BITS else over.limit(0)
        split = over.where(~one_key) if depth < BITS else over
        if not alone.isEmpty():
            keys = alone.select(F.col("h1").alias("key"))
            deep.append(sizes.join(keys, F.col("h1") == F.col("key"), "left_semi"))
        if not split.isEmpty():
            rows = _with_prefix(coarse if depth < base else sizes, depth)
            current = rows.join(split.select("p1", "p2"), ["p1", "p2"], "left_semi").drop("p1", "p2")
            depth += 1
        elif deep and depth < BITS:
            current, deep, depth = reduce(DataFrame.unionByName, deep), [], BITS + 1
        else:
            break
    near = [
        _with_prefix(coarse, d)
        .join(t, ["p1", "p2"])
        .drop("p1", "p2")
        .withColumns(dict(zip(("p1", "p2"), prefix(base))))
        .select("p1", "p2", "shard", "depth", "per_shard")
        for d, t in found
        if d <= base
    ]
    levels = [(base, reduce(DataFrame.unionByName, near)), *((d, t) for d, t in found if d > base)]
    return [(d, stage.table(t, f"directory-{d}")) for d, t in levels if not t.isEmpty()]


def place(
    df: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, int]:
    """Add ``n_bytes``, ``shard`` (its address bits in binary) and ``depth``; also the number
    of entries of the directory, within which shards are counted at least once."""
    spark = df.sparkSession
    stage = Stage(spark, "shards")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "depth", "n_bytes", "h1", "h2")]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = df.select(
        *rest,
        size.alias("n_bytes"),
        bits(F.col(key).cast("string")).alias("h1"),
        bits(F.col(text)).alias("h2"),
    )
    sizes = stage.table(
        rows.groupBy("h1", "h2").agg(
            F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"), F.max("n_bytes").alias("widest")
        ).select("*", F.col("h1").alias("last1"), F.col("h2").alias("last2")),
        "sizes",
    )
    placed, names, counts, shards = rows, [], [], 0
    for depth, entries in directory(stage, sizes, limit):
        own = entries.select(
            *(F.col(p).alias(f"{p}_{depth}") for p in ("p1", "p2")),
            F.struct("shard", "depth", "per_shard").alias(f"_d{depth}"),
        )
        size = entries.count()
        shards += size
        if size <= MOST_BROADCAST_SHARDS:
            own = F.broadcast(own)
        first, second = prefix(depth)
        here = {f"p1_{depth}": first, f"p2_{depth}": second}
        placed = placed.withColumns(here).join(own, list(here), "left").drop(*here)
        names.append(f"_d{depth}")
        if not entries.where("per_shard IS NOT NULL").isEmpty():
            counts.append(depth)
    if not names:
        none = df.sparkSession.createDataFrame([], rows.select(*rest, "n_bytes").schema)
        return none.select("*", F.lit("").alias("shard"), F.lit(0).alias("depth")), 1
    placed = placed.withColumn("_place", F.coalesce(*names))
    shard = F.col("_place.shard")
    if counts:
        # Equal rows: numbered apart in each task's share of them, so no task gets all of one kind.
        alone = placed.where("_place.per_shard IS NULL").withColumn("_copy", F.lit(""))
        equal = placed.where("_place.per_shard IS NOT NULL").withColumn("_task", F.spark_partition_id())
        own = Window.partitionBy("h1", "h2", "_task").orderBy("n_bytes")
        number = F.floor((F.row_number().over(own) - 1) / F.col("_place.per_shard"))
        equal = equal.withColumn("_copy", F.concat_ws("-", F.lit(""), "_task", number)).drop("_task")
        placed = alone.unionByName(equal)
        shard = F.concat(shard, F.col("_copy"))
    placed = placed.select(*rest, "n_bytes", shard.alias("shard"), F.col("_place.depth").alias("depth"))
    return placed, shards


def write_shards(df: DataFrame, path: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write each shard to a folder of its own and return the rows as read back.

    There are as many tasks as shards, so that a task writes few of them.
    """
    placed, shards = place(df, limit)
    placed = placed.withColumn("shard", F.concat(F.lit("b"), "shard"))
    placed.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    schema = placed.schema
    return df.sparkSession.read.schema(schema).parquet(path).withColumn("shard", F.expr("substr(shard, 2)"))
