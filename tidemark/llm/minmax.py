"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes gives two values of a text's signature, its smallest
and its largest image, so 126 permutations fill 252 places. Bands of six places put texts
with a common band into one bucket; equal sets meet before that, as one class.

In a bucket no pairs are listed. Shingles that only one class has (``alone``) cannot be shared,
which bounds the similarity of a pair from above: classes that cannot link with anything go
first, and of two classes only those are compared whose bound allows a link. Each class names
one leader, the one of its buckets with the smallest share of such shingles, and is compared
with it on the full sets; what linked becomes one component.

After ``ROUNDS`` such rounds the buckets that still hold two components are settled by group
(classes that such buckets connect). Groups of at most ``PAIRED`` classes, so at most half as
many pairs a class, list the pairs across components that share a band. Larger
groups are cut into blocks by hash, every two blocks meet in one task, and all sets in them
are compared by one matrix product; no pair becomes a row unless it is a link, and of those
one for each two components is enough. Both ways lose no link that hashing has not missed: at
similarity 0.8 that has a chance of 3 in a million, above 0.85 of less than 1 in a hundred million.

Defined cases: null or blank text has no shingles and is linked with nothing; fewer words
than a shingle make one shingle of the whole sequence; a row without an id is linked with
nothing, has no component and stays; rows that repeat an id are one document, joined by any
of their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.components import components
from tidemark.llm.staging import Stage, give_back, kept_by, ship
from tidemark.llm.words import BASE, U64, hash_words, mix, shingles, text_bytes

PERMUTATIONS, BAND = 126, 6
FACTORS = np.random.Generator(np.random.Philox(key=7)).integers(
    0, 1 << 63, PERMUTATIONS, dtype=np.uint64
) * U64(2) + U64(1)
ROUNDS = 2
PAIRED, BLOCK, COLUMNS = 32, 256, 8192
ROWS = 256
SETS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.large_binary())])
SKETCH_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("set_key", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))]
)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of non-empty sets, one row each: bands of minima, then bands of maxima."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = np.empty((PERMUTATIONS, len(sets)), U64)
    high = np.empty_like(low)
    for k, factor in enumerate(FACTORS):
        images = values * factor
        low[k] = np.minimum.reduceat(images, starts)
        high[k] = np.maximum.reduceat(images, starts)
    places = np.concatenate([low, high]).reshape(-1, BAND, len(sets))
    keys = np.arange(len(places), dtype=U64)[:, None] * np.ones(len(sets), U64)
    for i in range(BAND):
        keys = mix(keys * U64(BASE) + places[:, i])
    return keys.T.astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list]]:
    """Ids and shingle sets, a few hundred rows at a time."""
    kept_by("minmax")
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            hashes, first = hash_words(*text_bytes(part.column(1)))
            yield part, [shingles(hashes[a:b], k) for a, b in zip(first[:-1], first[1:])]
    give_back()


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketches(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, set_key, n_shingles, bands) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            full = [s for s in sets if len(s)]
            keys = iter(signatures(full).tolist() if full else ())
            columns = [
                part.column(0).cast(pa.int64()),
                pa.array([_key(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=SKETCH_SCHEMA)

    return df.mapInArrow(run, "doc_id long, set_key binary, n_shingles long, bands array<long>")


def full_sets(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, set_key, shingles) of (doc_id, text): the sorted 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            columns = [
                part.column(0).cast(pa.int64()),
                pa.array([_key(s) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.large_binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=SETS_SCHEMA)

    return df.mapInArrow(run, "doc_id long, set_key binary, shingles binary")


@F.arrow_udf(LongType())
def common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Size of the intersection of two sets of sorted 64-bit values."""

    def count(a: pa.Scalar, b: pa.Scalar) -> int:
        x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
        return len(np.intersect1d(x, y, assume_unique=True))

    return pa.array([count(a, b) for a, b in zip(left, right)], pa.int64())


def _may_link(least: int) -> Column:
    """Whether two classes (n, alone) and (m, alone_b) can be similar enough: they share at
    most what neither has alone."""
    shared = F.least(F.col("n") - F.col("alone"), F.col("m") - F.col("alone_b"))
    return 100 * shared >= least * (F.col("n") + F.col("m") - shared)


def _alone(sets: DataFrame) -> DataFrame:
    """(rep, alone): number of a class's shingles that no other class has, if any."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                owners = np.repeat(np.asarray(part.column(0)), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners), pa.array(np.concatenate(values))], ["rep", "shingle"]
                )

    return (
        sets.select("doc_id", "shingles")
        .mapInArrow(spread, "rep long, shingle long")
        .groupBy("shingle")
        .agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
        .where("rep = other")
        .groupBy("rep")
        .agg(F.count("*").alias("alone"))
    )


def _linked(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    sizes = (F.octet_length("x") + F.octet_length("y")) / 8
    return (
        both.select("a", "b", sizes.cast("long").alias("sizes"), common("x", "y").alias("n"))
        .where(100 * F.col("n") >= least * (F.col("sizes") - F.col("n")))
        .select("a", "b")
    )


def _with_labels(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("label", F.col("rep"))
    known = labels.withColumnRenamed("node", "rep")
    return buckets.join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _proposals(buckets: DataFrame, tested: DataFrame | None, turn: int, least: int) -> DataFrame:
    """For each class the leader it shares most buckets with, not of its own component."""
    share = F.when(F.lit(turn) == 0, F.col("alone") / F.col("n")).otherwise(F.lit(0.0))
    draw = F.struct(share.alias("share"), F.xxhash64("key", "rep", F.lit(turn)).alias("any"))
    leaders = (
        buckets.groupBy("key")
        .agg(
            F.min(F.struct(draw.alias("draw"), "rep", "n", "alone", "label")).alias("lead"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        .where("low < high")
        .select(
            "key",
            F.col("lead.rep").alias("b"),
            F.col("lead.n").alias("m"),
            F.col("lead.alone").alias("alone_b"),
            F.col("lead.label").alias("label_b"),
        )
    )
    pairs = (
        buckets.withColumnRenamed("rep", "a")
        .join(leaders, "key")
        .where((F.col("label") != F.col("label_b")) & _may_link(least))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"))
    )
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    best = F.max(F.struct("shared", F.xxhash64("b").alias("draw"), "b")).alias("best")
    return pairs.groupBy("a").agg(best).select("a", F.col("best.b").alias("b"))


def _mixed(stage: Stage, buckets: DataFrame, n: int) -> DataFrame:
    """Rows of the buckets with two components or more, with the class's group and its size; there are
    ``n`` rows of buckets."""
    mixed = (
        buckets.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("rep").alias("first"))
        .where("low < high")
        .select("key", "first")
    )
    rows = stage.table(buckets.join(mixed, "key"), "mixed", n)
    links = rows.where("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    groups = components(stage, links, "groups").withColumnsRenamed({"node": "rep", "label": "group"})
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    return stage.table(rows.drop("first").join(groups.join(sizes, "group"), "rep"), "grouped", n)


def _pairs(mixed: DataFrame, tested: DataFrame, least: int) -> DataFrame:
    """Untested pairs of different components in small groups that share a bucket."""
    small = mixed.where(F.col("size") <= PAIRED).drop("group", "size")
    right = small.withColumnsRenamed({"rep": "b", "n": "m", "alone": "alone_b", "label": "label_b"})
    pairs = (
        small.withColumnRenamed("rep", "a")
        .join(right, "key")
        .where((F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")))
        .where(_may_link(least))
        .select("a", "b")
        .distinct()
    )
    turned = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(tested.unionByName(turned), ["a", "b"], "left_anti")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices of some columns each."""
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1  # what only one set holds is in no intersection
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[seen[at] > 1]
    columns = place[at][seen[at] > 1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(sets), len(sets)))
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        a, b = np.searchsorted(columns, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        total += part @ part.T
    return total


def _blocks(mixed: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links between components of large groups, at least one for any two that have one."""
    large = mixed.where(F.col("size") > PAIRED).select("rep", "label", "group", "size").distinct()
    blocks = F.ceil(F.col("size") / BLOCK)
    own = large.withColumn("own", F.pmod(F.xxhash64("rep"), blocks))
    dealt = own.select(
        "rep", "label", "group", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    ).select(
        "rep", "label", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def compare(block: pa.Table) -> pa.Table:
        reps, labels = np.asarray(block.column("rep")), np.asarray(block.column("label"))
        held = [np.frombuffer(x.as_buffer(), U64) for c in block.column("shingles").chunks for x in c]
        length = np.array([len(s) for s in held], float)
        both = overlaps(held)
        linked = 100 * both >= least * (length[:, None] + length[None, :] - both)
        linked &= labels[:, None] < labels[None, :]
        a, b = np.nonzero(linked)
        _, first = np.unique(np.stack([labels[a], labels[b]]), axis=1, return_index=True)
        return pa.table({"a": pa.array(reps[a[first]]), "b": pa.array(reps[b[first]])})

    held = sets.withColumnRenamed("doc_id", "rep")
    return (
        dealt.join(held, "rep").groupBy("group", "i", "j").applyInArrow(compare, "a long, b long")
    )


def near_duplicates(
    df: DataFrame, k: int = 5, least: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df``.

    Rows are linked whose ``k``-word shingle sets have ``least`` hundredths of their union in
    common; ``component_id`` is the smallest id that can be reached.
    """
    spark = df.sparkSession
    ship(spark)
    stage = Stage(spark, "minmax")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = stage.table(sketches(docs, k), "sketch")
    classes = stage.table(
        sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    places = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = (
        places.groupBy("key")
        .agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
        .where("low < high")
    )
    buckets = stage.table(places.join(shared.select("key"), "key", "left_semi"), "buckets")
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    members = classes.select(F.col("rep").alias("doc_id"), "set_key")
    sets = stage.table(
        full_sets(docs.join(wanted, "doc_id", "left_semi"), k)
        .join(members, ["doc_id", "set_key"], "left_semi")
        .select("doc_id", "shingles"),
        "sets",
    )
    able = 100 * F.col("alone") <= (100 - least) * F.col("n")
    counted = buckets.join(_alone(sets), "rep", "left").fillna(0, ["alone"])
    buckets = stage.table(counted.where(able), "candidates")
    rows = buckets.count()
    labels = tested = None
    for turn in range(ROUNDS + 1):
        current = _with_labels(buckets, labels)
        if turn == ROUNDS:
            mixed = _mixed(stage, current, rows)
            pairs = stage.table(_pairs(mixed, tested, least), f"pairs-{turn}")
            found = _linked(pairs, sets, least).unionByName(_blocks(mixed, sets, least))
        else:
            pairs = stage.table(_proposals(current, tested, turn, least), f"pairs-{turn}", rows)
            found = _linked(pairs, sets, least)
        found = stage.table(found, f"links-{turn}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if labels is None:
            labels = components(stage, found, f"labels-{turn}")
        elif not found.isEmpty():
            # What was linked before is known by its labels, a link from each node to its smallest one.
            before = labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = components(stage, found.unionByName(before), f"labels-{turn}")
    stage.drop("buckets", "candidates", "sets")
    own = classes.select("set_key", "rep")
    named = labels.withColumnRenamed("node", "rep")
    found = (
        sketch.select("doc_id", "set_key", "n_shingles")
        .join(own.join(named, "rep", "left"), "set_key", "left")
        .withColumn(
            "component_id",
            F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "rep", "doc_id")),
        )
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
