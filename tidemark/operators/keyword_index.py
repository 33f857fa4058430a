"""A stored inverted index: BM25 top-k that reads the query terms' partitions only.

Texts are read once, and no word of them is shuffled: documents are numbered where they lie, and a
task cuts its own postings, per segment of at most ``SEGMENT`` documents, in blocks of ``BLOCK`` of
them: numbers as gaps, counts, lengths, and the largest count and the smallest length of the block.
Blocks lie in partitions by a hash of the term, sorted by term, so a search lists the partitions of
its terms and prunes row groups.

A search brings the blocks of its terms together by segment, with the weights of up to ``ASKED``
pairs of query and term. A task adds up the scores of one segment's documents, one array a query,
and keeps the k best and what ties with the last of them, so that nothing but those becomes a row.
Every posting of a term is scored, so the result is the exact BM25 order. No group is larger than a
segment, however frequent a term is.

Versions are immutable folders behind a pointer. Null texts and texts without a word are not
indexed; they count in neither the number of documents nor their average length. Equal scores (to
nine decimals) rank by id; ids are unique, of any type that sorts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.search import RANK_DECIMALS, rank_key
from tidemark.operators.versions import Pointer, Version, new_layer
from tidemark.session import Staging, work_dir

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}_]+"
SEGMENT_BITS = 13
BLOCK = 128
PARTITIONS = 256
# Postings a task holds before it cuts them into blocks, words it counts at once, and pairs of query
# and term scored at once.
HELD, COUNTED = 4 << 20, 1 << 19
ASKED = 1 << 16
BLOCKS = "term string, segment long, first long, n int, most_tf int, least_length int, gaps array<int>, tfs array<int>, lengths array<int>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def partition_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTITIONS)).cast("int")


def inverse_frequency(n: int, df: Column) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def gain(tf: Column, length: Column, average: float) -> Column:
    """What a term adds to a document's score, apart from the term's own weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def build(docs: DataFrame, path: str, key: str = "id", text: str = "text") -> KeywordIndex:
    """Index ``docs`` below ``path``."""
    spark = docs.sparkSession
    staging = Staging(spark, work_dir(spark, f"{path}/work"))
    pointer = Pointer(spark, f"{path}/versions")
    layer = new_layer((pointer.current() or Version()).number + 1)
    found = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    read = staging.write(postings(found.withColumn("number", F.monotonically_increasing_id())), "postings")
    listed = read.where("term IS NULL").select("number", "id", "length")
    listed.write.parquet(f"{path}/documents/{layer}")
    blocks = read.where("term IS NOT NULL").drop("number", "id", "length").withColumn("part", partition_of(F.col("term")))
    (
        blocks.hint("rebalance", "part").sortWithinPartitions("part", "term", "segment", "first")
        .write.partitionBy("part").parquet(f"{path}/blocks/{layer}")
    )
    stats = spark.read.parquet(f"{path}/documents/{layer}").agg(
        F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("average")
    ).first()
    settings = {"documents": stats.n, "average": stats.average, "blocks": blocks.schema.json(), "id": listed.schema.json()}
    pointer.publish(Version((pointer.current() or Version()).number, {"blocks": (layer,)}, settings))
    staging.discard()
    return KeywordIndex(spark, path)


def cut(term: np.ndarray, number: np.ndarray, tf: np.ndarray, length: np.ndarray, vocabulary: list[str]) -> dict:
    """Postings of one segment (terms as places in the vocabulary, which may have gone unused) as the
    columns of its blocks, by term and number."""
    order = np.lexsort((number, term))
    term, number, tf, length = term[order], number[order], tf[order], length[order]
    first_of_term = np.flatnonzero(np.diff(term, prepend=-1))
    place = np.arange(len(term)) - np.repeat(first_of_term, np.diff(np.append(first_of_term, len(term))))
    at = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(np.append(at, len(term)))
    gaps = np.diff(number, prepend=number[:1])
    gaps[at] = 0
    edges = pa.array(np.append(at, len(term)), pa.int32())

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(edges, pa.array(values, pa.int32()))

    return {
        "term": pa.array(vocabulary, pa.string()).take(pa.array(term[at])), "segment": pa.array(number[at] >> SEGMENT_BITS),
        "first": pa.array(number[at]), "n": pa.array(n, pa.int32()),
        "most_tf": pa.array(np.maximum.reduceat(tf, at), pa.int32()),
        "least_length": pa.array(np.minimum.reduceat(length, at), pa.int32()),
        "gaps": lists(gaps), "tfs": lists(tf), "lengths": lists(length),
    }


def postings(numbered: DataFrame) -> DataFrame:
    """Of ``numbered(number, id, words)``, numbers rising within a task: a row ``number, id, length``
    for every document, and the blocks of its segments' postings, in rows of their own."""
    rows = numbered.select("number", "id", "words")
    own = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:2]]
    kinds = T.StructType([*own, T.StructField("length", T.IntegerType()), *T.StructType.fromDDL(BLOCKS)])
    block_kinds = [
        pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3
    ]
    names, bits, held, counted = kinds.fieldNames(), SEGMENT_BITS, HELD, COUNTED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        waiting: list[tuple] = []
        segment, size, id_kind = -1, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                columns = cut(*(np.concatenate(x) for x in zip(*waiting)), list(known))
                n = len(columns["term"])
                empty = [pa.nulls(n, pa.int64()), pa.nulls(n, id_kind), pa.nulls(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*empty, *columns.values()], names)
            waiting.clear()
            known.clear()

        for whole in batches:
            id_kind = whole.schema.field("id").type
            lengths = whole.column("words").value_lengths()
            ahead = [whole.column("number"), whole.column("id"), lengths]
            yield pa.RecordBatch.from_arrays([*ahead, *(pa.nulls(whole.num_rows, t) for t in block_kinds)], names)
            segments, room = whole.column("number").to_numpy() >> bits, np.cumsum(lengths.to_numpy(), dtype=np.int64) // counted
            edges = np.flatnonzero((np.diff(segments) != 0) | (np.diff(room) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, whole.num_rows]):
                if a == b:
                    continue
                if segments[a] != segment or size > held:
                    yield from flush()
                    segment, size = segments[a], 0
                found, own = whole.column("words").slice(a, b - a), lengths.to_numpy()[a:b]
                encoded = found.flatten().dictionary_encode()
                places = np.array([known.setdefault(w, len(known)) for w in encoded.dictionary.to_pylist()], np.int64)
                doc = np.repeat(np.arange(b - a), own)
                pairs, tf = np.unique(doc << 32 | places[encoded.indices.to_numpy()], return_counts=True)
                doc = pairs >> 32
                waiting.append((pairs & 0xFFFFFFFF, whole.column("number").to_numpy()[a:b][doc], tf.astype(np.int32), own[doc]))
                size += len(pairs)
        yield from flush()

    return rows.mapInArrow(run, kinds)


class KeywordIndex:
    """The current version of an index, fixed when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        version = Pointer(spark, f"{path}/versions").current()
        if version is None:
            raise FileNotFoundError(f"No keyword index at {path}.")
        self.layer, self.settings = version.of("blocks")[0], version.settings
        self.documents, self.average = self.settings["documents"], self.settings["average"]

    def _read(self, table: str, schema: str) -> DataFrame:
        kinds = T.StructType.fromJson(json.loads(self.settings[schema]))
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{table}/{self.layer}")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._read("blocks", "blocks")

    @cached_property
    def listed(self) -> DataFrame:
        return self._read("documents", "id")

    def _of(self, asked: DataFrame) -> DataFrame:
        """The blocks of the asked terms. At most ``PARTITIONS`` numbers name the folders to list;
        a short list of terms is pushed into the scan too."""
        parts = [r.part for r in asked.select("part").distinct().collect()]
        blocks = self.blocks.where(F.col("part").isin(parts))
        terms = [r.term for r in asked.select("term").distinct().limit(1001).collect()]
        return blocks.where(F.col("term").isin(terms)) if len(terms) <= 1000 else blocks

    def search(self, text: str, k: int = 10) -> DataFrame:
        """``rank, id, score``: the k best documents for one query text."""
        one = self.spark.createDataFrame([(0, text)], "query_id int, text string")
        return self.search_many(one, k).drop("query_id")

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``query_id, rank, id, score`` for ``queries(query_id, text)``."""
        staging = Staging(self.spark, work_dir(self.spark, f"{self.path}/work"))
        asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        asked = staging.write(asked.distinct().withColumn("part", partition_of(F.col("term"))), "asked")
        blocks = self._of(asked)
        # Counts a term from the blocks' sizes; no postings are read.
        df = blocks.groupBy("term").agg(F.sum("n").cast("double").alias("df"))
        weighed = asked.join(df, "term").select("query_id", "term", inverse_frequency(self.documents, F.col("df")).alias("w"))
        weighed = staging.write(weighed, "weights")
        hits = staging.write(self._best(self._scores(blocks, weighed, k), k), "hits")
        return hits.join(self.listed.select("number", "id"), "number").select("query_id", "rank", "id", "score")

    def _scores(self, blocks: DataFrame, weighed: DataFrame, k: int) -> DataFrame:
        """``query_id, number, score``: the k best of every query and segment, with all that tie for
        the last place."""
        average, kind = self.average, weighed.schema["query_id"].dataType
        slices = max(1, -(-weighed.count() // ASKED))
        segments = blocks.select(F.col("segment").alias("here")).distinct()
        left = blocks.select(
            "segment", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
            "term", "first", "gaps", "tfs", "lengths",
        )
        dealt = weighed.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
        # A fresh column: both sides come from the same table.
        right = dealt.crossJoin(F.broadcast(segments)).select(
            F.col("here").alias("segment"), "slice", "query_id", "term", "w"
        )
        schema = T.StructType([
            T.StructField("query_id", kind), T.StructField("number", T.LongType()), T.StructField("score", T.DoubleType())
        ])

        def score(held: pa.Table, asked: pa.Table) -> pa.Table:
            return _segment_hits(held, asked, average, k)

        keys = ["segment", "slice"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)

    def _best(self, scores: DataFrame, k: int) -> DataFrame:
        """The k best of every query. Ids decide ties, so documents that may tie for the last
        place are looked up before they are cut."""
        order = Window.partitionBy("query_id").orderBy(rank_key())
        near = scores.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k).drop("rank")
        named = near.join(self.listed.select("number", "id"), "number")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(rank_key(), "id"))
        return named.withColumn("rank", place).where(F.col("rank") <= k).drop("id")


def _segment_hits(held: pa.Table, asked: pa.Table, average: float, k: int) -> pa.Table:
    """Hits of the queries ``asked(query_id, term, w)`` among one segment's blocks."""
    queries = asked["query_id"].combine_chunks()
    if not held.num_rows or not asked.num_rows:
        return pa.table({"query_id": queries.slice(0, 0), "number": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    held = held.select(["term", "first", "gaps", "tfs", "lengths"]).sort_by("term").combine_chunks()
    gaps, tfs, lengths = (held[c].combine_chunks() for c in ("gaps", "tfs", "lengths"))
    sizes, gap = gaps.value_lengths().to_numpy(), gaps.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    # Gaps back to numbers: a block's first gap is 0, so sums begin anew at its first number.
    run = np.cumsum(gap)
    number = run + np.repeat(held["first"].to_numpy() - run[ends - sizes], sizes)
    start = number.min()
    place = number - start
    tf, length = tfs.flatten().to_numpy().astype(np.float64), lengths.flatten().to_numpy()
    gains = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    terms = held["term"].combine_chunks().dictionary_encode()
    first = np.flatnonzero(np.diff(terms.indices.to_numpy(), prepend=-1))
    begins = (ends - sizes)[first]
    stops = np.append(begins[1:], len(place))
    term = pc.index_in(asked["term"].combine_chunks(), terms.dictionary)
    here = term.is_valid().to_numpy(zero_copy_only=False)
    # Queries as places in their own list, their terms in a fixed order, so sums do not depend on the layout.
    encoded = queries.dictionary_encode()
    owner, term = encoded.indices.to_numpy()[here], term.drop_null().to_numpy()
    weight = asked["w"].to_numpy()[here]
    order = np.lexsort((term, owner))
    owner, term, weight = owner[order], term[order], weight[order]
    edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    found = []
    for a, b in zip(edges[:-1], edges[1:]):
        scores = np.zeros(int(place.max()) + 1)
        for t, w in zip(term[a:b], weight[a:b]):
            scores[place[begins[t] : stops[t]]] += w * gains[begins[t] : stops[t]]
        rounded = np.round(scores, RANK_DECIMALS)
        least = -np.partition(-rounded, k - 1)[k - 1] if len(rounded) > k else 0.0
        best = np.flatnonzero((rounded >= least) & (scores > 0))
        found.append((np.full(len(best), owner[a]), best + start, scores[best]))
    owner, best, scores = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    ids = encoded.dictionary.take(pa.array(owner, pa.int64()))
    return pa.table({"query_id": ids, "number": pa.array(best, pa.int64()), "score": pa.array(scores, pa.float64())})


# -- several rankings -----------------------------------------------------------------------


def fuse(rankings: list[DataFrame], k: int = 10, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """``query_id, rank, id, score``: reciprocal rank fusion of ``(query_id, rank, id)`` rankings.

    A document scores ``weight / (constant + rank)`` in every ranking that holds it. One shuffle
    by query and document; ties rank by id.
    """
    weights = weights or [1.0] * len(rankings)
    parts = [
        r.select("query_id", "id", (F.lit(w) / (F.col("rank") + constant)).alias("part"))
        for r, w in zip(rankings, weights)
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    scored = both.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
