"""Ranked lexical search: exact top-k by inner product over ball trees of sparse documents.

A document is the sparse vector of its terms' scores, an item the 0/1 vector of its terms, so a
document's score for an item is their inner product. Documents are read once into the terms that
some item asks for (``term_rows``); their global counts give the weights. Every task then puts its
documents in blocks of bounded size, builds a ball tree over each block (a node has its centroid,
its radius, and its upward radius along each term) and searches all items: no document of a node
can score more than ``q.centroid + |q| * radius``, nor more than the centroid and the upward radii
of the item's terms add up to. The smaller of the two, computed in doubles and raised by more than
their rounding, decides: subtrees are opened best first and left when it is below the item's tenth
score so far.
Leaves are scored in 64-bit integers. What a task has found bounds its later blocks; the tasks'
lists of k are merged in the end.

Terms beyond ``FOLD`` share dimensions in the bound only: all values are positive, so a shared
dimension can only raise it. Nothing is left out, whatever the order of blocks and nodes.

Defined cases: a null text or one without a term is no document (it enters neither N nor L) and,
as an item, finds nothing. Rows are searched one by one: repeated documents take a rank each, a
null doc_id sorts before all others. Equal rows of items are one; two texts under one item_id are
searched together, as the item's set of terms. Texts are read whole at any length. Other columns
are not read. Without documents or items there are no rows. Items are taken in blocks of bounded
text, each with its own passes, so a benchmark of any size is never sent whole to a task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import Stage, ship

TOP = 10
# Every ASCII character but digits and letters ends a term; A-Z are lower-cased.
LETTERS = bytes(
    b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)
BLOCK_ROWS, BLOCK_ENTRIES = 8192, 2 << 20
LEAF_ROWS = 32
FOLD = 4096
ITEM_BYTES, ITEMS = 4 << 20, 1024
SLICE = 1 << 20
SLACK = 1e-9  # share by which a bound is raised, far above what doubles round


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a bounded number of bytes at a time."""
    start = 0
    while start < len(text):
        end = min(len(text), start + SLICE)
        part = text[start:end].translate(LETTERS)
        while end < len(text) and part[-1] != 32:  # a term may be longer than a slice
            more = text[end : end + SLICE].translate(LETTERS)
            cut = more.find(b" ")
            cut = len(more) if cut < 0 else cut + 1
            part, end = part + more[:cut], end + cut
        yield part.split()
        start = end


def term_rows(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, terms, tf``: every document with a term, its length, and of the vocabulary's
    terms in it the numbers and how often each occurs."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            keep, lengths, ends, ids, counts = [], [], [0], [], []
            for row, value in enumerate(batch.column(1).cast(pa.large_binary())):
                n, found = 0, Counter()
                for part in terms(value.as_py() or b""):
                    n += len(part)
                    found.update(filter(number.__contains__, part))
                if n:
                    keep.append(row)
                    lengths.append(n)
                    ids += map(number.__getitem__, found)
                    counts += found.values()
                    ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            columns = [
                batch.column(0).take(pa.array(keep, pa.int64())),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    return docs.select(doc_id, text).mapInArrow(
        read, f"doc_id {kind}, n long, terms array<int>, tf array<long>"
    )


def weights(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of every term of the vocabulary, from all documents."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("n").cast("decimal(38,0)")).alias("all")).first()
    counts = rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    df = np.zeros(size, np.int64)
    for row in counts:
        df[row.t] = row["count"]
    n = total.n
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
    return n, int(total.all or 0), np.array(weight, np.int64)


def term_scores(n: np.ndarray, ends: np.ndarray, tf: np.ndarray, number: int, length: int) -> np.ndarray:
    """``(1000000000 tf) div (1000 tf + 8 m)`` of every entry, without the term's weight."""
    wide = number * 90 * int(n.max(initial=0)) >= 1 << 63 or length >= 1 << 63
    m = 10 + (90 * n.astype(object) * number // length if wide else 90 * n * number // length)
    m = np.repeat(m, np.diff(ends))
    if wide or int(tf.max(initial=0)) >= 1 << 33:
        tf, m = tf.astype(object), m.astype(object)
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int64)


class Block:
    """Documents in rows of (terms, values), and a ball tree over them.

    Nodes are split in two by the distance to two far documents until they hold ``LEAF_ROWS``;
    rows are kept in leaf order, so that a node is a range of rows.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        self.folds = min(FOLD, max(1, size))
        self.ids, self.ends, self.terms, self.values = ids, ends, terms, values
        self.first, self.last, self.children = [], [], []
        self.order = np.arange(len(ids))
        self.norms = self._squares()
        self._split(0, len(ids))
        self._arrange()
        self.centres = np.zeros((len(self.first), self.folds))
        self.highest = np.zeros((len(self.first), self.folds))
        self.radii = np.zeros(len(self.first))
        for node in reversed(range(len(self.first))):  # children come after their parent
            self._ball(node, self.first[node], self.last[node])

    def _squares(self) -> np.ndarray:
        """Squared folded values by row, for the norms."""
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        key = row * self.folds + self.terms % self.folds
        if self.folds == FOLD and len(key):  # terms may share a dimension
            order = np.argsort(key, kind="stable")
            keys, at = np.unique(key[order], return_index=True)
            sums = np.add.reduceat(self.values[order].astype(np.float64), at)
            return np.bincount(keys // self.folds, sums * sums, len(self.ids))
        return np.bincount(row, self.values.astype(np.float64) ** 2, len(self.ids))

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and the number of the row each belongs to."""
        size = self.ends[rows + 1] - self.ends[rows]
        start = np.repeat(self.ends[rows] - (np.cumsum(size) - size), size)
        return start + np.arange(len(start)), np.repeat(np.arange(len(rows)), size)

    def _dense(self, row: int) -> np.ndarray:
        at = slice(self.ends[row], self.ends[row + 1])
        return np.bincount(self.terms[at] % self.folds, self.values[at], self.folds)

    def _products(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        at, row = self._entries(rows)
        return np.bincount(row, self.values[at] * point[self.terms[at] % self.folds], len(rows))

    def _split(self, a: int, b: int) -> int:
        """Order the rows of a range by a bisecting tree; the number of its node."""
        node = len(self.first)
        self.first.append(a)
        self.last.append(b)
        self.children.append(())
        if b - a > LEAF_ROWS:
            rows = self.order[a:b]
            far = self._dense(rows[int(np.argmax(self.norms[rows]))])
            for _ in range(2):  # the farthest from a far one, twice
                one = far
                off = self.norms[rows] - 2 * self._products(rows, one)
                far = self._dense(rows[int(np.argmax(off))])
            side = self._products(rows, far - one)
            self.order[a:b] = rows[np.argsort(side, kind="stable")]
            middle = (a + b) // 2
            self.children[node] = (self._split(a, middle), self._split(middle, b))
        return node

    def _arrange(self) -> None:
        at, _ = self._entries(self.order)
        size = np.diff(self.ends)[self.order]
        self.ids, self.norms = self.ids[self.order], self.norms[self.order]
        self.terms, self.values = self.terms[at], self.values[at]
        self.ends = np.concatenate([[0], np.cumsum(size)])

    def _ball(self, node: int, a: int, b: int) -> None:
        if self.children[node]:
            one, two = self.children[node]
            share = (self.last[one] - a) / (b - a)
            centre = share * self.centres[one] + (1 - share) * self.centres[two]
            np.maximum(self.highest[one], self.highest[two], out=self.highest[node])
        else:
            at = slice(self.ends[a], self.ends[b])
            fold = self.terms[at] % self.folds
            centre = np.bincount(fold, self.values[at], self.folds) / (b - a)
            row = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))
            rows = np.bincount(row * self.folds + fold, self.values[at], (b - a) * self.folds)
            rows.reshape(b - a, self.folds).max(axis=0, out=self.highest[node])
        off = self.norms[a:b] - 2 * self._products(np.arange(a, b), centre) + centre @ centre
        # Differences of squares lose digits against the squares themselves: made good for here.
        lost = SLACK * (self.norms[a:b] + centre @ centre)
        self.centres[node], self.radii[node] = centre, math.sqrt(max(0.0, float((off + lost).max())))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no document of a node can exceed, for every node and query (folded columns): the
        centroid's score and the radius along the query, or along each term apart if that is less."""
        ball = self.centres @ queries + self.radii[:, None] * np.linalg.norm(queries, axis=0)
        return np.minimum(ball, self.highest @ queries) * (1 + SLACK) + 1

    def leaf(self, node: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores above 0 of a leaf's documents for an item (a flag for every term)."""
        a, b = self.first[node], self.last[node]
        lo, hi = self.ends[a], self.ends[b]
        hit = np.flatnonzero(asked[self.terms[lo:hi]])
        row = np.searchsorted(self.ends[a : b + 1], hit + lo, "right") - 1
        scores = np.zeros(b - a, np.int64)
        np.add.at(scores, row, self.values[lo:hi][hit])
        found = np.flatnonzero(scores)
        return found + a, scores[found]

    def search(self, best: list[list], items: list[np.ndarray], folded: np.ndarray, asked: np.ndarray) -> int:
        """Improve every item's heap of (score, key) in place; the number of leaves scored."""
        bounds, scored = self.bounds(folded), 0
        for item, wanted in enumerate(items):
            if not len(wanted):
                continue
            heap, bound = best[item], bounds[:, item]
            asked[wanted] = True
            open_nodes = [(-bound[0], 0)]
            while open_nodes:
                most, node = heapq.heappop(open_nodes)
                if len(heap) == TOP and -most < heap[0][0]:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(open_nodes, (-bound[child], child))
                    continue
                scored += 1
                rows, scores = self.leaf(node, asked)
                if len(heap) == TOP:
                    near = scores >= heap[0][0]
                    rows, scores = rows[near], scores[near]
                for row, score in zip(rows.tolist(), scores.tolist()):
                    entry = (score, self.ids[row])
                    if len(heap) < TOP:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            asked[wanted] = False
        return scored


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as (ids, n, ends, terms, tf), in blocks of bounded rows and entries."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), BLOCK_ENTRIES - entries, "right")
            take = min(batch.num_rows - at, BLOCK_ROWS - rows, max(int(room), 0 if rows else 1))
            if take:
                held.append(batch.slice(at, take))
                rows, entries, at = rows + take, entries + int(sizes[at : at + take].sum()), at + take
            if not take or rows >= BLOCK_ROWS:
                yield _joined(held)
                held, rows, entries = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple:
    whole = pa.Table.from_batches(held).combine_chunks()
    ids, n, terms, tf = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in whole.columns)
    ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (terms, tf)]
    return ids, n.to_numpy(), ends.astype(np.int64), *flat


class Key:
    """Order of equal scores: the smaller id is better, null best of all."""

    __slots__ = ("id",)

    def __init__(self, i):
        self.id = i

    def __lt__(self, other: Key) -> bool:
        if self.id is None or other.id is None:
            return self.id is not None
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Key) and self.id == other.id


def best_of(rows: DataFrame, items: list[np.ndarray], number: int, length: int, weight: np.ndarray) -> DataFrame:
    """``item, doc_id, score``: each task's best rows for every item."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((items, weight))
    size = len(weight)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        best: list[list] = [[] for _ in items]
        folds = min(FOLD, max(1, size))
        folded = np.zeros((folds, len(items)))
        for k, wanted in enumerate(items):
            np.add.at(folded[:, k], wanted % folds, 1)
        asked, id_type = np.zeros(size, bool), pa.int64()
        for ids, n, ends, terms, tf in _blocks(batches):
            id_type = ids.type
            values = weight[terms] * term_scores(n, ends, tf, number, length)
            keys = np.empty(len(ids), object)
            keys[:] = [Key(i) for i in ids.to_pylist()]
            Block(keys, ends, terms, values, size).search(best, items, folded, asked)
        out = [(k, key.id, score) for k, heap in enumerate(best) for score, key in heap]
        if out:
            item, doc, score = zip(*out)
            columns = [pa.array(item, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return rows.mapInArrow(search, f"item int, doc_id {kind}, score long")


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Items as (id, set of terms), in blocks of bounded text, streamed to the driver."""
    block, size, last = [], 0, None
    for i, value in items.select(item_id, text).distinct().orderBy(item_id).toLocalIterator():
        data = (value or "").encode("utf-8")
        if block and i != last and (len(block) >= ITEMS or size + len(data) > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((i, {t for part in terms(data) for t in part}))
        size, last = size + len(data), i
    if block:
        yield block


def ranked(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ten best documents of every item."""
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "balltree")
    kinds = [items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()]
    found = spark.createDataFrame([], f"item_id {kinds[0]}, doc_id {kinds[1]}, score long")
    for k, block in enumerate(_item_blocks(items, item_id, item_text)):
        named: dict = {}
        for i, own in block:
            named[i] = named.get(i, set()) | own
        vocabulary = {t: j for j, t in enumerate(sorted(set().union(*named.values())))}
        rows = stage.table(term_rows(docs, vocabulary, doc_id, text), f"terms-{k}")
        number, length, weight = weights(rows, len(vocabulary))
        if number:
            wanted = [np.array(sorted(map(vocabulary.__getitem__, own)), np.int64) for own in named.values()]
            best = stage.table(best_of(rows, wanted, number, length, weight), f"best-{k}")
            names = spark.createDataFrame(list(enumerate(named)), f"item int, item_id {kinds[0]}")
            found = found.unionByName(best.join(F.broadcast(names), "item").drop("item"))
        stage.drop(f"terms-{k}")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id")))
    top = found.withColumn("rank", place).where(F.col("rank") <= TOP)
    return top.select("item_id", "rank", "doc_id", "score")
