"""Benchmark passages in documents, found by latent semantic retrieval.

TF-IDF passages of all benchmark items, weighted by document frequencies over all documents, are
decomposed by a randomised SVD whose products with the passage matrix are Spark jobs. Every window
of every document is projected onto the latent terms. Items are cut into even passages of at most
``WINDOW`` words, as a window cannot hold more; a window that has a large enough share of a
passage's latent vector and a large enough cosine with it is a candidate for the whole item. A
candidate is then read word by word: the longest common subsequence of the item, and of its answer (the last
sentence), with the words around the window decides. Words count by their inverse document
frequency there, so that frequent words in a likely order are no evidence.

Nothing is sampled: terms and basis come from all passages of all items, document frequencies and
hits from all words of all documents. A word that no item has weighs nothing in a product with an
item's passage, so the documents have no terms of their own. Benchmarks are taken in
blocks of about ``BLOCK_ITEMS`` passages, each block in one pass over the documents, so that what
tasks receive is bounded however many items there are. Windows near each other that are
candidates for one item of several passages are read together, at most a quarter of its length.

Windows are projected together: terms' latent vectors are added up per ``STRIDE`` words, and a
window is two neighbouring sums. Before the subsequence, the weight of an item's words that
occur at all is compared with what the subsequence needs; that loses nothing.

Defined cases: null or blank documents and items match nothing; equal items are all reported;
a row that occurs twice is reported twice; ids are passed through, null included; of a
document's several windows for one item the best is reported, the first of equals; texts are
read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import Stage, give_back, kept_by, ship
from tidemark.llm.words import hash_words, text_bytes

WINDOW, STRIDE = 64, 32
RANK, SPARE, POWERS = 64, 8, 2
BLOCK_ITEMS, MOST_ITEMS = 2048, 8192
SHARE, COSINE = 0.25, 0.15
LCS, SURE_LCS, ANSWER = 0.5, 0.8, 0.5
ROWS = 256
COMPARED = 1 << 16  # pairs of words compared at once
TERMS_A_ROW = 256
HIT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_ratio", pa.float64()),
     ("answer_ratio", pa.float64()), ("first_word", pa.int64())]
)


def words_of(text: str | None) -> np.ndarray:
    return hash_words(*text_bytes(pa.array([text], pa.string())))[0]


def answer_of(text: str) -> str:
    """The last sentence, or the whole text if it has one sentence."""
    return re.split(r"(?<=[.!?])\s+", text.strip())[-1]


def find(terms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word among the sorted terms, or -1."""
    if not len(terms):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    return np.where(terms[at] == words, at, -1)


def common_weight(pattern: np.ndarray, weights: np.ndarray, words: np.ndarray) -> float:
    """Largest weight of the pattern's words that a common subsequence with ``words`` holds."""
    best = np.zeros(len(words) + 1)
    for word, weight in zip(pattern, weights):
        taken = np.where(words == word, best[:-1] + weight, 0.0)
        best[1:] = np.maximum(best[1:], taken)
        best = np.maximum.accumulate(best)
    return float(best[-1])


def cuts(n_words: int) -> np.ndarray:
    """Ends of the even passages of an item, of at most ``WINDOW`` words, and 0 before them."""
    pieces = max(1, -(-n_words // WINDOW))
    return np.arange(pieces + 1) * n_words // pieces


@dataclass
class Item:
    """An item's words and their weights; the answer is a run of them at the end."""

    item_id: int | None
    words: np.ndarray
    weights: np.ndarray
    answer: int

    def judge(self, around: np.ndarray) -> tuple[float, float] | None:
        """Shares of the item's and of its answer's weight that ``around`` holds in order, if
        they are enough."""
        total, start = self.weights.sum(), len(self.words) - self.answer
        if len(self.words) * len(around) > COMPARED:
            here = np.isin(self.words, around)
        else:
            here = (self.words[:, None] == around).any(1)
        if here @ self.weights < LCS * total:
            return None
        ratio = common_weight(self.words, self.weights, around) / total
        if ratio < LCS:
            return None
        weights = self.weights[start:]
        answer = common_weight(self.words[start:], weights, around) / weights.sum()
        return (ratio, answer) if ratio >= SURE_LCS or answer >= ANSWER else None


@dataclass
class Model:
    """What a task needs to search: sorted terms, their latent vectors, the items, their passages'
    latent vectors and items."""

    terms: np.ndarray
    vectors: np.ndarray
    items: list[Item]
    latent: np.ndarray
    owner: np.ndarray

    def __post_init__(self):
        self.lengths = np.linalg.norm(self.latent, axis=1)
        # All items' words in a row, for what many candidates are asked at once.
        sizes = [len(item.words) for item in self.items]
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.asked = find(self.terms, np.concatenate([np.zeros(0, np.uint64), *(i.words for i in self.items)]))
        self.asked_weight = np.concatenate([np.zeros(0), *(i.weights for i in self.items)])
        self.least = LCS * (1 - 1e-9) * np.array([i.weights.sum() for i in self.items])
        self.padded = np.vstack([self.vectors, np.zeros((1, self.vectors.shape[1]), np.float32)])

    def candidates(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(window, item, cosine) of the items that windows may hold.

        ``starts`` are the first words of the windows' first halves, in order; a half reaches
        to the next start, and the text's last window may be one half. ``terms`` ends with -1.
        """
        halves = np.add.reduceat(self.padded[terms], starts)
        sums = halves[:-1] + halves[1:]
        length = np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        found = []
        for at in range(0, len(self.latent), BLOCK_ITEMS):
            lengths = self.lengths[at : at + BLOCK_ITEMS]
            dots = sums @ self.latent[at : at + BLOCK_ITEMS].T
            cosines = dots / (length * np.maximum(lengths, 1e-12))
            window, passage = np.nonzero((dots >= SHARE * lengths**2) & (cosines >= COSINE))
            found.append((window, self.owner[at + passage], cosines[window, passage]))
        window, item, cosine = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-cosine, item, window))  # of an item's passages the closest
        window, item, cosine = window[order], item[order], cosine[order]
        first = np.ones(len(order), bool)
        first[1:] = (window[1:] != window[:-1]) | (item[1:] != item[:-1])
        return window[first], item[first], cosine[first]

    def holds(self, place: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether words ``begin`` to ``end`` hold enough of the item's weight in any order, for
        many (item, begin, end) at once. ``place`` is each word's term.

        Occurrences are sorted by term and place; a word of an item is there if the first
        occurrence of its term from ``begin`` on lies before ``end``.
        """
        width = len(place) + 1
        wanted = np.zeros(len(self.terms) + 1, bool)
        wanted[self.asked] = True
        at = np.flatnonzero(wanted[place] & (place >= 0))
        keys = np.append(np.sort(place[at] * width + at), np.iinfo(np.int64).max)
        out = np.zeros(len(item), bool)
        sizes = (self.ends[1:] - self.ends[:-1])[item]
        groups = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + 1, COMPARED), "left")
        edges = np.unique(np.append(groups, len(item)))
        for a, b in zip(edges[:-1], edges[1:]):
            size = sizes[a:b]
            row = np.repeat(np.arange(b - a), size)
            word = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[item[a:b]], size)
            term = self.asked[word] * width
            there = keys[np.searchsorted(keys, term + begin[a:b][row])] < term + end[a:b][row]
            weight = np.bincount(row[there], self.asked_weight[word[there]], b - a)
            out[a:b] = weight >= self.least[item[a:b]]
        return out

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """(row, item, cosine, ratio, answer, first word) of the best hit of each row and item.

        ``first`` is the place of each row's first word, and the end.
        """
        size = np.diff(first)
        halves = -(-size // STRIDE)
        row = np.repeat(np.arange(len(size)), halves)
        if not len(row):
            return
        order = np.arange(len(row)) - np.repeat(np.cumsum(halves) - halves, halves)
        starts = first[row] + order * STRIDE
        last = np.append(row[1:] != row[:-1], True)
        # A text's last half has no neighbour: a blank word after each text stands for it.
        place = find(self.terms, words)
        terms = np.insert(place, first[1:], -1)
        at = np.stack([starts + row, np.where(last, first[row + 1] + row, -1)], 1).reshape(-1)
        keep = at >= 0
        window, item, cosine = self.candidates(terms, at[keep])
        source = np.repeat(np.arange(len(row)), 2)[keep]
        near: dict[tuple[int, int], list] = {}  # runs of windows to judge together
        for w, i, c in zip(window.tolist(), item.tolist(), cosine.tolist()):
            r, begin = int(row[source[w]]), int(starts[source[w]])
            size = len(self.items[i].words)
            runs = near.setdefault((r, i), [])
            if runs and size > WINDOW and begin - runs[-1][0] <= size // 4:
                runs[-1][1], runs[-1][2] = begin, max(runs[-1][2], (c, -begin))
            else:
                runs.append([begin, begin, (c, -begin)])
        flat = [(r, i, *run) for (r, i), runs in near.items() for run in runs]
        if not flat:
            return
        rows, items, begin, end = (np.array(x, np.int64) for x in list(zip(*flat))[:4])
        margin = np.maximum(STRIDE, (self.ends[1:] - self.ends[:-1])[items])
        begin = np.maximum(first[rows], begin - margin)
        end = np.minimum(first[rows + 1], end + WINDOW + margin)
        best: dict[tuple[int, int], tuple] = {}
        for k in np.flatnonzero(self.holds(place, items, begin, end)).tolist():
            r, i, _, _, (c, at) = flat[k]
            if found := self.items[i].judge(words[begin[k] : end[k]]):
                hit = (*found, c, int(first[r]) + at)
                best[r, i] = max(best.get((r, i), hit), hit)
        for (r, i), (ratio, answer, c, begin) in sorted(best.items()):
            yield r, self.items[i].item_id, c, ratio, answer, -begin


def _term_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of documents that hold each term, and number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("latent")
        counts, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows += part.num_rows
                words, first = hash_words(*text_bytes(part.column(0)))
                place = find(terms, words)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                keys = np.unique(row[place >= 0] * len(terms) + place[place >= 0])
                counts += np.bincount(keys % max(1, len(terms)), minlength=len(terms))
        seen = np.flatnonzero(counts)
        places, numbers = np.append(seen, -1), np.append(counts[seen], rows)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(numbers)], ["place", "n"])
        give_back()

    found = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts, rows = np.zeros(len(terms), np.int64), 0
    for row in found.toLocalIterator():
        if row["place"] < 0:
            rows = row["n"]
        else:
            counts[row["place"]] = row["n"]
    return counts, rows


def passages(items: DataFrame) -> DataFrame:
    """(words) of (text): a text's consecutive windows as word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = hash_words(*text_bytes(batch.column(0)))
            out = [
                words[start : min(b, start + WINDOW)].astype(np.int64)
                for a, b in zip(first[:-1], first[1:])
                for start in range(a, b, WINDOW)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["words"])

    return items.select("text").mapInArrow(run, "words array<long>")


def vocabulary(spread: DataFrame) -> np.ndarray:
    """Sorted hashes of the items' words."""
    words = spread.select(F.explode("words").alias("word")).distinct()
    return np.sort(np.array([r["word"] for r in words.toLocalIterator()], np.int64).view(np.uint64))


def _product(spread: DataFrame, terms: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the passage matrix A: tasks add up their passages, Spark the tasks."""
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(terms), width))
        for batch in batches:
            for words in batch.column(0):
                hashes = np.asarray(words.values).view(np.uint64)
                place, tf = np.unique(find(terms, hashes), return_counts=True)
                row = tf * idf[place]
                row = row / max(np.linalg.norm(row), 1e-12)
                total[place] += row[:, None] * (row @ basis[place])
        for at in range(0, len(terms), TERMS_A_ROW):
            part = total[at : at + TERMS_A_ROW].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tolist()])], ["at", "part"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.asarray(p.values) for p in parts.column("part"))
        return pa.table({"at": parts.column("at").slice(0, 1), "part": [total.tolist()]})

    schema = "at long, part array<double>"
    out = np.zeros((len(terms), width))
    summed = spread.mapInArrow(run, schema).groupBy("at").applyInArrow(add, schema)
    for row in summed.toLocalIterator():
        part = np.array(row["part"]).reshape(-1, width)
        out[row["at"] : row["at"] + len(part)] = part
    return out


def decompose(spread: DataFrame, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the passages' strongest term directions."""
    width = min(RANK + SPARE, max(1, len(terms)))
    start = np.random.Generator(np.random.Philox(key=11)).standard_normal((len(terms), width))
    basis = np.linalg.qr(start)[0]
    for _ in range(POWERS):
        image = _product(spread, terms, idf, basis)
        basis = np.linalg.qr(image)[0]
    inner = basis.T @ _product(spread, terms, idf, basis)
    order = np.argsort(np.linalg.eigh((inner + inner.T) / 2)[0])[::-1]
    turned = basis @ np.linalg.eigh((inner + inner.T) / 2)[1][:, order]
    return turned[:, :RANK]


def _items(rows: list, terms: np.ndarray, idf: np.ndarray) -> list[Item]:
    out = []
    for row in rows:
        words = words_of(row["text"])
        if len(words):
            weights = idf[find(terms, words)]
            answer = len(words_of(answer_of(row["text"])))
            out.append(Item(row["item_id"], words, weights, min(len(words), max(1, answer))))
    return out


def _fit(stage: Stage, docs: DataFrame, rows: list, name: str) -> Model | None:
    spark = docs.sparkSession
    items = spark.createDataFrame([(r["text"],) for r in rows if r["text"]], "text string")
    spread = stage.table(passages(items), f"passages-{name}")
    terms = vocabulary(spread)
    if not len(terms):
        return None
    counts, documents = _term_counts(docs, terms)
    idf = np.log((1 + documents) / (1 + counts)) + 1e-3
    vectors = idf[:, None] * decompose(spread, terms, idf)
    listed = _items(rows, terms, idf)
    latent, owner = [np.zeros((0, vectors.shape[1]))], []
    for k, item in enumerate(listed):
        ends = cuts(len(item.words))
        latent.append(np.add.reduceat(vectors[find(terms, item.words)], ends[:-1]))
        owner += [k] * (len(ends) - 1)
    latent = np.concatenate(latent).astype(np.float32)
    return Model(terms, vectors.astype(np.float32), listed, latent, np.array(owner, np.int64))


def _search(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("latent")
        model = shared.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(0).to_pylist()
                words, first = hash_words(*text_bytes(part.column(1)))
                out += [(ids[r], *hit) for r, *hit in model.search(words, first)]
            columns = list(zip(*out)) if out else [[]] * len(HIT_SCHEMA)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, HIT_SCHEMA)]
            yield pa.RecordBatch.from_arrays(arrays, schema=HIT_SCHEMA)
        give_back()

    return docs.mapInArrow(
        run,
        "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, first_word long",
    )


def contaminated(
    df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_ratio, first_word) of every passage found.

    ``benchmark`` has the columns item_id and text.
    """
    spark = df.sparkSession
    ship(spark)
    stage = Stage(spark, "latent")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    pieces = F.ceil(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")) / WINDOW)
    blocks = max(1, -(-(items.agg(F.sum(pieces)).first()[0] or 0) // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        rows = items.where(block == k).orderBy("item_id", "text").take(MOST_ITEMS + 1)
        if len(rows) > MOST_ITEMS:
            raise ValueError("Too many equal benchmark items for one block.")
        model = _fit(stage, docs, rows, str(k))
        if model is not None and model.items:
            hits = _search(docs, model)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        schema = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, first_word long"
        return spark.createDataFrame([], schema)
    return found
