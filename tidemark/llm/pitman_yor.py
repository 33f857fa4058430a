"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling.

A word's context restaurant is that of the word before it, one for every word of the corpus, and
one for the start of a text, which the end of a text stands for. All of them share the root
restaurant as parent, whose own parent is uniform over the known words and one unknown. A dish
served at a table of a context is a customer of the root.

Texts are kept as batches of word places. Words are dealt to parts of the vocabulary by their
hashes, which number them; pairs of a word and its context are dealt to the blocks of a grid, whose
rows are ranges of contexts and whose columns are ranges of words. So what a frequent word or a
frequent context has is spread over a whole column or row. Parts come to about ``PART_WORDS`` words
of batches, blocks to about ``BLOCK_TOKENS`` tokens, so tasks do not grow with the corpus.

Blocks keep the pairs that occur twice or more. A pair that occurs once has one table; so a
context has as many tables, and a word as many customers in the root, as they occur in learning
texts, less the customers of pairs that have no table of their own. A sweep sends these from blocks
to parts, and from parts to blocks what their words and contexts come to.

Each sweep takes all customers of every dish from their seats and seats them again together, given
the other dishes. Up to ``EXACT`` customers the number of tables is drawn by the weights of all
seatings; beyond, ``MOVES`` times a whole seating is drawn from a Pitman-Yor process and taken or
left by the Metropolis-Hastings rule, in steps of a table, not of a customer. How many sit at each
table changes no probability and is not kept. Probabilities are the mean of the predictive
probabilities after each of the last ``SAMPLES`` sweeps.

Defined cases: a null text is empty and scores its end alone; a row without an id is scored,
does not teach and is not held out; repeated rows count as often as they occur; without any
learning text every word is the unknown one; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import remainder
from tidemark.llm.staging import Stage, give_back, ship
from tidemark.llm.words import U64, hash_words, text_bytes

FOLDS, HELD_OUT = 7, 2
BATCH_ROWS, BATCH_BYTES = 1 << 16, 8 << 20
PART_WORDS, BLOCK_TOKENS = 1 << 20, 2 << 20
SWEEPS, SAMPLES, MOVES = 3, 2, 4
EXACT, COMPARED = 256, 1 << 18
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
END = U64(0x5851F42D4C957F2D)
# A row holds megabytes: pages and row groups end after a few rows, and so do the buffers that readers,
# writers and codecs keep for them.
SMALL_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}

BATCHES = "batch string, doc_id array<long>, held_out array<boolean>, teaches array<boolean>, sizes array<int>, n_words int, words binary, tokens binary"
# Rows of a batch in a part or a block; without a batch, the part or the block itself.
WORDS_ASKED = "part int, batch string, words binary, counts binary"
NUMBERED = "part int, batch string, n_words long, known long, tokens long, numbers binary, counts binary"
PAIRS_ASKED = "block int, batch string, words binary, contexts binary, counts binary"
PAIRS = "block int, batch string, once long, twice long, words binary, contexts binary, counts binary, seen binary, places binary"
BLOCKS = "block int, words binary, contexts binary, counts binary, seats binary"
# What a block says of its contexts and words in a part, and, without a block, a part with its sums.
JOINED = "part int, block int, side int, numbers binary, joined binary"
PARTS = "part int, block int, side int, counts binary, tables binary, customers binary, roots binary, n_customers long, n_roots long"
ANSWERS = "batch string, at int, of_words boolean, seen binary, counts binary, tables binary, customers binary, roots binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OF_CONTEXTS, OF_WORDS = 0, 1


def _batch(columns: dict, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """A record batch of ``columns``; those not given are null."""
    rows = len(next(iter(columns.values())))
    columns = {n: columns.get(n, [None] * rows) for n, _ in schema}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in schema], [n for n, _ in schema])


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
        "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<boolean>": pa.list_(pa.bool_()),
    }
    return [(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))]


def _table(rows: list[dict], ddl: str) -> pa.Table:
    schema = _arrow(ddl)
    return pa.Table.from_batches([_batch({n: [r.get(n) for r in rows] for n, _ in schema}, schema)])


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows one at a time, as each may hold megabytes; what they took goes back afterwards."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]
    give_back()


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all lowest bytes first: they are small or sorted, and go
    through shuffles and files several times."""
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _get(row: dict, name: str, kind) -> np.ndarray:
    data = row[name]
    if not (size := int.from_bytes(data[:8], "little")):
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(memoryview(data)[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pack_rising(numbers: np.ndarray) -> bytes:
    """Rising numbers as the steps between them."""
    return _pack(np.diff(numbers.astype(np.int64), prepend=0).astype(np.int32))


def _get_rising(row: dict, name: str) -> np.ndarray:
    return np.cumsum(_get(row, name, np.int32), dtype=np.int64)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def _segments(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Every distinct key with the start and end of its run."""
    found, edges = np.unique(sorted_keys, return_index=True)
    edges = np.append(edges, len(sorted_keys)).tolist()
    return zip(found.tolist(), edges, edges[1:])


# -- batches and what they ask ----------------------------------------------------------------


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Arrow batches put together up to some megabytes: the larger, the fewer rows go to parts and blocks."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def tokenize(df: DataFrame) -> DataFrame:
    """Batches of (doc_id, text, held_out, teaches): sorted word hashes, tokens as places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            hashes, first = hash_words(*text_bytes(part.column(1)))
            tokens = np.insert(hashes, first[1:], END)
            words, place = np.unique(tokens, return_inverse=True)
            place = place.astype(np.int32)
            columns = {
                "batch": [uuid.uuid4().hex],  # the table is written once and read from then on
                "doc_id": [part.column(0).to_pylist()],
                "held_out": [part.column(2).to_pylist()],
                "teaches": [part.column(3).to_pylist()],
                "sizes": [(np.diff(first) + 1).tolist()],
                "n_words": [len(words)],
                "words": [_pack(words)],
                "tokens": [_pack(place)],
            }
            yield _batch(columns, _arrow(BATCHES))
        give_back()

    return df.mapInArrow(run, BATCHES)


class Layout:
    """How words and pairs are dealt out: 2 ** ``bits`` parts of the vocabulary by the first bits of
    the words' hashes, and ``grid`` ranges of parts, which are the rows and columns of the blocks.
    ``sizes`` are the parts' numbers of words."""

    def __init__(self, bits: int, grid: int, sizes: dict[int, int] | None = None):
        self.bits, self.grid = bits, grid
        parts = np.arange(1 << bits)
        self.offsets = np.cumsum([0, *((sizes or {}).get(p, 0) for p in parts.tolist())])
        self.first = self.offsets[np.searchsorted(self.ranges(parts), np.arange(grid))]

    def parts(self, words: np.ndarray) -> np.ndarray:
        return (words >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(words), np.int64)

    def ranges(self, parts: np.ndarray) -> np.ndarray:
        return parts * self.grid >> self.bits

    def start(self, block: int, side: int) -> int:
        """The first number of a block's contexts or words."""
        return int(self.first[block % self.grid if side else block // self.grid])


def ask_words(batches: DataFrame, layout: Layout) -> DataFrame:
    """One row per batch and part of the vocabulary: its words there, with their counts in learning texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in _rows(batch):
                words, tokens = _get(row, "words", U64), _get(row, "tokens", np.int32)
                teaches = np.repeat(np.asarray(row["teaches"], bool), np.asarray(row["sizes"], np.int64))
                counts = np.bincount(tokens[teaches], minlength=len(words)).astype(np.int32)
                for part, a, b in _segments(layout.parts(words)):
                    columns = {
                        "part": [part], "batch": [row["batch"]],
                        "words": [_pack(words[a:b])], "counts": [_pack(counts[a:b])],
                    }
                    yield _batch(columns, _arrow(WORDS_ASKED))

    asked = batches.select("batch", "sizes", "teaches", "words", "tokens")
    return asked.mapInArrow(run, WORDS_ASKED)


def number(asked: pa.Table) -> pa.Table:
    """The words of one part numbered in the order of their hashes: their counts, and each batch's numbers."""
    rows = asked.to_pylist()
    words = [_get(r, "words", U64) for r in rows]
    found, place = np.unique(np.concatenate(words), return_inverse=True)
    place = place.reshape(-1)
    counts = np.bincount(place, np.concatenate([_get(r, "counts", np.int32) for r in rows]), len(found)).astype(np.int64)
    part, edges = rows[0]["part"], np.cumsum([0, *map(len, words)])
    out = [
        {
            "part": part, "n_words": len(found), "known": int((counts > 0).sum()), "tokens": int(counts.sum()),
            "counts": _pack(counts),
        }
    ]
    for row, a, b in zip(rows, edges, edges[1:]):
        out.append({"part": part, "batch": row["batch"], "numbers": _pack_rising(place[a:b])})
    return _table(out, NUMBERED)


def _pairs(row: dict, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's distinct pairs of a word and the one before it, by their places among the batch's
    words, and each token's place among the pairs. Before a text's first word stands an end."""
    tokens, sizes = _get(row, "tokens", np.int32).astype(np.int64), np.asarray(row["sizes"], np.int64)
    ends = np.cumsum(sizes)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[ends - sizes] = tokens[ends - 1]
    bits = n_words.bit_length()
    codes, at = np.unique(tokens << bits | context, return_inverse=True)
    return codes >> bits, codes & ((1 << bits) - 1), at.reshape(-1), tokens


def _deal(layout: Layout, parts: np.ndarray, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a batch's pairs by blocks, and their blocks in that order; ``parts`` are those of its words."""
    own = layout.ranges(parts)
    blocks = own[contexts] * layout.grid + own[words]
    blocks = blocks.astype(np.uint16 if layout.grid <= 256 else np.int64)
    order = np.argsort(blocks, kind="stable")
    return order, blocks[order]


def _numbers(numbered: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a batch's words and their numbers there, in the order of the words."""
    rows = sorted(numbered.to_pylist(), key=lambda r: r["part"])
    numbers = [_get_rising(r, "numbers") for r in rows]
    return np.repeat([r["part"] for r in rows], [len(x) for x in numbers]), np.concatenate(numbers)


def ask_pairs(batch: pa.Table, numbered: pa.Table, layout: Layout) -> pa.Table:
    """One row per block of a batch: its pairs there, with their counts in learning texts."""
    row = batch.to_pylist()[0]
    parts, numbers = _numbers(numbered)
    words, contexts, at, _ = _pairs(row, row["n_words"])
    teaches = np.repeat(np.asarray(row["teaches"], bool), np.asarray(row["sizes"], np.int64))
    counts = np.bincount(at[teaches], minlength=len(words)).astype(np.int32)
    own = (layout.offsets[parts] + numbers - layout.first[layout.ranges(parts)]).astype(np.int32)
    order, blocks = _deal(layout, parts, words, contexts)
    words, contexts, counts = own[words[order]], own[contexts[order]], counts[order]
    out = [
        {
            "block": block, "batch": row["batch"], "words": _pack_rising(words[a:b]),
            "contexts": _pack(contexts[a:b]), "counts": _pack(counts[a:b]),
        }
        for block, a, b in _segments(blocks)
    ]
    return _table(out, PAIRS_ASKED)


def merge(asked: pa.Table) -> pa.Table:
    """All batches' rows of one block: distinct pairs of two customers or more with their counts, and
    for each batch whether its pairs were seen never, once or more often, and the places of the last."""
    rows = asked.to_pylist()
    codes = [_get_rising(r, "words") << 32 | _get(r, "contexts", np.int32) for r in rows]
    edges = np.cumsum([0, *map(len, codes)])
    codes, place = np.unique(np.concatenate(codes), return_inverse=True)
    place = place.reshape(-1)
    counts = np.bincount(place, np.concatenate([_get(r, "counts", np.int32) for r in rows]), len(codes)).astype(np.int64)
    many = counts > 1
    kept, rank = codes[many], np.cumsum(many) - 1
    block = rows[0]["block"]
    out = [
        {
            "block": block, "once": int((counts == 1).sum()), "twice": int((counts == 2).sum()),
            "words": _pack_rising(kept >> 32), "contexts": _pack((kept & 0xFFFFFFFF).astype(np.int32)),
            "counts": _pack(counts[many]),
        }
    ]
    seen = np.minimum(counts, 2).astype(np.uint8)
    for row, a, b in zip(rows, edges, edges[1:]):
        own = place[a:b]
        places = _pack_rising(rank[own[many[own]]])
        out.append({"block": block, "batch": row["batch"], "seen": _pack(seen[own]), "places": places})
    return _table(out, PAIRS)


# -- seating ----------------------------------------------------------------------------------


def first_seats(counts: np.ndarray, discount: float) -> np.ndarray:
    """Numbers of tables to start from: those expected of a long-running restaurant."""
    return np.clip(np.rint(counts.astype(float) ** discount), np.minimum(counts, 1), counts).astype(np.int64)


def spread(counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Table sizes, dish after dish, as even as they can be."""
    owner = np.repeat(np.arange(len(counts)), tables)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(tables) - tables, tables)
    return counts[owner] // tables[owner] + (order < counts[owner] % tables[owner])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    y = x + 6
    low = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + (1 / 12 - (1 / 360 - 1 / 1260 / y**2) / y**2) / y - low


def draw_tables(counts: np.ndarray, strength: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Number of tables of a Pitman-Yor process after ``counts`` customers, one of its own for each.

    With i customers at t tables, the wait for the next table is geometric with a chance from
    Beta(strength + discount * t, i - discount * t).
    """
    tables = np.minimum(counts, 1)
    active = np.flatnonzero(counts > 1)
    seated, most, own = np.ones(len(active)), counts[active].astype(float), strength[active]
    turn = 1
    while len(active):
        chance = draw.beta(own + discount * turn, seated - discount * turn)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            wait = np.ceil(-draw.standard_exponential(len(active)) / np.log1p(-chance))
        seated = seated + np.fmax(wait, 1)
        on = np.flatnonzero(seated <= most)
        active, seated, most, own = active[on], seated[on], most[on], own[on]
        turn += 1
        tables[active] = turn
    return tables


@lru_cache(4)
def seatings(discount: float) -> np.ndarray:
    """Logarithms of the weights of all seatings of n customers at t tables, up to ``EXACT`` of them."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        out[n + 1, 1] = out[n, 1] + np.log(n - discount)
        k = t[1 : n + 1]
        joins = np.log(np.maximum(n - discount * k, 1e-300)) + out[n, 2 : n + 2]
        out[n + 1, 2 : n + 2] = np.logaddexp(joins, out[n, 1 : n + 1])
    return out


def seat_small(counts: np.ndarray, mass: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of dishes with at most ``EXACT`` customers, drawn from all numbers by their weights."""
    tables = np.ones(len(counts), np.int64)
    order = np.argsort(counts, kind="stable")
    sorted_counts = counts[order]
    table, log_mass = seatings(discount), np.log(mass)
    at = 0
    while at < len(order):
        n = int(sorted_counts[at])
        end = min(int(np.searchsorted(sorted_counts, n, "right")), at + max(1, COMPARED // n))
        own = order[at:end]
        weight = table[n, 1 : n + 1] + log_mass[own, None] * np.arange(1, n + 1)
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
        tables[own] = 1 + (weight < draw.random((len(own), 1)) * weight[:, -1:]).sum(1)
        at = end
    return tables


def seat(
    counts: np.ndarray, tables: np.ndarray, mass: np.ndarray, discount: float, draw: np.random.Generator, moves: int
) -> np.ndarray:
    """Numbers of tables after all customers of each dish have been seated anew.

    ``mass`` is what a new table weighs: the restaurant's share for new tables times the dish's
    probability in the parent. A seating at t tables weighs mass ** t times the tables' own weights.

    Up to ``EXACT`` customers are seated by these weights. For more, a seating is proposed ``moves``
    times from a process whose strength makes a new table weigh about as much at the number of
    tables to be expected; the weights of two seatings under both differ by t alone.
    """
    tables = tables.astype(np.int64)
    mass = np.maximum(mass, 1e-300)
    small = np.flatnonzero((counts > 1) & (counts <= EXACT))
    tables[small] = seat_small(counts[small], mass[small], discount, draw)
    large = np.flatnonzero(counts > EXACT)
    number, now, mass = counts[large].astype(np.int64), tables[large], mass[large]
    above = mass * number**-discount  # strength + discount
    for _ in range(6):
        above = mass * ((above + (1 - discount) / 2) / (above + number - (1 + discount) / 2)) ** discount
    above = np.maximum(above, 1e-9)
    strength, log_mass = above - discount, np.log(mass / discount)

    def weight(t: np.ndarray) -> np.ndarray:
        return t * log_mass - log_gamma(strength / discount + t)

    for _ in range(moves):
        other = draw_tables(number, strength, discount, draw)
        taken = np.log(draw.random(len(now))) < weight(other) - weight(now)
        now = np.where(taken, other, now)
    tables[large] = now
    return tables


def reseat(
    sizes: np.ndarray, tables: np.ndarray, mass: np.ndarray, discount: float, draw: np.random.Generator, moves: int
) -> tuple[np.ndarray, np.ndarray]:
    """``seat`` for dishes given by their tables' sizes: sizes, as even as can be, and numbers of tables."""
    start = np.cumsum(tables) - tables
    counts = np.add.reduceat(sizes, start) if len(start) else sizes
    tables = seat(counts, tables, mass, discount, draw, moves)
    return spread(counts, tables), tables


class Block:
    """The pairs of one block that occur twice or more, with their numbers of tables."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.words, self.contexts = _get_rising(row, "words"), _get(row, "contexts", np.int32)
        self.counts = _get(row, "counts", np.int64)
        self.seats = _get(row, "seats", np.int32).astype(np.int64) if row.get("seats") else np.ones_like(self.counts)

    def distinct(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words or contexts, and the place of each pair's among them."""
        found, at = np.unique(self.words if side else self.contexts, return_inverse=True)
        return found.astype(np.int64), at.reshape(-1)

    def row(self) -> dict:
        return {
            "block": self.block, "words": _pack_rising(self.words), "contexts": _pack(self.contexts),
            "counts": _pack(self.counts), "seats": _pack(self.seats.astype(np.int32)),
        }


def start(pairs: DataFrame, discount: float) -> DataFrame:
    """All blocks after the first seating."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block(row)
                block.seats = first_seats(block.counts, discount)
                yield _batch({k: [v] for k, v in block.row().items()}, _arrow(BLOCKS))

    return pairs.where("batch IS NULL").select("block", "words", "contexts", "counts").mapInArrow(run, BLOCKS)


def joined(blocks: DataFrame, layout: Layout, sides: tuple[int, ...] = (OF_CONTEXTS, OF_WORDS)) -> DataFrame:
    """For the contexts and words of each block, by parts, how many customers have no table of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block(row)
                for side in sides:
                    found, at = block.distinct(side)
                    less = np.bincount(at, block.counts - block.seats, len(found)).astype(np.int64)
                    found += layout.start(block.block, side)
                    for part, a, b in _segments(np.searchsorted(layout.offsets, found, "right") - 1):
                        columns = {
                            "part": [part], "block": [block.block], "side": [side],
                            "numbers": [_pack_rising(found[a:b] - layout.offsets[part])],
                            "joined": [_pack(less[a:b])],
                        }
                        yield _batch(columns, _arrow(JOINED))

    return blocks.mapInArrow(run, JOINED)


def _kinds(part: pa.Table, asked: pa.Table) -> pa.Table:
    """How many words of a part occur in one context, and how many in two."""
    contexts = _get(part.to_pylist()[0], "counts", np.int64)
    for row in _rows(asked):
        contexts[_get_rising(row, "numbers")] -= _get(row, "joined", np.int64)
    return pa.table({"once": [int((contexts == 1).sum())], "twice": [int((contexts == 2).sum())]})


def _sum_up(part: pa.Table, asked: pa.Table, state: dict, turn: int, answers: bool) -> pa.Table:
    """A part after the blocks' first seating (turn 0) or sweep: tables of its words as contexts, customers and
    tables of its words in the root, seated anew; and these for each block that has told of its own."""
    row = part.to_pylist()[0]
    counts = _get(row, "counts", np.int64)
    tables, customers = counts.copy(), counts.copy()
    told = []
    for r in _rows(asked):
        numbers = _get_rising(r, "numbers")
        (customers if r["side"] == OF_WORDS else tables)[numbers] -= _get(r, "joined", np.int64)
        told.append((r["block"], r["side"], numbers))
    if turn:
        # The root's customers came and went with the tables; they are seated from as many tables as before.
        roots = np.clip(_get(row, "roots", np.int64), np.minimum(customers, 1), customers)
        base = (ROOT_STRENGTH + state["root_discount"] * state["root_tables"]) / (state["known"] + 1)
        draw = np.random.Generator(np.random.Philox(key=[turn, 1 << 32 | row["part"]]))
        roots = seat(customers, roots, np.full(len(customers), base), state["root_discount"], draw, MOVES)
    else:
        roots = first_seats(customers, state["root_discount"])
    out = [
        {
            "part": row["part"], "counts": row["counts"], "tables": _pack(tables), "customers": _pack(customers),
            "roots": _pack(roots), "n_customers": int(customers.sum()), "n_roots": int(roots.sum()),
        }
    ]
    for block, side, numbers in told if answers else []:
        own = {"part": row["part"], "block": block, "side": side}
        if side == OF_WORDS:
            own |= {"customers": _pack(customers[numbers]), "roots": _pack(roots[numbers])}
        else:
            own["tables"] = _pack(tables[numbers])
        out.append(own)
    return _table(out, PARTS)


def _sweep(blocks: pa.Table, answers: pa.Table, state: dict, turn: int) -> pa.Table:
    """A block after one more sweep."""
    block = Block(blocks.to_pylist()[0])
    rows = sorted(answers.to_pylist(), key=lambda r: r["part"])
    tables = _joined([_get(r, "tables", np.int64) for r in rows if r["side"] == OF_CONTEXTS], np.int64)
    customers = _joined([_get(r, "customers", np.int64) for r in rows if r["side"] == OF_WORDS], np.int64)
    roots = _joined([_get(r, "roots", np.int64) for r in rows if r["side"] == OF_WORDS], np.int64)
    share = STRENGTH + state["discount"] * tables
    mass = share[block.distinct(OF_CONTEXTS)[1]] * parent(customers, roots, state)[block.distinct(OF_WORDS)[1]]
    draw = np.random.Generator(np.random.Philox(key=[turn, block.block]))
    block.seats = seat(block.counts, block.seats, mass, state["discount"], draw, MOVES)
    return _table([block.row()], BLOCKS)


def parent(customers: np.ndarray, roots: np.ndarray, state: dict) -> np.ndarray:
    """Probability in the root of words by their customers and tables there."""
    own = np.maximum(customers - state["root_discount"] * roots, 0.0)
    return own / (ROOT_STRENGTH + state["customers"]) + unknown(state)


def unknown(state: dict) -> float:
    """Probability in the root of a word that no learning text has."""
    share = ROOT_STRENGTH + state["root_discount"] * state["root_tables"]
    return share / (ROOT_STRENGTH + state["customers"]) / (state["known"] + 1)


def _discount(once: int, twice: int) -> float:
    """The usual estimate of a discount from dishes with one and with two customers."""
    return float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95))


# -- scores -----------------------------------------------------------------------------------


def _samples(rows: pa.Table) -> list[dict]:
    return sorted(_rows(rows), key=lambda r: r["sample"])


def _answer_pairs(asked: pa.Table, samples: pa.Table) -> pa.Table:
    """For each batch's pairs in a block whether they were seen, and counts and tables of those seen twice or more."""
    rows = _samples(samples)
    counts = _get(rows[0], "counts", np.int64)
    seats = np.stack([_get(r, "seats", np.int32) for r in rows])
    out = []
    for row in _rows(asked):
        places = _get_rising(row, "places")
        out.append({
            "batch": row["batch"], "at": row["block"], "of_words": False, "seen": row["seen"],
            "counts": _pack(counts[places]), "tables": _pack(seats[:, places].reshape(-1)),
        })
    return _table(out, ANSWERS)


def _answer_words(asked: pa.Table, samples: pa.Table) -> pa.Table:
    """For each batch's words in a part their counts, and by samples the customers without a table of their
    own in the word's restaurant, those of the word, and the word's tables in the root."""
    rows = _samples(samples)
    counts = _get(rows[0], "counts", np.int64)
    tables, customers, roots = (
        np.stack([_get(r, name, np.int64) for r in rows]) for name in ("tables", "customers", "roots")
    )
    tables, customers = counts - tables, counts - customers
    out = []
    for row in _rows(asked):
        numbers = _get_rising(row, "numbers")
        out.append({
            "batch": row["batch"], "at": row["part"], "of_words": True, "counts": _pack(counts[numbers]),
            "tables": _pack(tables[:, numbers].reshape(-1)),
            "customers": _pack(customers[:, numbers].reshape(-1)), "roots": _pack(roots[:, numbers].reshape(-1)),
        })
    return _table(out, ANSWERS)


def _by_sample(rows: list[dict], name: str, kind, samples: int) -> np.ndarray:
    return np.concatenate([_get(r, name, kind).reshape(samples, -1) for r in rows], axis=1)


def _total(batch: pa.Table, answers: pa.Table, layout: Layout, states: list[dict]) -> pa.Table:
    """Scores of one batch's documents: sums of log10 of the mean predictive probabilities."""
    row = batch.to_pylist()[0]
    rows = sorted(answers.to_pylist(), key=lambda r: r["at"])
    of_words, of_pairs = [r for r in rows if r["of_words"]], [r for r in rows if not r["of_words"]]
    n, first = len(states), states[0]
    counts = [_get(r, "counts", np.int64) for r in of_words]
    parts, counts = np.repeat([r["at"] for r in of_words], [len(x) for x in counts]), np.concatenate(counts)
    less_tables, less_customers, roots = (
        _by_sample(of_words, name, np.int64, n) for name in ("tables", "customers", "roots")
    )
    words, contexts, at, tokens = _pairs(row, len(counts))
    order, _ = _deal(layout, parts, words, contexts)
    words, contexts = words[order], contexts[order]
    own = np.concatenate([_get(r, "seen", np.uint8) for r in of_pairs]).astype(np.int64)
    many = np.flatnonzero(own == 2)
    seated = np.minimum(own, 1)
    own[many] = np.concatenate([_get(r, "counts", np.int64) for r in of_pairs])
    tables = _by_sample(of_pairs, "tables", np.int32, n)
    mean = 0.0
    for k, state in enumerate(states):
        seated[many] = tables[k]
        share = STRENGTH + state["discount"] * (counts - less_tables[k])
        root = parent(counts - less_customers[k], roots[k], state)
        mean += (own - state["discount"] * seated + share[contexts] * root[words]) / (STRENGTH + counts[contexts])
    scores = np.empty(len(order))
    scores[order] = np.log10(mean / n)
    sizes = np.asarray(row["sizes"], np.int64)
    base = np.log10((counts + 1) / (first["tokens"] + first["known"] + 1))[tokens]
    starts = np.cumsum(sizes) - sizes
    columns = {
        "doc_id": row["doc_id"], "held_out": row["held_out"], "n_tokens": sizes,
        "n_known": np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts),
        "train_tokens": np.full(len(sizes), first["tokens"]), "base_score": np.add.reduceat(base, starts),
        "score": np.add.reduceat(scores[at], starts),
    }
    return pa.Table.from_batches([_batch(columns, _arrow(SCORES))])


def _sum(df: DataFrame, *names: str) -> list[int]:
    """Sums of columns over all rows, however many: one row reaches the driver."""
    return [int(x or 0) for x in df.agg(*(F.sum(n) for n in names)).first()]


def _meet(left: DataFrame, right: DataFrame, key: str, run, schema: str) -> DataFrame:
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = df.sparkSession
    ship(spark)
    stage = Stage(spark, "pitman-yor", SMALL_PAGES)
    fold = remainder(F.col("doc_id"), FOLDS)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id",
        "text",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(fold != HELD_OUT, F.lit(False)).alias("teaches"),
    )
    batches = stage.table(tokenize(docs), "batches")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    n_tokens, n_words = _sum(batches.select(size.alias("n_tokens"), "n_words"), "n_tokens", "n_words")
    grid = max(1, int(np.ceil(np.sqrt(n_tokens / BLOCK_TOKENS))))
    bits = int(np.ceil(np.log2(max(1, grid, n_words / PART_WORDS))))

    asked = ask_words(batches, Layout(bits, grid))
    numbered = stage.table(asked.groupBy("part").applyInArrow(number, NUMBERED), "words")
    vocabulary, numbers = numbered.where("batch IS NULL"), numbered.where("batch IS NOT NULL")
    numbers = numbers.select("part", "batch", "numbers")
    # A number for each part, of about a million words in batches.
    layout = Layout(bits, grid, {r["part"]: r["n_words"] for r in vocabulary.select("part", "n_words").collect()})
    known, tokens = _sum(vocabulary, "known", "tokens")
    asked = batches.select("batch", "sizes", "teaches", "n_words", "tokens")
    asked = _meet(asked, numbers, "batch", lambda a, b: ask_pairs(a, b, layout), PAIRS_ASKED)
    pairs = stage.table(asked.groupBy("block").applyInArrow(merge, PAIRS), "pairs")

    blocks = pairs.where("batch IS NULL").select("block", "words", "contexts", "counts")
    parts = vocabulary.select("part", "counts")
    state = {"known": known, "tokens": tokens, "discount": _discount(*_sum(pairs, "once", "twice"))}
    kinds = _meet(parts, joined(blocks, layout, (OF_WORDS,)), "part", _kinds, "once long, twice long")
    state["root_discount"] = _discount(*_sum(kinds, "once", "twice"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    states, block_samples, part_samples = [], [], []
    for turn in range(SWEEPS + 1):
        if turn:
            # Few bytes take long to seat: partitions are not put together by their bytes.
            blocks, answers = (x.repartition(partitions, "block") for x in (blocks, answers))
            blocks = _meet(blocks, answers, "block", lambda a, b: _sweep(a, b, state, turn), BLOCKS)
        else:
            blocks = start(pairs, state["discount"])
        blocks = stage.table(blocks, f"blocks-{turn}")
        told = joined(blocks, layout)
        summed = _meet(parts, told, "part", lambda a, b: _sum_up(a, b, state, turn, turn < SWEEPS), PARTS)
        summed = stage.table(summed, f"parts-{turn}")
        parts, answers = summed.where("block IS NULL"), summed.where("block IS NOT NULL")
        parts = parts.select("part", "counts", "tables", "customers", "roots", "n_customers", "n_roots")
        answers = answers.select("part", "block", "side", "tables", "customers", "roots")
        if 0 <= turn - 1 <= SWEEPS - SAMPLES:
            stage.drop(f"blocks-{turn - 1}", f"parts-{turn - 1}")
        customers, root_tables = _sum(parts, "n_customers", "n_roots")
        state = state | {"customers": customers, "root_tables": root_tables}
        if turn > SWEEPS - SAMPLES:
            sample = F.lit(len(states)).alias("sample")
            block_samples.append(blocks.select("block", "counts", "seats", sample))
            part_samples.append(parts.select("part", "counts", "tables", "customers", "roots", sample))
            states.append(state)

    of_pairs = pairs.where("batch IS NOT NULL").select("block", "batch", "seen", "places")
    of_pairs = _meet(of_pairs, reduce(DataFrame.unionByName, block_samples), "block", _answer_pairs, ANSWERS)
    of_words = _meet(numbers, reduce(DataFrame.unionByName, part_samples), "part", _answer_words, ANSWERS)
    asked = batches.select("batch", "doc_id", "held_out", "sizes", "tokens")
    return _meet(asked, of_pairs.unionByName(of_words), "batch", lambda a, b: _total(a, b, layout, states), SCORES)
