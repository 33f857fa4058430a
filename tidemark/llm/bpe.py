"""Byte-level BPE with forced boundaries.

A merge can only join two bytes that stand side by side inside some vocabulary token. Every
other byte pair is a certain cut: what lies left and right of it can be encoded apart and put
together again. A text is first cut before each blank run (no token has a blank after another
character), then by the tokenizer's own pattern, then at every forced byte pair; runs and pieces of
the pattern seen before are looked up instead of being merged again, in tables of bounded size that a
worker keeps from task to task. A long fragment is merged from a heap, in n log n steps.

Defined cases: a null text reads as empty and gives no ids; ids that form broken UTF-8 decode
with replacement characters; texts of any length are read whole, ``SLICE`` characters at a
time; rows are independent of each other, so repeats and ties need no rule, and other columns
stay as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.staging import give_back, kept_by, ship

# Unicode white space, and the pattern of this kind of tokenizer.
SPACE = "\t-\r " + "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
PRETOKENS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
ASCII_PRETOKENS = re.compile(  # the same for texts of such characters only
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{SPACE}A-Za-z0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BOUNDARY = re.compile(f"[^{SPACE}][{SPACE}]")
SLICE = 1 << 20
NEVER = 1 << 31
KEPT_RUNS, NEW_RUNS, KEPT_PIECES, KEPT_LENGTH = 1 << 18, 1 << 17, 1 << 18, 64
SHORT = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable ones for
    themselves, the rest counted up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = {}, 256
    for byte in range(256):
        if byte in plain:
            out[chr(byte)] = byte
        else:
            out[chr(spare)] = byte
            spare += 1
    return out


class Vocabulary:
    """What one tokenizer file says: tokens' bytes, merges, special tokens, forced pairs."""

    def __init__(self, file_text: str):
        data = json.loads(file_text)
        model, letters = data["model"], byte_letters()
        before = data["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("Only byte-level BPE without an added blank is supported.")
        if data["normalizer"] or not before.get("use_regex", True):
            raise ValueError("A normalizer or another pattern is not supported.")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(re.search(f"[{SPACE}]", t) for t in self.special):
            raise ValueError("Special tokens with blanks are not supported.")
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = {b: vocab[c] for c, b in letters.items()}
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        # Ranks of pairs of single bytes, where every merge starts.
        letters_of = [self.of_byte[b] for b in range(256)]
        self.first = [self.ranks.get((a, b), NEVER) for a in letters_of for b in letters_of]
        self.forced = bytearray(b"\1" * (1 << 16))
        for token in self.bytes:
            for left, right in zip(token, token[1:]):
                self.forced[left << 8 | right] = 0

    def cut(self, data: bytes) -> list[bytes]:
        """Fragments of ``data`` between its forced boundaries."""
        forced = self.forced
        cuts = [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if forced[a << 8 | b]]
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])] if cuts else [data]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the earliest merge first, leftmost first."""
        ids = list(map(self.of_byte.__getitem__, fragment))
        if len(ids) > SHORT:
            return self.merge_long(ids)
        first, rank_of, made = self.first, self.ranks.get, self.made
        order = [first[a << 8 | b] for a, b in zip(fragment, fragment[1:])]
        while order and (rank := min(order)) < NEVER:
            at = order.index(rank)
            ids[at] = new = made[rank]
            del ids[at + 1], order[at]
            if at:
                order[at - 1] = rank_of((ids[at - 1], new), NEVER)
            if at < len(order):
                order[at] = rank_of((new, ids[at + 1]), NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place) over a linked list of symbols, in
        n log n steps. An entry counts only while its pair still has the rank it was filed
        under; a symbol taken in by its left neighbour is marked with -1."""
        n, ranks = len(ids), self.ranks
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            after = right[at]
            if ids[at] < 0 or after >= n or ranks.get((ids[at], ids[after])) != rank:
                continue
            ids[at], ids[after] = self.made[rank], -1
            right[at] = after = right[after]
            if after < n:
                left[after] = at
                if (rank := ranks.get((ids[at], ids[after]))) is not None:
                    heapq.heappush(heap, (rank, at))
            if (before := left[at]) >= 0 and (rank := ranks.get((ids[before], ids[at]))) is not None:
                heapq.heappush(heap, (rank, before))
        return [i for i in ids if i >= 0]


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers; as bytes they are nothing for the garbage collector to visit."""
    return array("I", ids).tobytes()


def keep(cache: dict, key, value, most: int) -> None:
    """Enter a pair; a full table first forgets its older half."""
    if len(cache) >= most:
        for old in list(islice(cache, most // 2)):
            del cache[old]
    cache[key] = value


class Runs(dict):
    """Ids (as 32-bit numbers) of a blank run with the characters after it.

    A run enters the table when it is seen again while it is still among the new ones: most runs
    occur once and would only push out those that come back.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces: dict[str | bytes, bytes] = {}  # pretokens and the fragments of cut ones
        self.new: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def __missing__(self, run: str) -> bytes:
        ids = self.new.pop(run, None)
        if ids is not None:
            keep(self, run, ids, KEPT_RUNS)
            return ids
        ids = self.encode(run)
        if len(run) <= KEPT_LENGTH:
            keep(self.new, run, ids, NEW_RUNS)
        return ids

    def encode(self, run: str) -> bytes:
        if not self.split or not self.split.search(run):
            return self.plain(run)
        special = self.vocabulary.special
        parts = self.split.split(run)
        return b"".join([packed([special[p]]) if p in special else self.plain(p) for p in parts])

    def plain(self, run: str) -> bytes:
        """Ids of a run without special tokens."""
        pretokens = (ASCII_PRETOKENS if run.isascii() else PRETOKENS).findall(run)
        return b"".join([self.pieces.get(p) or self.pretoken(p) for p in pretokens])

    def pretoken(self, pretoken: str) -> bytes:
        fragments = self.vocabulary.cut(pretoken.encode("utf-8"))
        if len(fragments) == 1:
            ids = packed(self.vocabulary.merge(fragments[0]))
        else:
            ids = b"".join([self.pieces.get(f) or self.fragment(f) for f in fragments])
        if len(pretoken) <= KEPT_LENGTH:
            keep(self.pieces, pretoken, ids, KEPT_PIECES)
        return ids

    def fragment(self, fragment: bytes) -> bytes:
        ids = packed(self.vocabulary.merge(fragment))
        if len(fragment) <= KEPT_LENGTH:
            keep(self.pieces, fragment, ids, KEPT_PIECES)
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        if len(text) <= SLICE:
            return b"".join(map(self.__getitem__, RUNS.findall(text)))
        out, start = [], 0
        while start < len(text):
            edge = BOUNDARY.search(text, start + SLICE)
            end = edge.start() + 1 if edge else len(text)
            out += map(self.__getitem__, RUNS.findall(text[start:end]))
            start = end
        return b"".join(out)


def load(file_text: str) -> Runs:
    """One table of runs per worker and tokenizer file."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    loaded = kept_by("bpe")
    if key not in loaded:
        loaded.clear()
        loaded[key] = Runs(Vocabulary(file_text))
    return loaded[key]


def token_lists(texts: list[bytes]) -> pa.Array:
    """Packed 32-bit ids of each row as one list column."""
    ends = np.cumsum([0, *(len(t) // 4 for t in texts)])
    ids = np.frombuffer(b"".join(texts), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


class Tokens:
    """Bytes of ids, looked up for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        raw = []
        for at in range(0, len(ids), SLICE):
            part = ids[at : at + SLICE]
            size = self.lengths[part]
            place = np.repeat(self.starts[part] - np.cumsum(size) + size, size)
            raw.append(self.letters[place + np.arange(len(place))].tobytes())
        return b"".join(raw).decode("utf-8", "replace")


class Codec:
    """Encoder and decoder columns for one tokenizer file, which is read on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        with open(path, encoding="utf-8") as file:
            self.file = spark.sparkContext.broadcast(file.read())

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """Add the text's token ids, an array of int."""
        file = self.file

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            runs = load(file.value)
            for batch in batches:
                yield token_lists([runs.text(t.as_py() or "") for t in batch])

        return df.withColumn(ids, run(F.col(text)))

    def decode(self, df: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """Add the text that the ids stand for."""
        file = self.file

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = Tokens(load(file.value).vocabulary.bytes)
            for batch in batches:
                rows = (np.asarray(r.values) if r.is_valid else np.zeros(0, np.int32) for r in batch)
                yield pa.array([tokens.text(r) for r in rows], pa.string())

        return df.withColumn(text, run(F.col(ids)))

    def round_trip(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``ids`` and ``decoded``, the text of those ids, in one pass through Python."""
        file = self.file

        @F.arrow_udf("ids array<int>, decoded string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            runs = load(file.value)
            tokens = Tokens(runs.vocabulary.bytes)
            for batch in batches:
                packed = [runs.text(t.as_py() or "") for t in batch]
                decoded = [tokens.text(np.frombuffer(p, "<i4")) for p in packed]
                columns = [token_lists(packed), pa.array(decoded, pa.string())]
                del packed, decoded
                yield pa.StructArray.from_arrays(columns, ["ids", "decoded"])
                del columns
                give_back()

        rest = [F.col(f"`{c}`") for c in df.columns if c not in ("ids", "decoded", "_both")]
        found = df.select(*rest, run(F.col(text)).alias("_both"))
        return found.select(*rest, "_both.ids", "_both.decoded")
