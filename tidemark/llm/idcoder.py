"""Token-id files packed by a context-mixing arithmetic coder.

Tables guess the next id from the last id (order 1) and from the last two (order 2). Whether the better
guess holds is one binary decision: predictions from how often such guesses held so far (order 0), from
the order-1 and from the order-2 guess are mixed in the logistic domain with weights that learn as well.
An id that was not guessed follows by the frequencies of ids so far. Both drive one range coder.

A task codes about ``LANES`` blocks of ``BLOCK`` ids side by side, one array element each; they share a
model that starts blank and learns from all of them after each span of steps. A decision depends on few
small numbers (the trust in both guesses, whether they agree), so within a span mixing is one lookup in the
table of all their cases. Every block carries its length and the checksum of its ids.

All arithmetic is on whole numbers, so that files decode alike on any machine.

A file is a sequence of groups: the group's length, documents (id, number of ids), blocks
(number of ids, bytes, CRC-32), then the blocks' bytes. Tasks write one file each, over
documents in ascending order of id; the manifest names the files of finished tasks only.

Texts are cut where no match of the byte-level pattern can reach across, many texts at once; the pieces are
encoded by the tokenizers library once and looked up afterwards, in a bounded table.

Defined cases: a null text is empty, so only its end id is stored; null ids come first;
repeated ids stand side by side, in the order of their texts' hashes; ids up to 65535 can be
coded, others are an error; an empty table makes no file.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import SPACE, byte_letters
from tidemark.llm.staging import kept_by, ship
from tidemark.llm.warc import open_folder

MAGIC = b"TIDS0003"
BLOCK, LANES, BITS = 1024, 4096, 16
SLOT_BITS, MOST_TRUST = 16, 15
SPAN, LEARNING = 16, 40  # steps after which the model learns; rate of the mixing weights
CHUNK = 1 << 14  # entries of a table renewed at once
FEW, MOST_SEEN = 2, 1 << 16  # weight of the first odds, and where counts of odds are halved
SURE = 8  # least share of either outcome of a decision, in 4096ths
TOTAL_BITS, REFRESH = 18, 32  # of frequencies, taken anew after so many steps (and after 1, 2, 4, ...)
WORD = np.uint64(32)  # bits put out at once; the interval stays wider than that
LEAST = np.uint64(1 << 32)
HASH, HASH2 = np.uint32(0x9E3779B1), np.uint32(0xC2B2AE35)
MANIFEST = "file int, path string, n_docs long, n_tokens long"


def squash(x: int) -> int:
    """Logistic function: x / 256 to a probability in 4096ths."""
    return min(4095, max(1, int(4096 / (1 + math.exp(-x / 256)))))


SQUASH = np.array([squash(x) for x in range(-2047, 2048)], np.int64)
STRETCH = np.array(
    [min(2047, max(-2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64
)
# An entry of a table of guesses is an id and, in its low byte, the trust in it: in bits 0-3 for order 1, in
# bits 4-7 for order 2. The case of a decision is the low byte of both with bit 8 set where the ids agree.
CASES = np.arange(512)
KIND = 2 * (CASES >> 4 & 15 > 0) + (CASES >> 8)  # an order-2 guess is there, guesses agree
PLACES = np.stack([KIND, 4 + 4 * (CASES & 15) + KIND, 68 + (CASES & 255)])  # of its odds, orders 0 to 2


class Model:
    """What the lanes have learned together: guesses with the trust in them, the odds that they hold,
    mixing weights, and how often each id came unguessed."""

    def __init__(self) -> None:
        self.one = np.zeros(1 << BITS, np.uint32)
        self.two = np.zeros(1 << SLOT_BITS, np.uint32)
        self.held = np.full(68 + 256, FEW, np.int64)  # of 2 * FEW decisions to begin with
        self.seen = np.full(68 + 256, 2 * FEW, np.int64)
        self.weights = np.full((3, 4), 1 << 15, np.int64)
        self.counts = np.zeros(1 << BITS, np.int64)
        self.missed: list[np.ndarray] = []  # since the counts were taken
        self.step = self.refresh = 0
        self.divide(np.full(1 << BITS, 1 << TOTAL_BITS - BITS))
        self.mix()

    def mix(self) -> None:
        """Probability that the guess holds in each case, in 65536ths."""
        odds = (self.held << 12) // self.seen
        self.stretched = STRETCH[odds[PLACES]]
        dot = (self.weights[:, KIND] * self.stretched).sum(0) >> 16
        self.mixed = np.clip(SQUASH[np.clip(dot, -2047, 2047) + 2047], SURE, 4096 - SURE)
        self.chance = (self.mixed << 4).astype(np.uint64)

    def look_up(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slots and entries of both orders, the guess and its case."""
        slots = ((first * HASH ^ second + np.uint32(1)) * HASH2) >> np.uint32(32 - SLOT_BITS)
        one, two = self.one.take(first), self.two.take(slots)
        case = ((one | two) & np.uint32(255)) + (((one ^ two) < 256).astype(np.uint32) << np.uint32(8))
        guess = np.where(two & np.uint32(240), two, one) >> np.uint32(8)
        return slots, one, two, guess, case

    def span(self, left: int) -> int:
        """Steps until the model learns again."""
        return min(SPAN, max(1, self.step), left)

    def learn(self, ids, first, slots, one, two, held, case) -> None:
        """Take in the ids of a span; of steps that share an entry the last one counts."""
        for table, at, entry, unit in ((self.one, first, one, np.uint32(1)), (self.two, slots, two, np.uint32(16))):
            for part in (slice(i, i + CHUNK) for i in range(0, len(ids), CHUNK)):
                old, own = entry[part], ids[part]
                trust = old & 15 * unit
                less = (trust >> np.uint32(1)) & 15 * unit
                wrong = np.where(trust > unit, old - less, own << np.uint32(8) | unit)
                right = old + unit * (trust < MOST_TRUST * unit)
                table[at[part]] = np.where(old >> np.uint32(8) == own, right, wrong)
        both = np.bincount(case << np.uint32(1) | held, minlength=1024).reshape(512, 2)
        seen, hit = both.sum(1), both[:, 1]
        error = ((hit << 12) - seen * self.mixed) * LEARNING
        total = np.maximum(_sums(KIND, seen, 4), 1)
        for weights, stretched in zip(self.weights, self.stretched):
            weights += (_sums(KIND, stretched * error, 4) // total + (1 << 15)) >> 16
        for places in PLACES:
            self.held += _sums(places, hit, len(self.held))
            self.seen += _sums(places, seen, len(self.seen))
        full = self.seen > MOST_SEEN
        self.held[full] = (self.held[full] >> 1) + 1
        self.seen[full] = (self.seen[full] >> 1) + 2
        self.mix()
        self.missed.append(ids[~held])

    def advance(self, steps: int) -> None:
        self.step += steps
        if self.step >= self.refresh:
            self.refresh = self.step + min(self.step, REFRESH)
            self.counts += np.bincount(np.concatenate(self.missed), minlength=1 << BITS)
            self.missed = []
            room = (1 << TOTAL_BITS) - (1 << BITS)
            self.divide(self.counts * room // max(1, int(self.counts.sum())) + 1)

    def divide(self, share: np.ndarray) -> None:
        """Give each id its share of the frequencies' total."""
        self.share, self.owners = share.astype(np.uint64), None
        self.begin = (np.cumsum(share) - share).astype(np.uint64)

    def owner(self) -> np.ndarray:
        """The id that each part of the total belongs to (the last one also has what is left)."""
        if self.owners is None:
            owners = np.repeat(np.arange(1 << BITS, dtype=np.uint16), self.share.astype(np.int64))
            self.owners = np.append(owners, np.full((1 << TOTAL_BITS) - len(owners), (1 << BITS) - 1, np.uint16))
        return self.owners


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def _steps(lengths: np.ndarray, model: Model) -> Iterator[tuple[int, int, int]]:
    """Spans of steps with the number of lanes (longest first) that take part."""
    t = 0
    while t < lengths[0]:
        k = int(np.searchsorted(-lengths, -t, "left"))
        steps = model.span(int(lengths[k - 1]) - t)
        yield t, steps, k
        model.advance(steps)
        t += steps


def pack(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Code blocks side by side: rows of ``ids``, of which the first ``lengths`` count; longest first."""
    lanes, model = len(ids), Model()
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, size = np.zeros((lanes, ids.shape[1] // 2 + 2 * SPAN), np.uint64), np.zeros(lanes, np.int64)
    past = np.zeros((ids.shape[1] + 2, lanes), np.uint32)  # by step, after two blank ones
    past[2:] = ids.T
    for t, steps, k in _steps(lengths, model):
        own, first = (past[t + i : t + i + steps, :k].reshape(-1) for i in (2, 1))
        slots, one, two, guess, case = model.look_up(first, past[t : t + steps, :k].reshape(-1))
        held = guess == own
        chance = model.chance.take(case).reshape(steps, k)
        start, share = (x.take(own).reshape(steps, k) for x in (model.begin, model.share))
        if size.max() + 2 * steps >= out.shape[1]:
            out = np.hstack([out, np.zeros_like(out)])
        a, w, filled, right = low[:k], width[:k], size[:k], held.reshape(steps, k)
        for i in range(steps):
            bound = (w >> np.uint64(16)) * chance[i]
            rest = w - bound
            part = rest >> np.uint64(TOTAL_BITS)
            moved = a + np.where(right[i], np.uint64(0), bound + part * start[i])
            over = np.flatnonzero(moved < a)
            if len(over):
                out[over, filled[over] - 1] += np.uint64(1)
            a[:] = moved
            w[:] = np.where(right[i], bound, part * share[i])
            narrow = np.flatnonzero(w < LEAST)
            taken = a[narrow]
            out[narrow, filled[narrow]] = taken >> WORD
            filled[narrow] += 1
            a[narrow] = taken << WORD
            w[narrow] <<= WORD
        model.learn(own, first, slots, one, two, held, case)
    if size.max() + 1 >= out.shape[1]:
        out = np.hstack([out, np.zeros_like(out)])
    last = low + (LEAST - np.uint64(1))  # one word of the final interval
    over = np.flatnonzero(last < low)
    out[over, size[over] - 1] += np.uint64(1)
    out[np.arange(lanes), size] = last >> WORD
    out = out[:, : size.max() + 1]
    while (over := out >> WORD).any():
        out &= LEAST - np.uint64(1)
        out[:, :-1] += over[:, 1:]
    words = out.astype("<u4")
    return [words[i, : n + 1].tobytes() for i, n in enumerate(size)]


def unpack(blocks: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Ids of coded blocks, one row each; longest first."""
    lanes, model = len(blocks), Model()
    words = np.zeros((lanes, max(len(b) + 3 >> 2 for b in blocks) + 2), np.uint64)
    for i, block in enumerate(blocks):
        words[i, : len(block) >> 2] = np.frombuffer(block[: len(block) & ~3], "<u4")
    code, width = words[:, 0] << WORD | words[:, 1], np.full(lanes, (1 << 64) - 1, np.uint64)
    at, last = np.arange(lanes) * words.shape[1] + 2, np.arange(1, lanes + 1) * words.shape[1] - 1
    words = words.reshape(-1)
    past = np.zeros((int(lengths[0]) + 2, lanes), np.uint32)
    for t, steps, k in _steps(lengths, model):
        c, w, taken = code[:k], width[:k], []
        owner = model.owner()
        for i in range(t, t + steps):
            slots, one, two, guess, case = model.look_up(past[i + 1, :k], past[i, :k])
            bound = (w >> np.uint64(16)) * model.chance.take(case)
            held = c < bound
            missed = np.flatnonzero(~held)
            if len(missed):
                edge = bound[missed]
                rest = c[missed] - edge
                part = (w[missed] - edge) >> np.uint64(TOTAL_BITS)
                found = owner.take((rest // part).astype(np.int64), mode="clip").astype(np.int64)
                c[missed] = rest - part * model.begin.take(found)
                bound[missed] = part * model.share.take(found)
                guess[missed] = found
            w[:] = bound
            narrow = np.flatnonzero(bound < LEAST)
            place = at[narrow]
            c[narrow] = c[narrow] << WORD | words.take(np.minimum(place, last[narrow]))
            at[narrow] = place + 1
            w[narrow] <<= WORD
            past[i + 2, :k] = guess
            taken.append((slots, one, two, held, case))
        own, first = (past[t + i : t + i + steps, :k].reshape(-1) for i in (2, 1))
        model.learn(own, first, *(np.concatenate(x) for x in zip(*taken)))
    return past[2:].T


# -- files ----------------------------------------------------------------------------------


def _lanes(blocks: int) -> int:
    """Blocks coded side by side: about ``LANES``, as even as can be, as a few cost as many steps."""
    return -(-blocks // max(1, round(blocks / LANES))) or 1


def write_group(documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A group of documents as bytes."""
    ids = np.concatenate([d for _, d in documents]).astype(np.uint32)
    if len(ids) and ids.max() >= 1 << BITS:
        raise ValueError("Ids above 65535 cannot be coded.")
    sizes = np.diff(np.append(np.arange(0, len(ids), BLOCK), len(ids)))
    coded: list[bytes] = []
    lanes = _lanes(len(sizes))
    for at in range(0, len(sizes), lanes):
        own = sizes[at : at + lanes]
        rows = np.zeros((len(own), int(own[0])), np.uint32)
        flat = ids[at * BLOCK : at * BLOCK + int(own.sum())]
        rows.reshape(-1)[: len(flat)] = flat
        coded += pack(rows, own)
    head = struct.pack("<II", len(documents), len(sizes))
    table = b"".join(struct.pack("<Bqq", d is not None, d or 0, len(x)) for d, x in documents)
    checks = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(len(sizes))]
    table += b"".join(struct.pack("<III", int(n), len(c), k) for n, c, k in zip(sizes, coded, checks))
    body = head + table + b"".join(coded)
    return struct.pack("<Q", len(body)) + body


def read_group(body: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a group; a block that does not match its checksum is an error."""
    n_docs, n_blocks = struct.unpack_from("<II", body)
    documents = [struct.unpack_from("<Bqq", body, 8 + 17 * i) for i in range(n_docs)]
    at = 8 + 17 * n_docs
    blocks = [struct.unpack_from("<III", body, at + 12 * i) for i in range(n_blocks)]
    at += 12 * n_blocks
    parts = []
    lanes = _lanes(n_blocks)
    for start in range(0, n_blocks, lanes):
        own = blocks[start : start + lanes]
        coded = []
        for _, size, _ in own:
            coded.append(body[at : at + size])
            at += size
        for row, (n, _, check) in zip(unpack(coded, np.array([n for n, *_ in own])), own):
            part = row[:n].astype("<u4")
            if zlib.crc32(part.tobytes()) != check:
                raise ValueError("A block of ids does not match its checksum.")
            parts.append(part)
    ids, at = np.concatenate(parts) if parts else np.zeros(0, "<u4"), 0
    for known, doc_id, n in documents:
        yield (doc_id if known else None), ids[at : at + n]
        at += n


# -- ids by the tokenizers library ------------------------------------------------------------

KEPT_BITS, KEPT_LENGTH, KEPT_IDS = 20, 23, 1 << 23  # slots of the table of pieces, bytes of a piece, all their ids
SLICES, JOINED = 4 << 20, 1 << 15  # bytes of text, and new pieces, taken at once
# Classes of characters. Between a character of one class and one of another there is a cut where no match
# of the pattern (``bpe.PRETOKENS``) can hold both; of OTHER nothing is known but that it is not blank.
BLANK, BREAK, LETTER, DIGIT, MARK, QUOTE, OTHER = (1 << i for i in range(7))
CUT_BEFORE = {
    BLANK: 0,
    BREAK: LETTER | DIGIT | MARK | QUOTE | OTHER,  # after a single one; what follows takes only a blank along
    LETTER: BLANK | BREAK | DIGIT | MARK | QUOTE,
    DIGIT: BLANK | BREAK | LETTER | MARK | QUOTE,
    MARK: BLANK | BREAK | LETTER | DIGIT,
    QUOTE: BLANK | BREAK | DIGIT,  # 's and the like are one match
    OTHER: BLANK | BREAK,
}
# Lead bytes of two whose characters are letters, all but C3 97 and C3 B7 (times and division signs).
LETTER_LEADS = bytes([0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1])
WIDE_BLANKS = [c.encode() for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{SPACE}]", c)]
EDGE = re.compile(rb"[!-~][\t-\r ]")


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 128:
        return LETTER if byte in LETTER_LEADS else OTHER
    if c == " " or "\t" <= c <= "\r":
        return BLANK if c == " " else BREAK
    return LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else MARK


CLASS = bytes(map(_class_of, range(256)))
CUTS = bytes(CUT_BEFORE[c] for c in CLASS)
MASKS = np.array(  # of the three numbers of a piece, by its length
    [[(1 << 8 * min(8, max(0, n - at))) - 1 for n in range(KEPT_LENGTH + 1)] for at in (0, 8, 16)], np.uint64
)
MIX = np.uint64(0x9E3779B97F4A7C15)
PURE = np.isin(np.arange(256), [c | b for c in (LETTER, DIGIT, MARK) for b in (0, BLANK)])
LETTERS = np.array(sorted((byte, ord(c)) for c, byte in byte_letters().items()), "<u2")[:, 1]


def cuts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8 text whether a match of the pattern surely begins there, and its class."""
    raw = np.frombuffer(data, np.uint8)
    own = np.frombuffer(bytearray(data.translate(CLASS)), np.uint8)
    cut = np.frombuffer(bytearray(data.translate(CUTS)), np.uint8)
    if not data.isascii():
        second = np.flatnonzero((raw >= 0xC3) & (own == LETTER)) + 1  # of two bytes
        own[second], cut[second] = LETTER, CUT_BEFORE[LETTER]
        sign = second[(raw[second - 1] == 0xC3) & ((raw[second] == 0x97) | (raw[second] == 0xB7))]
        for places in (sign - 1, sign):
            own[places], cut[places] = OTHER, CUT_BEFORE[OTHER]
        lead = np.flatnonzero((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3))
        code = raw[lead].astype(np.int64)
        for more in (1, 2):
            code = code << 8 | raw.take(lead + more, mode="clip")
            wide = lead[np.isin(code, [int.from_bytes(c) for c in WIDE_BLANKS if len(c) == more + 1])]
            for place in range(more + 1):
                own[wide + place], cut[wide + place] = BLANK, CUT_BEFORE[BLANK]
    out = np.zeros(len(raw), bool)
    np.not_equal(own[1:] & cut[:-1], 0, out=out[1:])
    out[2:] &= (own[1:-1] != BREAK) | (own[:-2] & (BLANK | BREAK) == 0)  # how several end depends on what follows
    return out, own


class Pieces:
    """Ids of pieces of text, by the tokenizers library, kept for the next texts.

    A piece that surely is one match of the pattern goes to the library's model in its letters for bytes,
    thousands at once; any other piece goes to the whole tokenizer. Short pieces are kept in a table in
    which a new piece takes the slot of an older one: a slot holds a piece as three numbers, the last of
    which has its length in the high byte, and where its ids are.
    """

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(file_text)
        model, before, added = data["model"], data.get("pre_tokenizer") or {}, data.get("added_tokens") or []
        self.special = [t["content"].encode() for t in added]
        # Other tokenizers get texts whole.
        self.known = (
            model["type"] == "BPE" and before.get("type") == "ByteLevel" and not data.get("normalizer")
            and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not model.get("dropout") and set(byte_letters()) <= set(model["vocab"])
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
            and not any(re.search(f"[{SPACE}]", t["content"]) for t in added)
        )
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.lengths = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)  # a letter a byte
        if self.known:
            ids = np.array(list(model["vocab"].values()))
            self.lengths = np.zeros(ids.max() + 1, np.int64)
            self.lengths[ids] = [len(t) for t in model["vocab"]]
        self.forget()

    def forget(self) -> None:
        self.keys = [np.zeros(1 << KEPT_BITS, np.uint64) for _ in range(3)]
        self.starts, self.sizes = np.zeros(1 << KEPT_BITS, np.int32), np.zeros(1 << KEPT_BITS, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of any pieces."""
        found = [self.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in pieces]
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32)

    def matches(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces of ``raw`` that are one match each."""
        ends = np.cumsum(sizes + 1)  # with a blank after each, which no letter for a byte is
        letters = np.full(ends[-1], ord(" "), "<u2")
        letters[_places(ends - sizes - 1, sizes)] = LETTERS[raw[_places(starts, sizes)]]
        text = letters.tobytes().decode("utf-16-le")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        places = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
        return np.diff(places, prepend=0), ids

    def part(self, data: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at ``begins`` of ``data``, and where those of each begin (and the last end)."""
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(begins) + 1, np.int64)
        if len(self.ids) > KEPT_IDS:
            self.forget()
        raw = np.frombuffer(data, np.uint8)
        cut, own = cuts(data) if self.known else (np.zeros(len(data), bool), np.full(len(data), OTHER, np.uint8))
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                own[at : at + len(token)] |= OTHER
                at = data.find(token, at + 1)
        cut[begins[begins < len(data)]] = True
        places = np.flatnonzero(cut)
        offsets = np.append(places, len(data)).astype(np.int32)
        lengths = np.diff(offsets)
        keys, slots = _keys(data, places, lengths)
        same = lengths <= KEPT_LENGTH
        for known, key in zip(self.keys, keys):
            same &= known[slots] == key
        starts, sizes = self.starts[slots], self.sizes[slots]
        if len(missed := np.flatnonzero(~same)):
            split = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            coded = split.take(pa.array(missed)).dictionary_encode()
            codes = coded.indices.to_numpy()
            new = np.zeros(len(coded.dictionary), np.int64)  # a piece of each
            new[codes] = missed
            single = PURE[np.bitwise_or.reduceat(own, places)[new]]
            first = places[new]
            single &= (own[first] != BLANK) | (lengths[new] > 1) & (own.take(first + 1, mode="clip") != BLANK)
            begins_at, counts = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
            single, rest = np.flatnonzero(single), np.flatnonzero(~single)
            for at in [*range(0, len(single), JOINED), *[-1] * bool(len(rest))]:
                some = rest if at < 0 else single[at : at + JOINED]
                if at < 0:
                    own_counts, ids = self.whole(coded.dictionary.take(pa.array(rest)).to_pylist())
                else:
                    own_counts, ids = self.matches(raw, first[some], lengths[new[some]].astype(np.int64))
                begins_at[some], counts[some] = len(self.ids) + np.cumsum(own_counts) - own_counts, own_counts
                self.ids = np.append(self.ids, ids)
            starts[missed], sizes[missed] = begins_at[codes], counts[codes]
            short = np.flatnonzero(lengths[new] <= KEPT_LENGTH)
            at = slots[new[short]]
            for known, key in zip(self.keys, keys):
                known[at] = key[new[short]]
            self.starts[at], self.sizes[at] = begins_at[short], counts[short]
        ids = self.ids[_places(starts, sizes)]
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        return ids, ends[np.append(np.searchsorted(places, begins), len(places))]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty. Texts are taken some ``SLICES`` bytes at a time."""
        column = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
        data = memoryview(column.buffers()[2] or b"")
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICES, "right")) - 1)
            text = bytes(data[offsets[at] : offsets[end]])
            if end > at + 1 or len(text) <= SLICES or not self.known:
                ids, bounds = self.part(text, offsets[at:end] - offsets[at])
                yield from (ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            else:
                yield np.concatenate([self.part(x, np.zeros(1, np.int64))[0] for x in _slices(text)])
            at = end


def _keys(data: bytes, places: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces of ``KEPT_LENGTH`` bytes at most as three numbers each, and their slots."""
    eights = np.ndarray(len(data) + 17, "<u8", data + bytes(24), strides=(1,))
    keys = [eights[places + 8 * i] & mask[np.minimum(lengths, KEPT_LENGTH)] for i, mask in enumerate(MASKS)]
    keys[2] |= lengths.astype(np.uint64) << np.uint64(56)
    mixed = ((keys[0] * MIX ^ keys[1]) * MIX ^ keys[2]) * MIX
    return keys, (mixed >> np.uint64(64 - KEPT_BITS)).astype(np.int64)


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text, cut before blanks."""
    start = 0
    while start < len(text):
        edge = EDGE.search(text, start + SLICES)
        end = edge.start() + 1 if edge else len(text)
        yield text[start:end]
        start = end


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the members of runs that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _library(file_text: str) -> Pieces:
    key = hashlib.sha256(file_text.encode()).hexdigest()
    loaded = kept_by("idcoder")
    if key not in loaded:
        loaded.clear()
        loaded[key] = Pieces(file_text)
    return loaded[key]


def write_ids(df: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of (doc_id, text) to files below ``path``; returns the manifest."""
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, out, waiting, held, docs, tokens = None, None, [], 0, 0, 0
        system, root = open_folder(path)
        name = f"ids-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            pieces = pieces or _library(shared.value)
            for doc_id, ids in zip(batch.column(0).to_pylist(), pieces.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                waiting.append((doc_id, ids))
                held, docs, tokens = held + len(ids), docs + 1, tokens + len(ids)
                if held >= BLOCK * LANES:
                    out = out or _open(system, root, name)
                    out.write(write_group(waiting))
                    waiting, held = [], 0
        if waiting:
            out = out or _open(system, root, name)
            out.write(write_group(waiting))
        if out:
            out.close()
            row = [[TaskContext.get().partitionId()], [f"{path}/{name}"], [docs], [tokens]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)], ["file", "path", "n_docs", "n_tokens"]
            )

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text")
    )
    return ordered.mapInArrow(run, MANIFEST)


def _open(system, root: str, name: str):
    system.create_dir(root, recursive=True)
    out = system.open_output_stream(f"{root}/{name}", compression=None)
    out.write(MAGIC)
    return out


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all files: ids as little-endian 32-bit numbers, and the number
    of ids before the document. The driver adds up the files' sizes, a row per file."""
    spark = manifest.sparkSession
    files = sorted((r["file"], r["path"], r["n_tokens"]) for r in manifest.collect())
    starts = np.cumsum([0, *(n for *_, n in files)]).tolist()
    rows = [(path, start) for (_, path, _), start in zip(files, starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = open_folder(path)
                with system.open_input_stream(name, compression=None) as file:
                    if file.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is not a file of token ids.")
                    while head := file.read(8):
                        found = list(read_group(file.read(struct.unpack("<Q", head)[0])))
                        sizes = [len(x) for _, x in found]
                        places = start + np.cumsum([0, *sizes[:-1]])
                        start += sum(sizes)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([d for d, _ in found], pa.int64()),
                                pa.array(places, pa.int64()),
                                pa.array([x.tobytes() for _, x in found], pa.binary()),
                            ],
                            ["doc_id", "start", "ids"],
                        )

    listed = spark.createDataFrame(rows, "path string, start long")
    if rows:
        listed = listed.repartition(len(rows), "path")
    return listed.mapInArrow(run, "doc_id long, start long, ids binary")
