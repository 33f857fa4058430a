"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A three-letter
sequence is bound into one vector (the letters' vectors, rotated by place and multiplied); a
text is the bundle (sum) of its sequences, a language the bundle of its learning texts. A text
gets the language whose prototype has the largest cosine with it.

Learning emits one sum per task and language, added up by Spark; sums of whole numbers, so
neither the order of rows nor a lost task changes them. Only the prototypes (languages x
``DIMENSIONS`` numbers) reach the driver.

Defined cases: a null text and one without a letter are ``und`` with score 0, as is every text
if nothing could be learned; rows with a null language teach nothing; of equal cosines the
first language by name wins; long texts are read whole, ``SLICE`` characters at a time; rows
are judged one by one, and all input columns stay (clashing ``lang_pred`` and ``score`` are
replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import kept_by, ship

DIMENSIONS = 1024
SLICE = 1 << 20
ROWS, GRAMS = 256, 4096
UNKNOWN = "und"
BLANK = 32
MAX_LANGUAGES = 10_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for anything else."""
    out = np.full(0x110000, BLANK, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            out[code] = ord(char.lower()[0])
    return out


@lru_cache(4096)
def letter_vector(code: int) -> np.ndarray:
    draw = np.random.Generator(np.random.Philox(key=code))
    return (draw.integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)


def sequences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-letter sequences of a whole text (as numbers) and their counts."""
    table, found, before = _letters(), [], np.array([BLANK])
    for at in range(0, len(text), SLICE):
        raw = text[at : at + SLICE].encode("utf-32-le", "surrogatepass")
        codes = np.concatenate([before, table[np.frombuffer(raw, np.uint32)]])
        keep = codes != BLANK
        keep[1:] |= codes[:-1] != BLANK
        keep[0] = True
        codes = codes[keep]
        if at + SLICE >= len(text) and codes[-1] != BLANK:
            codes = np.append(codes, BLANK)
        found.append(np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True))
        before = codes[-2:]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else merge(found)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def bind(grams: np.ndarray) -> np.ndarray:
    """One row per sequence: its three letters' vectors, rotated by place and multiplied."""
    places = [grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]
    codes, at = np.unique(np.concatenate(places), return_inverse=True)
    vectors = np.stack([letter_vector(int(c)) for c in codes])
    first, second, third = np.split(at.reshape(-1), 3)
    out = np.roll(vectors, 2, 1)[first]
    out *= np.roll(vectors, 1, 1)[second]
    out *= vectors[third]
    return out


def bundle(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row per text: the sum of its sequences' vectors."""
    if not sum(len(k) for k, _ in texts):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    grams, at = np.unique(np.concatenate([k for k, _ in texts]), return_inverse=True)
    rows = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])
    numbers, out = np.concatenate([n for _, n in texts]), np.zeros((len(texts), DIMENSIONS), np.float32)
    for start in range(0, len(grams), GRAMS):
        here = (at >= start) & (at < start + GRAMS)
        part = grams[start : start + GRAMS]
        counts = np.zeros((len(texts), len(part)), np.float32)
        counts[rows[here], at[here] - start] = numbers[here]
        out += counts @ bind(part).astype(np.float32)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, the sum of all its texts' vectors."""
    kept_by("language")
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            texts: dict[str, list] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                texts.setdefault(lang, []).append(sequences(text))
            for lang, found in texts.items():
                grams, counts = merge(found)
                own = total.setdefault(lang, np.zeros(DIMENSIONS))
                for k in range(0, len(grams), GRAMS):
                    own += counts[k : k + GRAMS].astype(float) @ bind(grams[k : k + GRAMS])
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
        ["lang", "vector"],
    )


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of each language in (text, lang)."""
    ship(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = (
        rows.mapInArrow(_sums, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("vector"))
        .take(MAX_LANGUAGES + 1)
    )
    if len(sums) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages to learn.")
    out = {r["lang"]: np.asarray(r["vector"]) for r in sums}
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine with that language (0 at least)."""
    ship(df.sparkSession)
    names = list(prototypes)
    matrix = np.array(list(prototypes.values()), np.float32).reshape(len(names), DIMENSIONS)

    @F.arrow_udf("lang_pred string, score double")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept_by("language")
        for batch in batches:
            picked, scores = [], []
            for start in range(0, len(batch), ROWS):
                texts = [sequences(t or "") for t in batch.slice(start, ROWS).to_pylist()]
                vectors = bundle(texts)
                length = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ matrix.T / np.where(length > 0, length, 1)[:, None]
                known = [bool(names) and len(k) > 0 for k, _ in texts]
                best = cosines.argmax(1) if names else [0] * len(texts)
                picked += [names[b] if k else UNKNOWN for b, k in zip(best, known)]
                top = np.clip(cosines.max(1, initial=0.0), 0.0, 1.0).astype(float)
                scores += np.where(known, top, 0.0).tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(picked, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    rest = [c for c in df.columns if c not in ("lang_pred", "score", "_label")]
    return df.select(*(F.col(f"`{c}`") for c in rest), label(F.col(text)).alias("_label")).select(
        *(F.col(f"`{c}`") for c in rest), "_label.lang_pred", "_label.score"
    )


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def learn_from(documents: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from (doc_id, text, lang), without the fold that is held out."""
    return learn(documents.where(remainder(F.col("doc_id"), 4) != 2))
