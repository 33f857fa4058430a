"""Embedding models over a text column.

An embedder adds an ``embedding array<float>`` column of fixed size and unit
length next to a text column. A text that cannot be embedded becomes NULL; it
never fails the job (``failed_documents`` finds the documents to leave out).
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import unit_rows


class WrongVectorSize(ValueError):
    """A model gives vectors of another size than it was configured with."""


EncodeTexts = Callable[[list[str]], Sequence[Sequence[float]]]


def _to_arrow(matrix: np.ndarray, missing: pa.Array) -> pa.Array:
    rows, size = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * size)
    return pa.ListArray.from_arrays(offsets, values, mask=missing)


# Bytes of text whose words are cut at once; a longer text is alone.
SLAB_BYTES = 6 << 20


def slabs(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """An array of texts in runs of at most ``most`` bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, to - at)
        at = to


class HashingEmbedder:
    """Signed feature hashing of words (Weinberger et al., 2009).

    Works on runs of rows of bounded size, so that memory does not follow the
    Arrow batch: words are cut and dictionary-encoded by Arrow, each distinct
    word of a run is hashed once, and the run is scattered into its matrix.
    """

    def __init__(self, vector_size: int = 256):
        self.vector_size = vector_size

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        size = self.vector_size

        def encode(texts: pa.Array) -> pa.Array:
            filled = pc.utf8_lower(texts.fill_null(""))
            words = pc.split_pattern_regex(filled, pattern=r"[^\p{L}\p{N}]+")
            rows = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
            encoded = words.flatten().dictionary_encode()
            vocabulary = encoded.dictionary.to_pylist()
            hashes = np.array([_word_hash(w) for w in vocabulary], dtype=np.int64)
            sign = np.where(hashes & 1, 1.0, -1.0)
            # Cutting leaves an empty word at either end of a text.
            sign[[i for i, w in enumerate(vocabulary) if not w]] = 0.0
            word = encoded.indices.to_numpy()
            # The lowest bit is the sign, the rest picks the dimension.
            slot = rows * size + ((hashes >> 1) % size)[word]
            sums = np.bincount(slot, weights=sign[word], minlength=len(texts) * size)
            return _to_arrow(unit_rows(sums.reshape(len(texts), size)), texts.is_null())

        @F.arrow_udf("array<float>")
        def hashed(texts: pa.Array) -> pa.Array:
            parts = [encode(part) for part in slabs(texts, SLAB_BYTES)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

        return df.withColumn("embedding", hashed(F.col(text)))


def _word_hash(word: str) -> int:
    """28 bits of MD5: the same on every machine and in any SQL engine."""
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16)


def micro_batches(lengths: Sequence[int], most: int, most_padded: int) -> Iterator[list[int]]:
    """Places of texts in groups of like length, shortest first: at most ``most`` of them, and at
    most ``most_padded`` characters once all are padded to the longest (a longer text is alone)."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    group: list[int] = []
    for i in order:
        if group and (len(group) == most or (len(group) + 1) * lengths[i] > most_padded):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


class ModelEmbedder:
    """A Python model, loaded once per worker on first use.

    ``load`` returns a function ``list of texts -> list of vectors``. Texts of an Arrow batch are
    handed over in groups of like length, so that little is spent on padding, and put back in
    their order. With a ``profile`` (a Spark resource profile, such as one GPU a task) the stage
    that embeds runs on executors that have these resources.
    """

    def __init__(
        self, load: Callable[[], EncodeTexts], vector_size: int, batch_size: int = 64,
        padded_chars: int = 1 << 20, profile: ResourceProfile | None = None,
    ):
        self.load = load
        self.vector_size = vector_size
        self.batch_size = batch_size
        self.padded_chars = padded_chars
        self.profile = profile

    def _encoder(self) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
        load, size, batch_size, padded = self.load, self.vector_size, self.batch_size, self.padded_chars

        def encode_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = load()
            kind = pa.list_(pa.float32())

            def vectors(texts: list[str]) -> list:
                matrix = np.asarray(encode(texts), dtype=np.float64).reshape(len(texts), -1)
                if matrix.shape[1] != size:
                    raise WrongVectorSize(f"model produced {matrix.shape[1]} dimensions, not {size}")
                return list(unit_rows(matrix).astype(np.float32))

            def tolerant(texts: list[str]) -> list:
                try:
                    return vectors(texts)
                except WrongVectorSize:
                    raise
                except Exception:
                    if len(texts) == 1:
                        logging.getLogger(__name__).exception("embedding_failed")
                        return [None]
                    return [v for t in texts for v in tolerant([t])]

            for batch in batches:
                texts = batch.to_pylist()
                found: list = [None] * len(texts)
                present = [i for i, t in enumerate(texts) if t is not None]
                for group in micro_batches([len(texts[i]) for i in present], batch_size, padded):
                    part = [present[g] for g in group]
                    for i, v in zip(part, tolerant([texts[i] for i in part])):
                        found[i] = v
                yield pa.array(found, kind)

        return encode_all

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        encode_all = self._encoder()
        if self.profile is None:
            return df.withColumn("embedding", F.arrow_udf(encode_all, "array<float>")(F.col(text)))
        kept = [c for c in df.columns if c != "embedding"]
        place = kept.index(text)

        def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[pa.RecordBatch] = []

            def texts() -> Iterator[pa.Array]:
                for batch in batches:
                    waiting.append(batch)
                    yield batch.column(place)

            for vectors in encode_all(texts()):
                batch = waiting.pop(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, "embedding"])

        rows = df.select(*kept)
        schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return rows.mapInArrow(attach, schema, profile=self.profile)


def load_sentence_transformer(name: str, cache_dir: str, batch_size: int) -> EncodeTexts:
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError:
        raise RuntimeError("sentence-transformers not installed") from None
    try:
        model = SentenceTransformer(name, cache_folder=f"{cache_dir}/hub", local_files_only=True)
    except OSError:
        raise RuntimeError(
            f"Model '{name}' not found in local cache. Run 'models bootstrap' to download it."
        ) from None
    return lambda texts: model.encode(
        texts, batch_size=batch_size, normalize_embeddings=True, show_progress_bar=False
    )


def load_mlx(name: str, batch_size: int, max_tokens: int = 512) -> EncodeTexts:
    try:
        from mlx_embeddings import load
    except ImportError:
        raise RuntimeError("mlx-embeddings not installed") from None
    model, processor = load(name)

    def encode(texts: list[str]):
        tokens = processor._tokenizer(
            texts, return_tensors="mlx", padding=True, truncation=True, max_length=max_tokens
        )
        return model(**tokens).text_embeds.tolist()

    return encode


def _hashing(config) -> HashingEmbedder:
    return HashingEmbedder(config.model.vector_size)


def _sentence_transformers(config) -> ModelEmbedder:
    name, cache, size = config.model.name, str(config.model.cache_dir), config.runtime.max_batch_size
    return ModelEmbedder(
        lambda: load_sentence_transformer(name, cache, size), config.model.vector_size, size
    )


def _mlx(config) -> ModelEmbedder:
    name, size = config.model.name, config.runtime.max_batch_size
    return ModelEmbedder(lambda: load_mlx(name, size), config.model.vector_size, size)


_BACKENDS: dict[str, Callable] = {
    "hashing": _hashing,
    "mlx": _mlx,
    "sentence_transformers": _sentence_transformers,
}


def register_backend(name: str, factory: Callable) -> None:
    """Make ``factory(config) -> embedder`` available as a backend."""
    _BACKENDS[name] = factory


def backends() -> tuple[str, ...]:
    return tuple(sorted(_BACKENDS))


def create_embedder(config):
    factory = _BACKENDS.get(config.model.backend)
    if factory is None:
        raise ValueError(f"Unknown embedding backend: {config.model.backend}")
    return factory(config)


def failed_documents(embedded: DataFrame) -> DataFrame:
    """Documents with at least one chunk that could not be embedded."""
    return embedded.where(F.col("embedding").isNull()).select("document_id").distinct()
