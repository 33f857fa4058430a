"""The operators as queries over whole tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import (
    balltree, bpe, flatgraph, idcoder, language, latent, licences, minmax, pitman_yor, shards, warc, whitening,
)
from tidemark.llm import quality as quality_rules
from tidemark.llm.staging import Stage, table

QUERIES = {}
SHINGLE_WORDS = 4


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@query
def op2_quality(spark, folder):
    """Every document's counts and whether the threshold table keeps it."""
    judged = quality_rules.judge(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op4_language(spark, folder):
    """The language of every document, learned from three folds of four."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.learn_from(docs))
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_minmax(spark, folder):
    """Near-duplicate components of all documents."""
    return minmax.near_duplicates(documents(spark, folder), SHINGLE_WORDS)


def token_digests(codec, docs):
    """Count and digest of each text's ids, and digest of what they decode to."""
    both = codec.round_trip(docs.select("doc_id", "text"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_bpe(spark, folder):
    """Every document encoded and decoded again."""
    return token_digests(bpe.Codec(spark, tokenizer_path()), documents(spark, folder))


@query
def op1_latent(spark, folder):
    """Benchmark passages found in documents, one row per document and item."""
    return latent.contaminated(documents(spark, folder), table(spark, folder, "benchmark"))


@query
def op10_licences(spark, folder):
    """Licence sentences and licences of every document."""
    return licences.scan(documents(spark, folder)).select("doc_id", "sentences", "licences")


@query
def op9_shards(spark, folder):
    """All documents written to shards of 64 MiB of text at most, as read back."""
    docs = table(spark, folder, "documents")
    path = Stage(spark, "shard-files").path("documents")
    return shards.write_shards(docs, path).select("doc_id", "n_bytes", "shard", "depth")


@query
def op6_warc(spark, folder):
    """All pages written as WARC records and read back."""
    records = warc.archive(table(spark, folder, "pages"))
    content = F.when(F.col("record_type") == "response", F.sha2("payload", 256))
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        "page_id",
        "payload_bytes",
        F.coalesce(content, "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query
def op3_pitman_yor(spark, folder):
    """Every document's log10 probability, learned from six folds of seven."""
    return pitman_yor.score(documents(spark, folder))


@query
def op5_idcoder(spark, folder):
    """Every document's token ids written to packed files and read back."""
    path = Stage(spark, "ids").path("files")
    written = idcoder.write_ids(documents(spark, folder), path, tokenizer_path())
    ids = idcoder.read_ids(written)
    return ids.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op11_whitening(spark, folder):
    """Every vector on the sixteen leading components of the whitened table."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_balltree(spark, folder):
    """The ten best documents for every benchmark item."""
    return balltree.ranked(documents(spark, folder), table(spark, folder, "benchmark"))


@query
def op12_flatgraph(spark, folder):
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return flatgraph.near_duplicates(table(spark, folder, "embeddings"))
