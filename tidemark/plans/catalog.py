"""Every operator as a query over the given tables.

Each function takes ``(spark, folder)`` and returns a lazy DataFrame over whole
tables. Names and column names match ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import sql
from tidemark.config import parse_config
from tidemark.engine import Engine
from tidemark.functions import display as D
from tidemark.functions import identity as I
from tidemark.functions import paths as P
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import chunk as C
from tidemark.operators import embed as E
from tidemark.operators import extract as XT
from tidemark.operators import keyword_index as KI
from tidemark.operators import rerank as RR
from tidemark.operators import search as Q
from tidemark.operators import status as ST
from tidemark.operators import upsert as U
from tidemark.operators import vector_index as VI
from tidemark.operators.tables import IndexTables
from tidemark.session import work_dir
from tidemark.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Vector size of the hashing embedder in these queries.
HASH_SIZE = 64
# Fixed moments stand in for the clock, so that results can be compared.
FIRST_RUN = "2024-01-01 00:00:00"
SECOND_RUN = "2024-02-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows take real work each: spread over all cores if small."""
    return files.spread(table(spark, folder, name))


def document_path() -> Column:
    return F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def text_source(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table as plain text files."""
    docs = texts(spark, folder, "documents")
    return files.from_table(docs, document_path(), F.lit("txt"), F.col("text"))


def extracted(spark: SparkSession, folder: str) -> DataFrame:
    return XT.extract_plain(text_source(spark, folder))


def document_rows(spark: SparkSession, folder: str, moment: str = FIRST_RUN) -> DataFrame:
    now = F.lit(moment).cast("timestamp")
    return U.document_rows(extracted(spark, folder).drop("text"), now)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = extracted(spark, folder).select("document_id", "source_path", "text")
    return C.chunk_documents(docs)


def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return E.HashingEmbedder(HASH_SIZE).embed(chunks(spark, folder), "chunk_text")


def first_vector(points: DataFrame) -> list[float]:
    """The query of the single-vector searches: the vector with id 0."""
    return points.where(F.col("vec_id") == 0).select("embedding").first()[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder for stored results, where every executor can reach it."""
    shared = work_dir(spark, spark.conf.get("spark.sql.warehouse.dir"))
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def fresh_engine(spark: SparkSession) -> Engine:
    config = parse_config({"paths": {"data_dir": fresh(spark, "index")}})
    return Engine(spark, config, E.HashingEmbedder(HASH_SIZE))


# -- scans and sources --------------------------------------------------------


@query
def source_kind(spark, folder):
    suffix = F.create_map(
        *[F.lit(x) for x in ("en", ".TXT", "fr", ".md", "de", ".htm", "es", ".pdf")]
    )
    path = F.concat(
        F.lit("/corpus/"),
        F.col("doc_id").cast("string"),
        F.coalesce(F.element_at(suffix, F.col("lang")), F.lit(".csv")),
    )
    docs = table(spark, folder, "documents").select("doc_id", path.alias("path"))
    return docs.select("doc_id", P.source_kind(F.col("path"), strict=False).alias("source_kind"))


@query
def path_parts(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        P.file_name(url).alias("file_name"),
        P.file_suffix(url).alias("file_suffix"),
        P.mime_type(url).alias("mime_type"),
    )


@query
def scan_txt(spark, folder):
    return XT.raw_text(text_source(spark, folder)).select("source_path", "raw_text")


@query
def scan_md(spark, folder):
    """The documents read as Markdown: whole texts, whatever marks they hold."""
    docs = texts(spark, folder, "documents")
    source = files.from_table(docs, document_path(), F.lit("md"), F.col("text"))
    return XT.raw_text(source).select("source_path", "raw_text")


@query
def markdown_document(spark, folder):
    """A Markdown document built around each row: its whole text as paragraphs, once more as
    code (which the projection drops), and a table."""
    docs = texts(spark, folder, "documents")
    code = F.concat("text", F.lit("\n\n"), F.regexp_replace("text", r"(?m)^", "    "))
    markup = F.concat(
        F.lit("# Doc *"), "source", F.lit("*\n\n| id | lang |\n|----|------|\n| "),
        F.col("doc_id").cast("string"), F.lit(" | `"), "lang", F.lit("` |\n\n- first **"),
        F.col("n_chars").cast("string"), F.lit("**\n- [second](http://x.y)\n\n> quoted\n\n"),
        code, F.lit("\n\nLast\n----\n"),
    )
    source = files.from_table(docs, document_path(), F.lit("md"), markup)
    return XT.raw_text(source).select("source_path", "raw_text")


@query
def html_extract(spark, folder):
    pages = texts(spark, folder, "pages")
    path = F.concat(F.lit("page://"), F.col("page_id").cast("string"), F.lit(".html"))
    source = files.from_table(pages, path, F.lit("html"), F.col("html"))
    return XT.extract(source).select("source_path", "document_id", "text")


@query
def mixed_sources(spark, folder):
    """Text, Markdown and HTML in one scan, told apart row by row."""
    docs = texts(spark, folder, "documents")
    kind = F.when(F.col("lang") == "en", F.lit("txt")).when(F.col("lang") == "fr", F.lit("md"))
    markup = F.when(F.col("lang") == "en", F.col("text")).when(
        F.col("lang") == "fr", F.concat(F.lit("# "), "source", F.lit("\n\n"), "text")
    )
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<div><h2>"), "source", F.lit("</h2><p>"), escaped, F.lit("</p></div>"))
    source = files.from_table(
        docs, document_path(), F.coalesce(kind, F.lit("html")), F.coalesce(markup, html)
    )
    return XT.extract(source).select("source_path", "source_kind", "document_id")


@query
def linearize_md_tables(spark, folder):
    markup = F.concat(
        F.lit("Before\n\n| Id | **Lang** | [Src](u) |\n|:---|------|---|\n| "),
        F.col("doc_id").cast("string"), F.lit(" | `"), "lang", F.lit("` | "), "source",
        F.lit(" | extra |\n| x | y |\n\n"), "text",
    )
    docs = texts(spark, folder, "documents")
    return docs.select("doc_id", X.linearize_markdown_tables(markup).alias("text"))


@query
def linearize_html_tables(spark, folder):
    """Tables inside list items, where their text survives the projection; one cell holds the
    whole text."""
    docs = texts(spark, folder, "documents")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = [F.col("doc_id").cast("string"), F.col("lang"), F.col("source")]
    markup = F.concat(
        F.lit("<ul><li><table><tr><th>Id</th><th>Lang</th><th>Src</th></tr><tr><td>"),
        cell[0], F.lit("</td><td>"), cell[1], F.lit("</td><td> "), cell[2],
        F.lit(" </td><td>"), escaped,
        F.lit("</td></tr></table></li><li><table><tr><td>k</td><td>v</td></tr><tr><td>"),
        cell[1], F.lit("</td><td>"), cell[2], F.lit("</td></tr></table></li></ul>"),
    )
    source = files.from_table(docs, document_path(), F.lit("html"), markup)
    return XT.raw_text(source).select("source_path", "raw_text")


# The compatibility characters of "aeiounrst" and of the blank.
WIDE_LETTERS = "".join(chr(0xFF41 + ord(c) - ord("a")) for c in "aeiounrst") + "\xa0"

# -- text functions -------------------------------------------------------------


def _documents_with(spark, folder, **columns: Column) -> DataFrame:
    docs = texts(spark, folder, "documents")
    return docs.select("doc_id", *[c.alias(name) for name, c in columns.items()])


@query
def normalize_nfkc(spark, folder):
    """Each text, and the text again with full-width letters and no-break blanks."""
    wide = F.translate("text", "aeiounrst ", WIDE_LETTERS)
    return _documents_with(spark, folder, text=X.nfkc(F.concat("text", F.lit("|"), wide)))


@query
def normalize_text(spark, folder):
    return _documents_with(spark, folder, text=X.normalize_text(F.col("text")))


@query
def sentence_spacing(spark, folder):
    return _documents_with(spark, folder, text=X.final_text(F.col("text")))


@query
def strip_md_inline(spark, folder):
    marked = F.concat(
        F.lit("`"), "lang", F.lit("` ***"), "source", F.lit("*** ["),
        F.col("doc_id").cast("string"), F.lit("](http://x.y/z) "), "text",
    )
    return _documents_with(spark, folder, text=X.strip_markdown_inline(marked))


@query
def split_sections(spark, folder):
    docs = texts(spark, folder, "documents")
    headed = F.concat("source", F.lit("\n### "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return docs.select("doc_id", F.posexplode(X.split_sections(headed)).alias("pos", "section"))


# -- identity and statistics ------------------------------------------------------


@query
def content_hash(spark, folder):
    return extracted(spark, folder).select(
        "source_path", F.col("metadata.content_hash").alias("content_hash")
    )


@query
def document_id(spark, folder):
    return extracted(spark, folder).select("source_path", "document_id")


@query
def chunk_id(spark, folder):
    return chunks(spark, folder).select("source_path", "chunk_index", "chunk_id")


@query
def point_id(spark, folder):
    return chunks(spark, folder).select("source_path", "chunk_index", "point_id")


@query
def document_stats(spark, folder):
    meta = F.col("metadata")
    names = ("byte_size", "char_count", "line_count")
    return extracted(spark, folder).select("source_path", *[meta[n].alias(n) for n in names])


@query
def metadata_json(spark, folder):
    """Metadata through its JSON form and back."""
    text = F.to_json("metadata")
    names = (
        "byte_size", "char_count", "content_hash", "file_name", "file_suffix", "line_count",
        "mime_type",
    )
    return extracted(spark, folder).select(
        "source_path", *[F.get_json_object(text, f"$.{n}").alias(n) for n in names]
    )


@query
def human_size(spark, folder):
    return _documents_with(spark, folder, size=D.human_size(F.octet_length("text") * F.col("doc_id")))


def stored_documents(spark: SparkSession, folder: str) -> IndexTables:
    """A fresh index that holds the documents' rows (no chunks)."""
    root = fresh(spark, "index")
    tables = IndexTables(spark, f"{root}/meta", f"{root}/vectors")
    tables.migrate()
    tables.upsert_documents(document_rows(spark, folder))
    return tables


@query
def storage_usage(spark, folder):
    """Bytes of all documents, summed from the stored index; no text is read."""
    total = F.sum("byte_size")
    return stored_documents(spark, folder).documents().agg(
        total.alias("total_bytes"), D.human_size(total).alias("total_size")
    )


# -- pipeline -----------------------------------------------------------------------


@query
def ingest_documents(spark, folder):
    meta = F.col("metadata")
    names = ("content_hash", "byte_size", "char_count", "line_count", "file_name", "mime_type")
    return extracted(spark, folder).select(
        "document_id", "source_path", "source_kind", *[meta[n].alias(n) for n in names]
    )


@query
def document_lookup(spark, folder):
    """The document with the smallest id, found again by that id in the stored index: one
    partition is listed, and of its rows the id is pushed down to the row groups."""
    tables = stored_documents(spark, folder)
    wanted = tables.documents().agg(F.min("document_id").alias("id")).first().id
    found = tables.find_document(wanted) if wanted else tables.documents()
    return found.select("document_id", "source_path", "source_kind", "char_count")


@query
def chunk_documents(spark, folder):
    return chunks(spark, folder).select("source_path", "chunk_index", "chunk_text")


@query
def sql_functions(spark, folder):
    """The chunks once more, by SQL text that calls the registered functions."""
    sql.register(spark, "tidemark_")
    docs = texts(spark, folder, "documents").withColumn("source_path", document_path())
    return spark.sql(
        """
        SELECT d.source_path, c.chunk_index, c.chunk_text
        FROM (SELECT source_path, tidemark_final_text(text) AS final FROM {docs}) d,
          LATERAL tidemark_split_chunks(d.final) c""",
        docs=docs,
    )


@query
def chunk_stats(spark, folder):
    return C.chunk_stats(chunks(spark, folder))


@query
def embed_chunks(spark, folder):
    """Non-zero dimensions of every chunk's embedding."""
    # The outer form: for the inner one Spark adds a filter on the array below the
    # generator, and the embedding would be computed once more for that filter.
    rows = embedded_chunks(spark, folder).select(
        "chunk_id", F.posexplode_outer("embedding").alias("dim", "value")
    )
    value = F.col("value").cast("double")
    return rows.where(value != 0).select("chunk_id", "dim", F.round(value, 5).alias("value"))


@query
def index_status(spark, folder):
    """Counts of a stored index of all documents and their chunks."""
    engine = fresh_engine(spark)
    engine.initialize()
    engine.ingest_frame(text_source(spark, folder))
    return engine.tables.status()


@query
def index_catalog(spark, folder):
    """What the stored index consists of: documents, rows and buckets a table, after all documents
    were stored, the labelled ones stored again, and everything compacted."""
    tables = stored_documents(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id")
    docs = texts(spark, folder, "documents").join(labels, "doc_id", "left_semi")
    again = files.from_table(docs, document_path(), F.lit("md"), F.col("text"))
    now = F.lit(SECOND_RUN).cast("timestamp")
    tables.upsert_documents(U.document_rows(XT.extract_plain(again).drop("text"), now))
    tables.compact(everything=True)
    return tables.catalog().where(F.col("layers") > 0).select("name", "layers", "row_count", "bucket_count")


# -- keyed changes ------------------------------------------------------------------------


def _second_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled documents again, now as Markdown, and every conversation turn."""
    labelled = table(spark, folder, "labels").select("doc_id")
    docs = texts(spark, folder, "documents").join(labelled, "doc_id", "left_semi")
    again = files.from_table(docs, document_path(), F.lit("md"), F.col("text"))
    turns = texts(spark, folder, "conversations")
    path = F.concat_ws("/", F.lit("conv:/"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    new = files.from_table(turns, path, F.lit("txt"), F.col("text"))
    now = F.lit(SECOND_RUN).cast("timestamp")
    return U.document_rows(XT.extract_plain(again.unionByName(new)).drop("text"), now)


@query
def upsert_documents(spark, folder):
    after = U.upsert_documents(document_rows(spark, folder), _second_batch(spark, folder))
    return after.select(
        "document_id", "source_path", "source_kind", "byte_size", "char_count", "line_count",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


def _labelled(spark: SparkSession, folder: str, toxic_only: bool = False) -> DataFrame:
    labels = table(spark, folder, "labels")
    if toxic_only:
        labels = labels.where(F.col("toxic") == 1)
    docs = texts(spark, folder, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    source = files.from_table(docs, document_path(), F.lit("txt"), F.col("text"))
    return XT.extract_plain(source)


@query
def replace_chunks(spark, folder):
    """Labelled documents go back to one chunk each, holding the whole text."""
    current = chunks(spark, folder).select("document_id", "chunk_index", "chunk_text")
    labelled = _labelled(spark, folder)
    whole = labelled.select(
        "document_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text")
    )
    return U.replace_chunks(current, whole, labelled.select("document_id"))


@query
def delete_document(spark, folder):
    current = chunks(spark, folder).select("document_id", "chunk_index", "chunk_id")
    return U.delete_by_document(current, _labelled(spark, folder, toxic_only=True))


@query
def stored_index(spark, folder):
    """The whole ingest on stored tables, in a fresh index in the shared folder:
    all documents, the labelled ones again as Markdown, toxic ones without chunks."""
    engine = fresh_engine(spark)
    engine.initialize()
    engine.ingest_frame(text_source(spark, folder))
    docs = texts(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id")
    labelled = docs.join(labels, "doc_id", "left_semi")
    engine.ingest_frame(files.from_table(labelled, document_path(), F.lit("md"), F.col("text")))
    engine.tables.delete_chunks(_labelled(spark, folder, toxic_only=True).select("document_id"))
    counts = engine.tables.chunks().groupBy("document_id").agg(F.count("*").alias("n"))
    return (
        engine.tables.documents()
        .join(counts, "document_id", "left")
        .select("document_id", "source_kind", F.coalesce("n", F.lit(0)).alias("n_chunks"))
    )


# -- vectors ----------------------------------------------------------------------------------


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


@query
def semantic_search_topk(spark, folder):
    points = embeddings(spark, folder)
    best = Q.top_k(points, first_vector(points), key="vec_id")
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def batch_search_topk(spark, folder):
    """Every vector as a query against the whole table."""
    points = embeddings(spark, folder).select("vec_id", "embedding")
    best = Q.top_k_many(points, points.withColumnRenamed("vec_id", "query_id"))
    return best.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, folder: str) -> VI.VectorIndex:
    return VI.build(embeddings(spark, folder), fresh(spark, "vector-index"))


def every_hundredth(spark: SparkSession, folder: str) -> DataFrame:
    """The queries of the batch searches on the index."""
    asked = embeddings(spark, folder).where(F.col("vec_id") % 100 == 0)
    return asked.select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_index_topk(spark, folder):
    """The search for vector 0 on the stored index, proved complete by the cells' bounds."""
    best = vector_index(spark, folder).search(first_vector(embeddings(spark, folder)))
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def vector_index_batch(spark, folder):
    """The exact best five of all rows for every hundredth vector, on the stored index."""
    best = vector_index(spark, folder).search_many(every_hundredth(spark, folder))
    return best.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def vector_index_probe(spark, folder):
    """The same by probing, with as many cells as the calibration asks for, and which of the hits
    are among the exact ones."""
    index, asked = vector_index(spark, folder), every_hundredth(spark, folder)
    index.calibrate()
    found = index.search_many(asked, exact=False)
    true = index.search_many(asked).select("query_id", "vec_id", F.lit(True).alias("exact"))
    both = found.join(true, ["query_id", "vec_id"], "left")
    return both.select("query_id", "rank", "vec_id", F.coalesce("exact", F.lit(False)).alias("exact"))


@query
def filtered_search(spark, folder):
    """The ten vectors closest to vector 0 among those with an even label."""
    index, points = vector_index(spark, folder), embeddings(spark, folder)
    best = index.search(first_vector(points), 10, where=F.col("label") % 2 == 0)
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def paged_search(spark, folder):
    """Three pages of ten, each continued from the last hit of the one before."""
    index, vector = vector_index(spark, folder), first_vector(embeddings(spark, folder))
    rows, after = [], None
    for number in (1, 2, 3):
        page = index.search(vector, 10, after=after).collect()
        rows += [(number, r.vec_id, r.score) for r in page]
        after = (page[-1].score, page[-1].vec_id) if page else after
    found = spark.createDataFrame(rows, "page int, vec_id long, score double")
    return found.select("page", "vec_id", F.round("score", 6).alias("score"))


@query
def cosine_pairs(spark, folder):
    """Similarity of every vector with vector 0, by built-in functions alone."""
    points = embeddings(spark, folder)
    score = V.cosine(F.col("embedding"), F.lit(first_vector(points)))
    return points.select("vec_id", F.round(score, 6).alias("score"))


@query
def score_bands(spark, folder):
    points = embeddings(spark, folder)
    scored = Q.with_score(points, first_vector(points))
    return scored.select(
        "vec_id",
        F.format_string("%.4f", F.bround("score", 4)).alias("shown"),
        D.score_band(F.col("score")).alias("band"),
    )


@query
def l2_normalize(spark, folder):
    unit = V.l2_normalize(F.col("embedding"))
    rows = embeddings(spark, folder).select("vec_id", F.posexplode(unit).alias("pos", "value"))
    return rows.select("vec_id", "pos", F.round("value", 6).alias("value"))


@query
def dimension_guard(spark, folder):
    checked = U.check_dimension(embeddings(spark, folder), 64)
    return ST.dimension_counts(checked)


def benchmark_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def closest_documents(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each benchmark text against all documents by cosine."""
    embedder = E.HashingEmbedder(HASH_SIZE)
    queries = embedder.embed(benchmark_items(spark, folder), "text").select("query_id", "embedding")
    docs = texts(spark, folder, "documents")
    source = docs.select(F.col("doc_id").alias("vec_id"), X.final_text(F.col("text")).alias("text"))
    points = embedder.embed(source, "text").select("vec_id", "embedding")
    return Q.top_k_many(points, queries, k)


def keyword_index(spark: SparkSession, folder: str) -> KI.KeywordIndex:
    docs = texts(spark, folder, "documents").select("doc_id", "text")
    return KI.build(docs, fresh(spark, "keyword-index"), "doc_id")


@query
def text_search(spark, folder):
    """Each benchmark text as a search over all documents, best five each."""
    best = closest_documents(spark, folder, Q.DEFAULT_TOP_K)
    return best.select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


@query
def keyword_search(spark, folder):
    """Each benchmark text as a keyword search over the stored index, best ten each."""
    best = keyword_index(spark, folder).search_many(benchmark_items(spark, folder))
    return best.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def hybrid_search(spark, folder):
    """The best fifty by keywords and the best fifty by vectors, fused by rank, best ten each."""
    by_words = keyword_index(spark, folder).search_many(benchmark_items(spark, folder), 50)
    by_vector = closest_documents(spark, folder, 50).withColumnRenamed("vec_id", "id")
    best = KI.fuse([by_words, by_vector])
    return best.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query
def diverse_search(spark, folder):
    """Twenty candidates for every hundredth vector, re-ranked to five that differ."""
    points = embeddings(spark, folder).select("vec_id", "embedding")
    found = Q.top_k_many(points, every_hundredth(spark, folder), 20)
    candidates = found.join(points, "vec_id").select("query_id", F.col("vec_id").alias("id"), "score", "embedding")
    best = RR.diversify(candidates)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))
