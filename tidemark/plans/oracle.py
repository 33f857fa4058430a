"""The same results in SQL for DuckDB, written independently of the Spark plans.

The chunk SQL follows the splitter as a chain of windows over word offsets; it
assumes what holds for the given texts: no word reaches 300 characters, and the
only white space is the space and the line feed.
"""

from __future__ import annotations

def _final_text(source: str, carried: str, p: str = "") -> str:
    """CTEs from ``source(carried..., text)`` to ``f(carried..., raw, t, text)``:
    ``t`` is normalised, ``text`` has its sentence spacing too."""
    return rf"""
{p}l AS (
  SELECT {carried}, text AS raw,
    list_filter(list_transform(
        string_split(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), chr(10)),
        lambda x: trim(regexp_replace(x, '[ \t\f\x0B]+', ' ', 'g'))),
      lambda x: NOT regexp_full_match(x, '[-|:=][-|:=\s]+')) AS a
  FROM {source}),
{p}n AS (
  SELECT {carried}, raw,
    trim(regexp_replace(array_to_string(a, chr(10)), '\n{{3,}}', chr(10)||chr(10), 'g'), chr(10)||' ') AS t
  FROM {p}l),
{p}f AS (
  SELECT {carried}, raw, t,
    replace(replace(replace(t, chr(10)||chr(10), chr(1)), chr(10), '.'||chr(10)||chr(10)), chr(1), chr(10)||chr(10)) AS text
  FROM {p}n)"""


_NORMALIZED = (
    _final_text("documents", "doc_id, source, lang")
    + r""",
d AS (
  SELECT doc_id, raw, text, 'doc://' || source || '/' || doc_id || '.txt' AS source_path,
    sha256(text) AS content_hash,
    sha256('doc://' || source || '/' || doc_id || '.txt:' || sha256(text)) AS document_id,
    strlen(raw) AS byte_size, length(text) AS char_count,
    CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count
  FROM f)
"""
)

# The pages as a stream of tags and texts with the stack of open elements. Holds
# for their markup: no '>' inside an attribute, only these named references.
_PAGES = (
    r"""
tok AS (
  SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS i
  FROM (SELECT page_id, regexp_extract_all(html,
    '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<[^>]*>|[^<]+') AS ts FROM pages)),
kinds AS (
  SELECT page_id, i, t, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) AS name,
    CASE WHEN t LIKE '</%' THEN 'close'
      WHEN regexp_matches(t, '^<(!|script>|style>|br|meta)') THEN 'skip'
      WHEN t LIKE '<%' THEN 'open' ELSE 'text' END AS kind
  FROM tok),
walk AS (
  SELECT page_id, -1::BIGINT AS i, []::STRUCT(name VARCHAR, pos BIGINT)[] AS stack FROM pages
  UNION ALL
  SELECT w.page_id, k.i, CASE k.kind
      WHEN 'open' THEN list_append(w.stack, {'name': k.name, 'pos': k.i})
      WHEN 'close' THEN w.stack[1:coalesce(
        len(w.stack) - list_position(list_reverse(list_transform(w.stack, lambda x: x.name)), k.name),
        len(w.stack))]
      ELSE w.stack END
  FROM walk w JOIN kinds k ON k.page_id = w.page_id AND k.i = w.i + 1),
shown AS (
  SELECT k.page_id, k.i, unnest(w.stack) AS e,
    trim(replace(replace(replace(regexp_replace(t, '&amp;?', '&', 'g'), '&copy;', chr(169)), '&middot;', chr(183)),
      '&quot;', '"'), ' ' || chr(10)) AS text
  FROM kinds k JOIN walk w ON w.page_id = k.page_id AND w.i = k.i WHERE k.kind = 'text'),
lines AS (
  SELECT page_id, e.pos AS pos, e.name AS name, string_agg(text, '' ORDER BY i) AS line
  FROM shown WHERE e.name IN ('h1', 'h2', 'h3', 'p', 'li') GROUP BY ALL),
extracted AS (
  SELECT page_id, coalesce(string_agg(
    CASE name WHEN 'h1' THEN '# ' WHEN 'h2' THEN '## ' WHEN 'h3' THEN '### ' WHEN 'li' THEN '- ' ELSE '' END || line,
    chr(10) ORDER BY pos) FILTER (line <> ''), '') AS text
  FROM pages LEFT JOIN lines USING (page_id) GROUP BY page_id),"""
    + _final_text("extracted", "page_id")
)

# Paragraph pieces keep the break before them. A run of short ones is one group;
# a long one (or a text without breaks) is a group of words.
_CHUNKED = (
    _NORMALIZED
    + r""",
para AS (
  SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS k, len(ps) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)||chr(10)) AS ps FROM d WHERE text <> '')),
sized AS (
  SELECT doc_id, k, n, CASE WHEN k > 0 THEN chr(10)||chr(10) ELSE '' END || p AS piece FROM para),
placed AS (
  SELECT *, length(piece) AS len, n = 1 OR length(piece) >= 300 AS big,
    (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS stop
  FROM sized),
grouped AS (
  SELECT *, stop - len AS start,
    (sum(CASE WHEN big THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT * 2
      + CASE WHEN big THEN 0 ELSE 1 END AS g
  FROM placed),
words AS (
  SELECT doc_id, g, start + CASE WHEN k > 0 THEN 1 ELSE 0 END AS base,
    unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT *, string_split(CASE WHEN k > 0 THEN substr(piece, 2) ELSE piece END, ' ') AS ws
        FROM grouped WHERE big)),
pieces AS (
  SELECT doc_id, g, start, stop FROM grouped WHERE NOT big
  UNION ALL
  SELECT doc_id, g, base + stop - len AS start, base + stop AS stop FROM (
    SELECT *, (sum(len) OVER (PARTITION BY doc_id, g ORDER BY i))::BIGINT AS stop
    FROM (SELECT *, length(w) + CASE WHEN i > 0 THEN 1 ELSE 0 END AS len FROM words))
  WHERE len > 0),
keyed AS (SELECT doc_id * 1000000 + g AS grp, doc_id, start, stop FROM pieces),
-- The first piece that no longer fits a window starting here.
full_at AS (
  SELECT a.grp, a.doc_id, a.start, b.start AS j_start, b.stop AS j_stop
  FROM (SELECT *, start + 300 AS lim FROM keyed) a
  ASOF LEFT JOIN keyed b ON a.grp = b.grp AND a.lim < b.stop),
-- Where the next window starts: back by the overlap, as far as the next piece allows.
hops AS (
  SELECT a.grp, a.start, a.j_start AS stop, b.start AS next
  FROM (SELECT *, greatest(j_start - 50, j_stop - 300) AS thr FROM full_at WHERE j_start IS NOT NULL) a
  ASOF JOIN keyed b ON a.grp = b.grp AND a.thr <= b.start),
ends AS (SELECT grp, doc_id, min(start) AS first, max(stop) AS last FROM keyed GROUP BY ALL),
chain AS (
  SELECT grp, first AS start FROM ends
  UNION ALL
  SELECT c.grp, h.next FROM chain c JOIN hops h ON h.grp = c.grp AND h.start = c.start),
windows AS (
  SELECT e.doc_id, c.grp, c.start, coalesce(h.stop, e.last) AS stop
  FROM chain c JOIN ends e ON e.grp = c.grp
  LEFT JOIN hops h ON h.grp = c.grp AND h.start = c.start),
cut AS (
  SELECT w.doc_id, w.grp, w.start,
    trim(substr(d.text, w.start + 1, w.stop - w.start), ' ' || chr(10)) AS chunk_text
  FROM windows w JOIN d ON d.doc_id = w.doc_id),
c AS (
  SELECT cut.doc_id, d.document_id, d.source_path, chunk_text,
    (row_number() OVER (PARTITION BY cut.doc_id ORDER BY grp, start) - 1)::INTEGER AS chunk_index
  FROM cut JOIN d ON d.doc_id = cut.doc_id WHERE chunk_text <> ''),
ch AS (SELECT *, sha256(document_id || ':' || chunk_index) AS chunk_id FROM c)
"""
)


def _documents(select: str) -> str:
    return f"WITH {_NORMALIZED} {select}"


def _chunks(select: str) -> str:
    return f"WITH RECURSIVE {_CHUNKED} {select}"


def _hashed(source: str, key: str) -> str:
    """CTEs that embed ``source(key, text)`` by signed word hashing."""
    return rf"""
tok AS (
  SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w
  FROM {source}),
hsh AS (SELECT {key}, ('0x' || substr(md5(w), 1, 7))::BIGINT AS h FROM tok),
dims AS (
  SELECT {key}, ((h >> 1) % 64)::INTEGER AS dim, sum(CASE WHEN h & 1 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s
  FROM hsh GROUP BY ALL),
vec AS (SELECT {key}, dim, s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS value FROM dims WHERE s <> 0)
"""


_SUFFIX = r"lower(regexp_extract(url, '[^/](\.[^./]+)$', 1))"
_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_UUID = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id))"

_TEXT_RANKS = f"""{_NORMALIZED}, src AS (
          SELECT 'q' || item_id AS id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM d),
        {_hashed("src", "id")},
        q AS (SELECT substr(id, 2)::BIGINT AS query_id, dim, value::FLOAT::DOUBLE AS v FROM vec WHERE id LIKE 'q%'),
        p AS (SELECT substr(id, 2)::BIGINT AS vec_id, dim, value::FLOAT::DOUBLE AS v FROM vec WHERE id LIKE 'd%'),
        s AS (SELECT query_id, vec_id, sum(q.v * p.v) AS dot FROM q JOIN p USING (dim) GROUP BY ALL),
        qn AS (SELECT query_id, sqrt(sum(v * v)) AS len FROM q GROUP BY ALL),
        pn AS (SELECT vec_id, sqrt(sum(v * v)) AS len FROM p GROUP BY ALL),
        pairs AS (SELECT item_id AS query_id, doc_id AS vec_id FROM benchmark, documents),
        full_s AS (SELECT pairs.query_id, pairs.vec_id, coalesce(dot / (qn.len * pn.len), 0.0) AS score
          FROM pairs LEFT JOIN s USING (query_id, vec_id) LEFT JOIN qn USING (query_id) LEFT JOIN pn USING (vec_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM full_s)"""

_HUNDREDTHS = f"""
        hs AS (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)::INTEGER AS rank FROM hs)"""

# BM25 by joining every word of a query with the words of every document.
_KEYWORDS = r"""
        kw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
        kd AS (SELECT doc_id, ws, len(ws)::DOUBLE AS length FROM kw WHERE len(ws) > 0),
        ka AS (SELECT count(*)::DOUBLE AS docs, avg(length) AS average FROM kd),
        kt AS (SELECT doc_id, length, word, count(*)::DOUBLE AS tf FROM (SELECT doc_id, length, unnest(ws) AS word FROM kd) GROUP BY ALL),
        kf AS (SELECT word, count(*)::DOUBLE AS df FROM kt GROUP BY word),
        kq AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark),
        ks AS (
          SELECT query_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score
          FROM kq JOIN kf USING (word) JOIN kt USING (word), ka GROUP BY query_id, doc_id),
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM ks)"""

ORACLE: dict[str, str] = {
    "source_kind": """
        SELECT doc_id, CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'html'
          WHEN 'es' THEN 'pdf' END AS source_kind FROM documents""",
    "path_parts": rf"""
        SELECT page_id, string_split(url, '/')[-1] AS file_name, {_SUFFIX} AS file_suffix,
          CASE WHEN {_SUFFIX} IN ('.html', '.htm') THEN 'text/html' WHEN {_SUFFIX} = '.txt' THEN 'text/plain'
            WHEN {_SUFFIX} IN ('.md', '.markdown') THEN 'text/markdown' WHEN {_SUFFIX} = '.pdf' THEN 'application/pdf'
            ELSE 'application/octet-stream' END AS mime_type FROM pages""",
    "scan_txt": r"""
        SELECT 'doc://' || source || '/' || doc_id || '.txt' AS source_path,
          regexp_replace(text, '\r\n?', chr(10), 'g') AS raw_text FROM documents""",
    # The documents hold no Markdown marks: each is one paragraph.
    "scan_md": """
        SELECT 'doc://' || source || '/' || doc_id || '.txt' AS source_path,
          trim(text, ' ' || chr(10)) AS raw_text FROM documents""",
    "markdown_document": """
        SELECT 'doc://' || source || '/' || doc_id || '.txt' AS source_path,
          '# Doc' || source || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10)
          || '- first' || n_chars || chr(10) || '- second' || chr(10) || 'quoted' || chr(10)
          || trim(text) || chr(10) || '## Last' AS raw_text FROM documents""",
    "html_extract": f"""
        WITH RECURSIVE {_PAGES}
        SELECT 'page://' || page_id || '.html' AS source_path,
          sha256('page://' || page_id || '.html:' || sha256(text)) AS document_id, text FROM f""",
    "mixed_sources": _documents("""
        , k AS (SELECT doc_id, lang, source, source_path, content_hash, text,
            CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' ELSE 'html' END AS source_kind,
            CASE lang WHEN 'en' THEN text WHEN 'fr' THEN '# ' || source || '.' || chr(10) || chr(10) || text
              ELSE '## ' || source || '.' || chr(10) || chr(10) || text END AS final
          FROM d JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id))
        SELECT source_path, source_kind, sha256(source_path || ':' || sha256(final)) AS document_id FROM k"""),
    "linearize_md_tables": """
        SELECT doc_id, 'Before' || chr(10) || chr(10) || 'Id: ' || doc_id || chr(10) || 'Lang: ' || lang || chr(10)
          || 'Src: ' || source || chr(10) || 'col_3: extra' || chr(10) || chr(10) || 'Id: x' || chr(10)
          || 'Lang: y' || chr(10) || text AS text FROM documents""",
    "linearize_html_tables": """
        SELECT 'doc://' || source || '/' || doc_id || '.txt' AS source_path,
          '- Id: ' || doc_id || ', Lang: ' || lang || ', Src: ' || source || ', ' || trim(text) || chr(10)
          || '- ' || lang || ': ' || source AS raw_text FROM documents""",
    "normalize_nfkc": "SELECT doc_id, nfc_normalize(text) || '|' || nfc_normalize(text) AS text FROM documents",
    "normalize_text": _documents("SELECT doc_id, t AS text FROM n"),
    "sentence_spacing": _documents("SELECT doc_id, text FROM f"),
    "strip_md_inline": r"""
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
          '`' || lang || '` ***' || source || '*** [' || doc_id || '](http://x.y/z) ' || text,
          '`([^`]+)`', '\1', 'g'), '\*{1,3}([^*]+)\*{1,3}', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS text
        FROM documents""",
    "split_sections": r"""
        SELECT doc_id, unnest(range(len(s)))::INTEGER AS pos, unnest(s) AS section FROM (
          SELECT doc_id, regexp_split_to_array(
            source || chr(10) || '### ' || replace(text, chr(10), chr(10) || '# '), '\n#{1,3} ') AS s FROM documents)""",
    "content_hash": _documents("SELECT source_path, content_hash FROM d"),
    "document_id": _documents("SELECT source_path, document_id FROM d"),
    "chunk_id": _chunks("SELECT source_path, chunk_index, chunk_id FROM ch"),
    "point_id": _chunks(f"""
        , u AS (SELECT source_path, chunk_index, {_UUID} AS x FROM ch)
        SELECT source_path, chunk_index, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-'
          || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(x, 17, 1)), 1) || substr(x, 18, 3)
          || '-' || substr(x, 21, 12) AS point_id FROM u"""),
    "document_stats": _documents("""
        SELECT source_path, byte_size::BIGINT AS byte_size, char_count::BIGINT AS char_count,
          line_count::BIGINT AS line_count FROM d"""),
    "metadata_json": _documents("""
        SELECT source_path, byte_size::VARCHAR AS byte_size, char_count::VARCHAR AS char_count, content_hash,
          doc_id || '.txt' AS file_name, '.txt' AS file_suffix, line_count::VARCHAR AS line_count,
          'text/plain' AS mime_type FROM d"""),
    "human_size": """
        SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE)
          WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
          WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
          ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS size
        FROM (SELECT doc_id, strlen(text) * doc_id AS b FROM documents)""",
    "storage_usage": """
        SELECT b AS total_bytes, CASE WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE)
          WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
          WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE)
          ELSE printf('%.1f TB', b / 1099511627776.0::DOUBLE) END AS total_size
        FROM (SELECT sum(strlen(text))::BIGINT AS b FROM documents)""",
    "ingest_documents": _documents("""
        SELECT document_id, source_path, 'txt' AS source_kind, content_hash, byte_size::BIGINT AS byte_size,
          char_count::BIGINT AS char_count, line_count::BIGINT AS line_count, doc_id || '.txt' AS file_name,
          'text/plain' AS mime_type FROM d"""),
    "document_lookup": _documents("""
        SELECT document_id, source_path, 'txt' AS source_kind, char_count::BIGINT AS char_count
        FROM d WHERE document_id = (SELECT min(document_id) FROM d)"""),
    "chunk_documents": _chunks("SELECT source_path, chunk_index, chunk_text FROM ch"),
    "sql_functions": _chunks("SELECT source_path, chunk_index, chunk_text FROM ch"),
    "chunk_stats": _chunks("""
        SELECT document_id, count(*) AS n_chunks, max(length(chunk_text))::BIGINT AS max_chars,
          max(chunk_index)::BIGINT AS last_index FROM ch GROUP BY document_id"""),
    "embed_chunks": _chunks(f"""
        , src AS (SELECT chunk_id, chunk_text AS text FROM ch), {_hashed("src", "chunk_id")}
        SELECT chunk_id, dim, round(value::FLOAT::DOUBLE, 5) AS value FROM vec"""),
    "index_status": _chunks("""
        SELECT 1::INTEGER AS schema_version, 'document_chunks' AS collection_name,
          (SELECT count(*) FROM ch) AS points_count, (SELECT count(*) FROM d) AS documents_count"""),
    "index_catalog": f"""
        WITH {_NORMALIZED} SELECT 'documents' AS name, 1::INTEGER AS layers, count(*) AS row_count,
          count(DISTINCT left(document_id, 2)) AS bucket_count FROM d""",
    "upsert_documents": f"""
        WITH {_NORMALIZED}, dl AS (SELECT * FROM d), turns AS (
          SELECT ('conv://' || conv_id || '/' || turn) AS source_path, text FROM conversations),
        {_final_text("turns", "source_path", "c_")},
        allrows AS (
          SELECT document_id, source_path, raw, text, doc_id, 'txt' AS kind, '2024-01-01' AS made FROM dl
          UNION ALL
          SELECT sha256(source_path || ':' || sha256(text)), source_path, raw, text, NULL, 'txt', '2024-02-01' FROM c_f)
        SELECT document_id, source_path,
          CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'md' ELSE kind END AS source_kind,
          strlen(raw)::BIGINT AS byte_size, length(text)::BIGINT AS char_count,
          (CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END)::BIGINT AS line_count,
          made AS created,
          CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '2024-02-01' ELSE made END AS updated
        FROM allrows""",
    "replace_chunks": _chunks("""
        SELECT document_id, chunk_index, chunk_text FROM ch
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL
        SELECT document_id, 0::INTEGER, text FROM d WHERE doc_id IN (SELECT doc_id FROM labels)"""),
    "delete_document": _chunks("""
        SELECT document_id, chunk_index, chunk_id FROM ch
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""),
    "stored_index": _chunks("""
        , counts AS (SELECT document_id, count(*) AS n FROM ch
          WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id)
        SELECT d.document_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'md' ELSE 'txt' END AS source_kind,
          coalesce(n, 0)::BIGINT AS n_chunks FROM d LEFT JOIN counts USING (document_id)"""),
    "semantic_search_topk": f"""
        SELECT e.vec_id, e.label, round({_COSINE}, 6) AS score FROM embeddings e CROSS JOIN {_FIRST}
        ORDER BY round({_COSINE}, 9) DESC, e.vec_id LIMIT 5""",
    "batch_search_topk": f"""
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS s FROM embeddings e, embeddings q),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 5""",
    "cosine_pairs": f"SELECT e.vec_id, round({_COSINE}, 6) AS score FROM embeddings e CROSS JOIN {_FIRST}",
    "score_bands": f"""
        SELECT vec_id, printf('%.4f', s) AS shown,
          CASE WHEN s > 0.8 THEN 'green' WHEN s > 0.5 THEN 'yellow' ELSE 'red' END AS band
        FROM (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e CROSS JOIN {_FIRST})""",
    "l2_normalize": """
        WITH x AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
        SELECT vec_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM x""",
    "dimension_guard": "SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM embeddings GROUP BY ALL",
    "text_search": f"""
        WITH {_TEXT_RANKS} SELECT query_id, rank, vec_id, round(score, 5) AS score FROM r WHERE rank <= 5""",
    "vector_index_topk": f"""
        SELECT e.vec_id, e.label, round({_COSINE}, 6) AS score FROM embeddings e CROSS JOIN {_FIRST}
        ORDER BY round({_COSINE}, 9) DESC, e.vec_id LIMIT 5""",
    "vector_index_batch": f"""
        WITH {_HUNDREDTHS} SELECT query_id, rank, vec_id, round(s, 6) AS score FROM h WHERE rank <= 5""",
    "filtered_search": f"""
        SELECT e.vec_id, e.label, round({_COSINE}, 6) AS score FROM embeddings e CROSS JOIN {_FIRST}
        WHERE e.label % 2 = 0 ORDER BY round({_COSINE}, 9) DESC, e.vec_id LIMIT 10""",
    "paged_search": f"""
        WITH s AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e CROSS JOIN {_FIRST}),
        n AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS place FROM s)
        SELECT ((place - 1) // 10 + 1)::INTEGER AS page, vec_id, round(s, 6) AS score FROM n WHERE place <= 30""",
    "keyword_search": f"""
        WITH {_KEYWORDS} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM b WHERE rank <= 10""",
    "hybrid_search": f"""
        WITH {_KEYWORDS}, {_TEXT_RANKS}, both_ranks AS (
          SELECT query_id, doc_id, rank FROM b WHERE rank <= 50
          UNION ALL SELECT query_id, vec_id, rank FROM r WHERE rank <= 50),
        fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (rank + 60)) AS score FROM both_ranks GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id)::INTEGER AS rank FROM fused)
        SELECT query_id, rank, doc_id, round(score, 9) AS score FROM placed WHERE rank <= 10""",
    "diverse_search": f"""
        WITH RECURSIVE {_HUNDREDTHS},
        c AS (SELECT query_id, vec_id, s FROM h WHERE rank <= 20),
        sims AS (
          SELECT a.query_id, a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS near
          FROM c a JOIN c b USING (query_id) JOIN embeddings e ON e.vec_id = a.vec_id JOIN embeddings q ON q.vec_id = b.vec_id),
        taken AS (
          SELECT DISTINCT query_id, 0 AS step, NULL::BIGINT AS vec_id, []::BIGINT[] AS ids FROM c
          UNION ALL
          SELECT query_id, step + 1, best, list_append(ids, best) FROM (
            SELECT t.query_id, t.step, t.ids, arg_max(c.vec_id, struct_pack(
              v := round(0.5::DOUBLE * c.s - 0.5::DOUBLE * coalesce((
                SELECT max(near) FROM sims WHERE sims.query_id = c.query_id AND x = c.vec_id AND list_contains(t.ids, y)), 0), 9),
              w := -c.vec_id)) AS best
            FROM taken t JOIN c ON c.query_id = t.query_id AND NOT list_contains(t.ids, c.vec_id)
            WHERE t.step < 5 GROUP BY t.query_id, t.step, t.ids))
        SELECT query_id, step::INTEGER AS rank, vec_id, round(s, 6) AS score
        FROM taken JOIN c USING (query_id, vec_id) WHERE step > 0""",
}
