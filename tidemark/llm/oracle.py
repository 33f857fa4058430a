"""The same results in SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

from tidemark.llm import licences as L
from tidemark.llm import shards as S
from tidemark.llm.quality import RULES, STOP_WORDS

# Runs between blanks; E'' strings hold the control characters themselves.
BLANKS = r"E'[ \t-\r]+'"


def _verdict() -> str:
    tests = []
    for rule in RULES:
        if rule.least is not None:
            tests.append(f"{rule.part} >= {rule.least}::DOUBLE * {rule.whole}")
        if rule.most is not None:
            tests.append(f"{rule.part} <= {rule.most}::DOUBLE * {rule.whole}")
    return " AND ".join(tests)


def quality(source: str = "documents") -> str:
    """Counts by unnesting words and windows of numbered rows."""
    stop_words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    WITH t AS (
      SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {source}
    ), w AS (
      SELECT k, doc_id, text,
        list_filter(regexp_split_to_array(text, {BLANKS}), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)),
                    lambda x: regexp_matches(x, E'[^ \t-\r]')) AS lines
      FROM t
    ), g AS (
      SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)
    ), r AS (
      SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1
    ), c AS (
      SELECT k, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS o(d) GROUP BY k
    ), m AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
        length(regexp_replace(text, '\P{{L}}', '', 'g')) AS n_letters,
        length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS n_capitals,
        len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({stop_words}))) AS n_stop_words
      FROM w LEFT JOIN c USING (k)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
      (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_verdict()}) AS kept
    FROM m"""


def licences(source: str = "documents") -> str:
    """Sentences unnested in three readings, joined with the known ones, alone or with the pieces
    after them, and put together again by the number of words before them."""
    known = ", ".join(f"('{text}', '{name}')" for text, name in L.known_sentences().items())
    heads = ", ".join(f"'{h}'" for h in L.HEADS)
    rules = ", ".join(
        f"({k}, '{licence}', '{L.pattern(ids)}', {fallback}, '{ids[0] if ids in L.COVERED else ''}', "
        f"'{L.pattern(L.COVERED.get(ids, ids))}')"
        for k, (licence, ids, fallback) in enumerate(L.RULES)
    )
    return rf"""
    WITH known(sentence, name) AS (VALUES {known}),
    rules(place, licence, pattern, fallback, first_name, covering) AS (VALUES {rules}),
    t AS (
      SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {source}
    ), versions AS (
      SELECT k, 0 AS v, text FROM t UNION ALL
      SELECT k, 1 AS v, replace(replace(text, chr(10), ' '), chr(13), ' ') FROM t UNION ALL
      SELECT k, 2 AS v, replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
        '{L.COPYRIGHT_LINE}', E'\\1\n\n', 'g'), '{L.BLANK_LINES}', chr(13), 'g'), chr(10), ' '), chr(13), chr(10)) FROM t
    ), cut AS (
      SELECT k, v, string_split(regexp_replace(regexp_replace(text, E'(https?://[^ \t-\r]+)', E'\n\\1\n', 'g'),
        E'([.!?:;])[ \t-\r]+', E'\\1\n', 'g'), chr(10)) AS parts
      FROM versions
    ), said AS (
      SELECT k, v, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM cut
    ), plain AS (
      SELECT k, v, i, regexp_replace(replace(trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')),
        'licence', 'license'), '{L.OWNERS}', 'nor the names of ') AS sentence FROM said
    ), numbered AS (
      SELECT k, v, i, sentence, lead(sentence) OVER w AS after, lead(sentence, 2) OVER w AS then_after,
        coalesce(sum(len(string_split(sentence, ' '))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM plain WHERE sentence <> '' WINDOW w AS (PARTITION BY k, v ORDER BY i)
    ), runs AS (
      SELECT k, v, i, place, 1 AS way, 0 AS part, sentence FROM numbered UNION ALL
      SELECT k, v, i, place, 2, 0, sentence || ' ' || after FROM numbered WHERE sentence IN ({heads}) UNION ALL
      SELECT k, v, i, place, 3, 0, sentence || ' ' || after || ' ' || then_after FROM numbered WHERE sentence IN ({heads})
      UNION ALL
      SELECT k, v, i, place, 4, generate_subscripts(operands, 1), sentence || ' ' || unnest(operands) FROM (
        SELECT *, regexp_split_to_array(replace(after, ' or later', ' orlater'), '{L.OPERATORS}') AS operands
        FROM numbered WHERE sentence = '{L.SPDX}')
    ), named AS (
      SELECT k, v, i, place, way, string_agg(name, ' ' ORDER BY part) AS name
      FROM runs JOIN known USING (sentence) GROUP BY ALL
    ), chosen AS (
      SELECT DISTINCT k, place, name FROM (
        SELECT k, place, first(name) OVER (PARTITION BY k, v, i ORDER BY way) AS name FROM named)
    ), sequences AS (
      SELECT k, ' ' || string_agg(name, ' ' ORDER BY place, name) || ' ' AS ids FROM chosen GROUP BY k
    ), hit AS (
      SELECT DISTINCT k, licence, first(place) OVER (PARTITION BY k, licence ORDER BY place) AS place, fallback
      FROM sequences JOIN rules ON regexp_matches(ids, pattern) AND (
        first_name = '' OR NOT regexp_matches(ids, covering) OR len(list_filter(
          string_split(replace(ids, ' ', '  '), ' ' || first_name || ' ')[2:],
          lambda x: regexp_matches(' ' || first_name || ' ' || x || ' ', pattern)
            AND NOT regexp_matches(' ' || first_name || ' ' || x || ' ', covering))) > 0)
    ), best AS (
      SELECT k, string_agg(licence, ',' ORDER BY place) AS licences FROM hit
      WHERE NOT fallback OR k NOT IN (SELECT k FROM hit WHERE NOT fallback) GROUP BY k
    )
    SELECT doc_id, coalesce(trim(ids), '') AS sentences, coalesce(licences, '') AS licences
    FROM t LEFT JOIN sequences USING (k) LEFT JOIN best USING (k)"""


def shards(source: str = "documents", limit: int = S.SHARD_BYTES) -> str:
    """The shortest address prefix whose rows fit; rows equal in key and text must fit."""
    hash_bits = "lpad(bin(('0x' || substr(md5({}), 1, 15))::BIGINT), 60, '0')"
    return f"""
    WITH t AS (
      SELECT row_number() OVER () AS k, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
        {hash_bits.format("coalesce(doc_id::VARCHAR, '')")} ||
        {hash_bits.format("coalesce(text, '')")} AS path
      FROM {source}
    ), sizes AS (
      SELECT depth, left(path, depth) AS prefix FROM t, range(0, 121) AS d(depth)
      GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR count(*) = 1
    ), found AS (
      SELECT k, min(depth) AS depth FROM t JOIN sizes ON left(path, depth) = prefix GROUP BY k
    )
    SELECT doc_id, n_bytes, left(path, depth) AS shard, depth::INTEGER AS depth
    FROM t JOIN found USING (k)"""


WARC = """
    WITH t AS (
      SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (
      SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
      FROM t
    )
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > first THEN first END AS refers_to
    FROM f"""

# Maximal runs of letters and digits, every character beyond ASCII among them.
TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


def ranked(docs: str = "documents", items: str = "benchmark") -> str:
    """Scores by joining every item's terms with the terms of every document."""
    return rf"""
    WITH k AS (
      SELECT row_number() OVER () AS k, doc_id, len(ts)::BIGINT AS n, ts
      FROM (SELECT doc_id, {TERMS} AS ts FROM {docs}) WHERE len(ts) > 0
    ), g AS (SELECT count(*) AS nn, sum(n) AS ll FROM k),
    tf AS (
      SELECT k, doc_id, t, 10 + (90 * n * nn) // ll AS m, count(*) AS tf
      FROM (SELECT k, doc_id, n, unnest(ts) AS t FROM k), g GROUP BY ALL
    ), df AS (
      SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, g GROUP BY t
    ), q AS (
      SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM {items}
    ), s AS (
      SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN df USING (t) JOIN tf USING (t) GROUP BY ALL
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank,
      doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10"""


def near_vectors(source: str = "embeddings", least: float = 0.9) -> str:
    """All pairs of usable vectors by cosine, and what can be reached over them."""
    return f"""
    WITH RECURSIVE r AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS v FROM {source}),
    u AS (
      SELECT k, vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM r
      WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
    ), pairs AS (
      SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k
      WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= {least}
    ), reached AS (
      SELECT k AS a, k AS b FROM r UNION SELECT s.a, p.b FROM reached s JOIN pairs p ON s.b = p.a
    ), lowest AS (SELECT a AS k, min(vec_id) AS component_id FROM reached JOIN r ON r.k = reached.b GROUP BY a),
    links AS (SELECT a AS k, count(*) AS n FROM pairs GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id,
      vec_id IS NOT DISTINCT FROM component_id AS kept, 1.0::DOUBLE AS recall
    FROM r JOIN lowest USING (k) LEFT JOIN links USING (k)"""


ORACLE = {
    "op12_flatgraph": near_vectors(),
    "op13_balltree": ranked(),
    "op2_quality": quality(),
    "op6_warc": WARC,
    "op9_shards": shards(),
    "op10_licences": licences(),
}
