"""Keyword index, rank fusion and re-ranking against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import keyword_index as K
from tidemark.operators import rerank as R


def plain_bm25(docs, query, k):
    rows = [(i, Counter(w)) for i, t in docs if (w := K_words(t))]
    average = sum(sum(c.values()) for _, c in rows) / max(1, len(rows))
    df = Counter(w for _, c in rows for w in c)
    out = []
    for i, c in rows:
        length, score = sum(c.values()), 0.0
        for w in set(K_words(query)):
            if w in c:
                weight = math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
                score += weight * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / average))
        if score > 0:
            out.append((-round(score, 9), i))
    return [(i, round(-s, 7)) for s, i in sorted(out)[:k]]


def K_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower())


def corpus():
    rng = random.Random(4)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Straße", "naïve", "snake_case", "42"]
    docs = [(f"d{i:04d}", " ".join(rng.choices(pool, k=rng.randint(1, 80)))) for i in range(1500)]
    docs += [(f"x{i:03d}", "hot words everywhere " + docs[i % 3][1]) for i in range(500)]  # one frequent term, many ties
    return docs + [("n1", None), ("n2", ""), ("n3", " -- "), ("n4", "hot " * 5000)], pool


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs, _ = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "id string, text string, number int").repartition(5)
    old = K.BLOCK, K.SEGMENT_BITS
    K.BLOCK, K.SEGMENT_BITS = 16, 6  # several segments and blocks of a term
    try:
        yield K.build(frame.drop("number"), str(tmp_path_factory.mktemp("keywords")))
    finally:
        K.BLOCK, K.SEGMENT_BITS = old


def test_equals_plain_bm25(spark, index):
    docs, pool = corpus()
    rng = random.Random(9)
    asked = [" ".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(25)]
    asked += ["hot", "everywhere hot words", "STRASSE straße", "nothing_like_it", "", "w1 w1 w2", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    for k in (1, 10):
        got = {}
        for r in index.search_many(queries, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 7)))
            assert r.rank == len(got[r.query_id])
        for q, text in enumerate(asked):
            want = plain_bm25(docs, text, k)
            assert [i for i, _ in got.get(q, [])] == [i for i, _ in want], text
            assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in want], atol=1e-6)
    assert [r.id for r in index.search("snake_case 42", 3).orderBy("rank").collect()] == [i for i, _ in plain_bm25(docs, "snake_case 42", 3)]


def test_only_the_terms_partitions_are_read(spark, index):
    asked = spark.createDataFrame([("hot",), ("w2",)], "term string").withColumn("part", K.partition_of(F.col("term")))
    chosen = index._of(asked)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "In(term, [hot,w2])" in plan
    parts = {r.part for r in asked.collect()}
    scan = index._of(asked)._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == len(parts) < len({r.part for r in index.blocks.select("part").collect()})


def test_blocks_bound_their_postings(spark, index):
    blocks = index.blocks.collect()
    docs = {r.number: r.length for r in index.listed.collect()}
    hot = [b for b in blocks if b.term == "hot"]
    assert len(hot) > 10 and sum(b.n for b in hot) == 501
    for b in blocks:
        numbers = np.cumsum(b.gaps) + b.first
        assert len(numbers) == b.n <= 16 and len({int(x) >> 6 for x in numbers} | {b.segment}) == 1
        assert b.most_tf == max(b.tfs) and b.least_length == min(b.lengths) and all(docs[x] == n for x, n in zip(numbers, b.lengths))


def test_search_sends_no_posting_on_as_a_row(spark, index):
    """A row a posting and query made the search slower than the rest of it; hits leave a segment only."""
    asked = spark.createDataFrame([(1, "hot", 0.5), (2, "hot", 0.25), (2, "w1", 1.0)], "query_id int, term string, w double")
    rows = index._scores(index.blocks, asked, 3)
    assert "Generate explode(arrays_zip" not in rows._jdf.queryExecution().executedPlan().toString()
    segments = index.blocks.select("segment").distinct().count()
    hits = rows.collect()
    assert 0 < len(hits) < 2000 and segments > 10
    assert {r.number for r in hits if r.query_id == 1} <= {r.number for r in index.listed.collect()}


def test_long_texts_are_cut_before_their_segment_ends(spark, tmp_path, work, monkeypatch):
    monkeypatch.setattr(K, "HELD", 20)
    monkeypatch.setattr(K, "COUNTED", 10)
    docs = [(i, " ".join(f"w{(i * j) % 17}" for j in range(3 + i % 9))) for i in range(120)]
    index = K.build(spark.createDataFrame(docs, "id long, text string").repartition(3), str(tmp_path / "k"))
    for query in ("w3 w5", "w0", "w16 w1 w2"):
        got = [(r.id, round(r.score, 7)) for r in index.search(query, 7).orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i, _ in plain_bm25(docs, query, 7)]


def test_empty_index(spark, tmp_path):
    index = K.build(spark.createDataFrame([("a", None)], "id string, text string"), str(tmp_path / "k"))
    assert index.search("anything").count() == 0
    again = K.build(spark.createDataFrame([("a", "b")], "id string, text string"), str(tmp_path / "k"))
    assert [r.id for r in again.search("B").collect()] == ["a"]
    with pytest.raises(FileNotFoundError):
        K.KeywordIndex(spark, str(tmp_path / "none"))


def test_fusion(spark):
    kind = "query_id int, rank int, id string"
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "z")], kind)
    two = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (3, 1, "y")], kind)
    got = sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in K.fuse([one, two], 2).collect())
    assert got == [
        (1, 1, "b", round(1 / 62 + 1 / 61, 9)), (1, 2, "a", round(1 / 61, 9)), (2, 1, "z", round(1 / 61, 9)),
        (3, 1, "y", round(1 / 61, 9)),
    ]
    heavy = K.fuse([one, two], 1, weights=[1.0, 5.0]).where("query_id = 1").first()
    assert heavy.id == "b"


def plain_greedy(rows, k, trade):
    def cosine(a, b):
        return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    left, taken = sorted(rows), []
    while left and len(taken) < k:
        def value(row):
            away = max((cosine(row[2], t[2]) for t in taken), default=0.0)
            return round(trade * row[1] - (1 - trade) * away, 9)

        best = max(left, key=lambda row: (value(row), [-ord(c) for c in row[0]]))
        left.remove(best)
        taken.append(best)
    return [r[0] for r in taken]


def test_diverse_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(6):
        vectors = rng.standard_normal((40, 8)).astype(np.float32)
        vectors[10:20] = vectors[10]
        scores = np.round(rng.random(40), 1)  # ties
        rows += [(q, f"c{i:02d}", float(s), v.tolist()) for i, (s, v) in enumerate(zip(scores, vectors))]
    kind = "query_id int, id string, score double, embedding array<float>"
    frame = spark.createDataFrame(rows, kind)
    for trade in (0.0, 0.3, 0.9, 1.0):
        got = {}
        for r in R.diversify(frame, 7, trade).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q in range(6):
            own = [(i, s, np.array(v, np.float64)) for p, i, s, v in rows if p == q]
            assert got[q] == plain_greedy(own, 7, trade)
    few = R.diversify(frame.where("query_id = 0"), 3, most=2)
    assert few.count() == 2
    assert R.diversify(frame.limit(0)).count() == 0
