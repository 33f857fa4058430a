import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import embed as E
from tidemark.operators import search as Q
from tidemark.operators import upsert as U


def frame(spark, matrix, key="vec_id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def brute_force(points, queries, k):
    def unit(m):
        m = np.asarray(m, dtype=np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(queries) @ unit(points).T, Q.RANK_DECIMALS)
    best = []
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        best += [(q, r + 1, i, row[i]) for r, i in enumerate(order)]
    return best


def assert_hits(df, expected):
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-8)


@pytest.fixture
def vectors():
    rnd = np.random.default_rng(7)
    points = rnd.normal(size=(230, 8))
    points[40:120] = points[3]  # a third of the rows are one copy
    points[200] = 0
    return points, rnd.normal(size=(31, 8))


def test_one_hot(spark):
    rows = [("p1", "d", "s", "hello", 0, [1.0, 0.0, 0.0, 0.0]), ("p2", "d", "s", "world", 1, [0.0, 1.0, 0.0, 0.0])]
    points = spark.createDataFrame(
        rows,
        "point_id string, document_id string, source_path string, chunk_text string, chunk_index int, embedding array<float>",
    )
    (hit,) = Q.search_points(points, [1.0, 0, 0, 0], 1).collect()
    assert (hit.chunk_text, hit.score) == ("hello", 1.0)
    assert hit.asDict().keys() == set(Q.SEARCH_RESULT)


def test_ranking_scan_reads_no_payload(spark, tmp_path):
    rows = [(f"p{i}", f"d{i % 3}", "s", f"text {i}", i, [float(i), 1.0]) for i in range(9)]
    names = "point_id string, document_id string, source_path string, chunk_text string, chunk_index int, embedding array<float>"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    ranked = Q.top_k(points.select("point_id", "document_id", "embedding"), [1.0, 0.0], 2)
    assert "chunk_text" not in ranked._jdf.queryExecution().executedPlan().toString()
    hits = Q.search_points(points, [1.0, 0.0], 3).collect()
    assert [h.chunk_text for h in hits] == ["text 8", "text 7", "text 6"]
    assert Q.search_points(points.limit(0), [1.0, 0.0], 3).collect() == []


def test_top_k_is_exact_and_ties_go_to_the_smaller_key(spark, vectors):
    points, queries = vectors
    for q in queries[:4]:
        found = Q.top_k(frame(spark, points), q.tolist(), 9, key="vec_id").collect()
        expected = brute_force(points, [q.astype(np.float64)], 9)
        assert [r.vec_id for r in found] == [e[2] for e in expected]


def test_plan_is_scan_score_take_ordered(spark, vectors):
    best = Q.top_k(frame(spark, vectors[0]), vectors[1][0].tolist(), 3, key="vec_id")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("k", [1, 5, 300])
def test_both_batch_strategies_match_brute_force(spark, vectors, monkeypatch, k):
    points, queries = vectors
    monkeypatch.setattr(Q, "BLOCK_ROWS", 10)
    monkeypatch.setattr(Q, "SCORE_CELLS", 400)
    p, q = frame(spark, points), frame(spark, queries, "query_id")
    expected = brute_force(points, np.asarray(queries, dtype=np.float32), k)
    assert_hits(Q.top_k_many(p, q, k), expected)
    assert_hits(Q.top_k_many(p, q, k, max_broadcast_bytes=0), expected)


def test_no_queries(spark, vectors):
    none = frame(spark, vectors[1], "query_id").where("query_id < 0")
    assert Q.top_k_many(frame(spark, vectors[0]), none).collect() == []


def test_wrong_query_size_fails(spark, vectors):
    with pytest.raises(Exception, match="dimension mismatch"):
        Q.top_k(frame(spark, vectors[0]), [1.0, 0.0], 3, key="vec_id").collect()


def test_cosine_functions_agree(spark, vectors):
    points, queries = vectors
    q = queries[0].tolist()
    df = frame(spark, points).select(
        V.cosine(F.col("embedding"), F.lit(q)).alias("native"),
        V.score_against(F.col("embedding"), q).alias("batch"),
        V.norm(V.l2_normalize(F.col("embedding"))).alias("length"),
    )
    for i, r in enumerate(df.collect()):
        assert abs(r.native - r.batch) < 1e-12
        assert abs(r.length - (0 if i == 200 else 1)) < 1e-12


def test_dimension_check(spark):
    df = frame(spark, [[1, 2], [3, 4]])
    assert U.check_dimension(df, 2).count() == 2
    with pytest.raises(Exception, match="collection has 3-dim vectors but got 2-dim"):
        U.check_dimension(df, 3).collect()


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i long, t string")


def test_hashing_embedder_cuts_runs_of_bounded_size(spark, monkeypatch):
    some = ["one two", None, "", "three " * 40, "four", "five six seven"] * 5
    whole = [r.embedding for r in E.HashingEmbedder(32).embed(texts(spark, some), "t").collect()]
    runs = list(E.slabs(pa.array(some), 30))
    assert [x for r in runs for x in r.to_pylist()] == some
    assert all(len(r) == 1 or sum(len(x or "") for x in r.to_pylist()) <= 30 for r in runs) and len(runs) > 10
    monkeypatch.setattr(E, "SLAB_BYTES", 30)
    assert [r.embedding for r in E.HashingEmbedder(32).embed(texts(spark, some), "t").collect()] == whole
    assert list(E.slabs(pa.array([], pa.string()), 30)) == []


def test_hashing_embedder(spark):
    df = E.HashingEmbedder(256).embed(texts(spark, ["Hello, world", "hello world!", "", "other", None]), "t")
    *found, missing = [r.embedding for r in df.orderBy("i").collect()]
    assert missing is None
    rows = [np.array(r) for r in found]
    assert all(len(r) == 256 for r in rows)
    assert (rows[0] == rows[1]).all()
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6
    assert not rows[2].any()


def model(encode, size=2, batch=3):
    return E.ModelEmbedder(lambda: encode, size, batch)


def test_model_embedder_is_normalised_and_batched(spark):
    def encode(batch):
        assert len(batch) <= 3
        return [[3.0, 4.0 * len(t)] for t in batch]

    rows = model(encode).embed(texts(spark, ["a", None] * 5), "t").orderBy("i").collect()
    assert np.allclose(rows[0].embedding, [0.6, 0.8])
    assert rows[1].embedding is None


def test_model_failure_is_null_for_that_text_only(spark):
    def encode(batch):
        if any("bad" in t for t in batch):
            raise RuntimeError("no")
        return [[1.0, 0.0] for _ in batch]

    rows = model(encode).embed(texts(spark, ["a", "bad", "b", "c"]), "t").orderBy("i").collect()
    assert [r.embedding is None for r in rows] == [False, True, False, False]


def test_unknown_backend(config):
    import dataclasses

    broken = dataclasses.replace(config, model=dataclasses.replace(config.model, backend="zzz"))
    with pytest.raises(ValueError, match="Unknown embedding backend"):
        E.create_embedder(broken)


def test_registered_backend(config):
    import dataclasses

    E.register_backend("constant", lambda c: model(lambda b: [[1.0, 0.0]] * len(b)))
    mine = dataclasses.replace(config, model=dataclasses.replace(config.model, backend="constant"))
    assert E.create_embedder(mine).vector_size == 2
    E._BACKENDS.pop("constant")
