"""The partitioned vector index against plain scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import search as Q
from tidemark.operators import vector_index as V


def clustered(spark, n=3000, size=12, clusters=25, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((clusters, size))
    x = middle[rng.integers(0, clusters, n)] + 0.35 * rng.standard_normal((n, size))
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), int(i % 7), f"g{i % 3}") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, name string"), x.astype(np.float32)


@pytest.fixture(scope="module")
def points(spark):
    return clustered(spark)


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    return V.build(points[0], str(tmp_path_factory.mktemp("index")))


def hits(df):
    return [(r.vec_id, round(r.score, 8)) for r in df.collect()]


@pytest.mark.parametrize("query", [100, 7, "between", "opposite"])
def test_exact_search_equals_a_scan(index, points, query):
    df, x = points
    vector = {"between": x[0] + x[1], "opposite": -x[5]}.get(query)
    vector = (x[query] if vector is None else vector).tolist()
    for k, probes in ((1, 1), (5, None), (50, 2)):
        assert hits(index.search(vector, k, probes=probes)) == hits(Q.top_k(df, vector, k, "vec_id"))


def test_exact_search_reads_few_cells(index, points):
    """The second job's scan is pruned to the partitions in reach."""
    vector = points[1][42].tolist()
    scan = index.search(vector, 5)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "angle" in plan.split("PushedFilters")[1]
    cells = len(index.centres)
    away = index._away(np.array([vector]))[0]
    kth = index.search(vector, 5).collect()[-1].score
    assert (away - index._column("radius") <= V._within(kth)).sum() < cells / 3


def test_filter_does_not_grow_with_the_cells(spark, points, tmp_path, work):
    """One range an or-ed term a cell overflowed generated code, or the stack, with many cells."""
    df, x = points
    index = V.build(df, str(tmp_path / "i"), cells=400)
    assert len(index.centres) > 300
    scan = index.search((-x[5]).tolist(), 20, F.col("label") % 2 == 0, probes=1)
    assert scan._jdf.queryExecution().optimizedPlan().toString().count("angle") < 40
    assert hits(scan) == hits(Q.top_k(df.where("label % 2 = 0"), (-x[5]).tolist(), 20, "vec_id"))


def test_bounds_hold(index):
    rows = index.points().toPandas()
    assert len(rows) == 3000 and rows.vec_id.is_unique
    unit = np.stack(rows.embedding) / np.linalg.norm(np.stack(rows.embedding), axis=1, keepdims=True)
    place = {int(c): k for k, c in enumerate(index._column("cell"))}
    own = index.centres[[place[c] for c in rows.cell]]
    angle = np.arccos(np.clip((unit * own).sum(axis=1), -1, 1))
    assert np.allclose(angle, rows.angle, atol=1e-6)
    assert (rows.angle.to_numpy() <= index._column("radius")[[place[c] for c in rows.cell]]).all()
    norms = np.linalg.norm(np.stack(rows.embedding), axis=1)
    for c, k in place.items():
        here = norms[rows.cell == c]
        assert math.isclose(here.min(), index._column("least_norm")[k], rel_tol=1e-6)
        assert math.isclose(here.max(), index._column("most_norm")[k], rel_tol=1e-6)


def test_filtered_search_equals_filtered_scan(index, points):
    df, x = points
    where = (F.col("label") == 3) & (F.col("name") != "g0")
    for i in (3, 77):
        assert hits(index.search(x[i].tolist(), 20, where)) == hits(Q.top_k(df.where(where), x[i].tolist(), 20, "vec_id"))
    plan = index.search(x[3].tolist(), 5, where)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "name" in plan.split("PushedFilters")[1]
    assert index.search(x[3].tolist(), 5, F.col("label") == 99).count() == 0


def test_pages_equal_one_large_result(index, points):
    df, x = points
    vector = x[100].tolist()  # forty equal scores run over several pages
    pages = []
    for page in index.pages(vector, 15):
        pages += [(r.vec_id, round(r.score, 8)) for r in page]
        if len(pages) >= 75:
            break
    assert pages == hits(Q.top_k(df, vector, 75, "vec_id"))
    narrow = F.col("label") == 2
    whole = [(r.vec_id, round(r.score, 8)) for page in index.pages(vector, 200, narrow) for r in page]
    assert whole == hits(Q.top_k(df.where(narrow), vector, 3000, "vec_id"))


def test_cursor_is_stable_when_rows_come_and_go(points):
    df, x = points
    vector = x[9].tolist()
    first = Q.top_k(df, vector, 10, "vec_id").collect()
    after = (first[-1].score, first[-1].vec_id)
    want = hits(Q.top_k(df, vector, 20, "vec_id"))[10:]
    gone = [r.vec_id for r in first[:4]]
    assert hits(Q.top_k(df.where(~F.col("vec_id").isin(gone)), vector, 10, "vec_id", after)) == want


def test_many_queries(index, points):
    df, _ = points
    queries = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    key = ["query_id", "rank"]
    got = [(r.query_id, r.rank, r.vec_id) for r in index.search_many(queries, 5).orderBy(*key).collect()]
    want = [(r.query_id, r.rank, r.vec_id) for r in Q.top_k_many(df.select("vec_id", "embedding"), queries, 5).orderBy(*key).collect()]
    assert got == want


def test_asking_every_cell_goes_on_in_bounded_batches(index, points, monkeypatch):
    """A query may ask every cell: its vector came back once a cell, all of a batch's at once."""
    monkeypatch.setattr(V, "ANGLES", 40 * len(index.centres))
    monkeypatch.setattr(V, "ASKED", 1000)

    def ordered(away, batch):
        assert away.size <= 40 * away.shape[1]
        return V._ordered(away, batch)

    queries = points[0].coalesce(1).where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = index._ask(queries, ordered).collect()
    assert len(rows) == 300 * len(index.centres) and len({(r.query_id, r.cell) for r in rows}) == len(rows)
    x = points[1]
    for r in rows[:: len(index.centres) * 7]:
        assert np.allclose(r.query, x[r.query_id])
    products = V._nearest(np.eye(3), np.array([[1.0, 0, 0], [0, 1.0, 0]]))
    assert products[0].tolist()[:2] == [0, 1] and products[1].tolist() == [1.0, 1.0, 0.0]


def test_probing_reaches_its_recall(index, points, spark):
    df, _ = points
    reached = index.calibrate(5, 0.95)
    assert reached >= 0.95 and index.probes < len(index.centres) / 2
    assert V.VectorIndex(spark, index.path).probes == index.probes
    queries = df.where("vec_id % 10 = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    assert index.recall(queries, 5, index.probes) >= 0.9
    assert index.recall(queries, 5, len(index.centres)) == 1.0


def test_hot_cell_is_dealt_in_blocks(spark, tmp_path, work, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    df, _ = clustered(spark, 600, clusters=2, seed=3)
    index = V.build(df, str(tmp_path / "i"), cells=2)
    queries = df.where("vec_id < 120").select(F.col("vec_id").alias("query_id"), "embedding")
    got = sorted(map(tuple, index.search_many(queries, 3).select("query_id", "rank", "vec_id").collect()))
    want = sorted(map(tuple, Q.top_k_many(df.select("vec_id", "embedding"), queries, 3).select("query_id", "rank", "vec_id").collect()))
    assert got == want


def test_odd_vectors_and_rebuild(spark, tmp_path, work):
    kind = "vec_id long, embedding array<double>, label int"
    odd = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [math.nan, 1.0], 1), (5, [1.0, None], 1), (6, [1.0], 1)]
    empty = V.build(spark.createDataFrame(odd[:5], kind), str(tmp_path / "i"))
    assert empty.rows == 0 and empty.search([1.0, 0.0]).count() == 0
    assert empty.search_many(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")).count() == 0
    index = V.build(spark.createDataFrame(odd + [(7, [3.0, 4.0], 2), (8, [4.0, 3.0], 2)], kind), str(tmp_path / "i"))
    assert [r.vec_id for r in index.search([0.0, 2.0], 9).collect()] == [7, 8]
    index.vacuum()
    assert [r.vec_id for r in V.VectorIndex(spark, str(tmp_path / "i")).search([0.0, 2.0], 1).collect()] == [7]
    with pytest.raises(FileNotFoundError):
        V.VectorIndex(spark, str(tmp_path / "none"))
