"""Operators on vectors against plain NumPy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from tidemark.llm import flatgraph, queries, whitening

SF = "/root/testdata/sf0.001"


def vectors_frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, n long, x string").repartition(3)


# -- whitening -------------------------------------------------------------------------------


def check_whitening(found, usable):
    """``found`` rows against the definition over ``usable``: (id, vector) pairs."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in usable}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by_component = defaultdict(dict)
    for r in found:
        by_component[r.component][r.vec_id] = r
    for k, rows in by_component.items():
        assert set(rows) == set(x)
        want = {i: float((np.array(v) * n - sums) / n @ axes[:, k - 1]) / math.sqrt(values[k - 1]) for i, v in x.items()}
        sign = 1 if sum(rows[i].whitened * want[i] for i in x) >= 0 else -1
        for i, r in rows.items():
            assert abs(r.whitened * sign - want[i]) < 1e-6
            assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x[i], sums))
            assert math.isclose(r.explained, values[k - 1] / values.sum(), rel_tol=1e-9)
            assert r.identity_error < 1e-10
    return by_component


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = queries.QUERIES["op11_whitening"](spark, SF).collect()
    by_component = check_whitening(found, [(r.vec_id, r.embedding) for r in rows])
    assert sorted(by_component) == list(range(1, 17))


def test_whitening_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(40)] + [(None, [1.0, 2.0, 0.5, 0.25, -1.0])]
    good += [(50 + i, good[0][1]) for i in range(30)]  # one hot vector
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5),
           (104, [math.inf] * 5), (105, [1e300] * 5), (106, [1.0] * 4)]
    rows = [(i, v, 1, "y") for i, v in good + odd]
    found = whitening.whiten(vectors_frame(spark, rows, "array<double>")).collect()
    by_component = check_whitening(found, good)
    assert sorted(by_component) == [1, 2, 3, 4, 5] and len(found) == 5 * len(good)


def test_whitening_without_spread(spark):
    assert whitening.whiten(vectors_frame(spark, [])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(1, None, 1, "a")])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0], 1, "a"), (2, [1.0, 2.0], 1, "a")])).count() == 0
    line = vectors_frame(spark, [(i, [float(i), 2.0 * i, 1.0], 1, "a") for i in range(9)])
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_deviations_at_the_edge_of_a_long():
    sums = [1_000_000 * 10]
    for x in (10**8, 3 * 10**8, 303_700_049 + 1_000_000, 303_700_050 + 1_000_000, 10**15):
        value = (10 * x - sums[0]) ** 2
        assert whitening.deviations(np.array([[x]]), 10, sums) == [value if value < 1 << 63 else None]


@pytest.mark.parametrize("spectrum", ["decay", "equal", "low rank"])
def test_jacobi_davidson(spectrum):
    """More dimensions than the subspace holds, so that it restarts and locks."""
    size = 300
    values = {
        "decay": 1 / np.arange(1, size + 1),
        "equal": np.repeat(np.arange(size // 6, 0, -1.0), 6),
        "low rank": np.r_[5.0, 4, 3, np.zeros(size - 3)],
    }[spectrum]
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((size, size)))[0]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, axes, residual = whitening.leading_pairs(lambda z: matrix @ z, size)
    assert np.allclose(got, values[:16], atol=1e-12 * values[0])
    assert np.linalg.norm(matrix @ axes - axes * got, axis=0).max() < 1e-13 * values[0] and residual < 1e-13
    assert np.allclose(axes.T @ axes, np.eye(16), atol=1e-13)


# -- near duplicates --------------------------------------------------------------------------


def plain_links(rows, least=0.9):
    """(id, links, smallest reachable id) of every row, by all pairs."""
    usable = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    size = max((len(rows[k][1]) for k in usable), default=1)
    raw = np.zeros((len(usable), size))
    for at, k in enumerate(usable):
        v = np.array(rows[k][1], float)
        raw[at, : len(v)] = v / (np.abs(v).max() if not 1e-100 <= np.abs(v).max() <= 1e100 else 1)
    sizes = np.sqrt((raw * raw).sum(axis=1))
    near = raw @ raw.T / np.outer(sizes, sizes) >= least
    label = np.arange(len(usable))
    while (better := np.where(near, label, len(label)).min(axis=1, initial=len(label))).tolist() != label.tolist():
        label = better
    out = [(i, 0, i) for i, _ in rows]
    for at, k in enumerate(usable):
        ids = [rows[usable[j]][0] for j in np.flatnonzero(label == label[at])]
        named = [i for i in ids if i is not None]
        out[k] = (rows[k][0], int(near[at].sum()) - 1, min(named, default=None))
    return sorted(out, key=repr)


def found_links(spark, rows, kind="array<double>", **more):
    found = flatgraph.near_duplicates(vectors_frame(spark, [(i, v, 1, "y") for i, v in rows], kind), **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)


def unit_rows(rng, n, size):
    x = rng.standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_cosine(rng, x, cosine):
    side = unit_rows(rng, len(x), x.shape[1])
    side -= (side * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


def test_near_vectors_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = unit_rows(rng, 30, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, at_cosine(rng, base, 0.93), at_cosine(rng, base, 0.87)]))]
    rows += [(200 + i, rows[3][1]) for i in range(200)]  # one hot vector
    rows += [(3, rows[3][1]), (500, [7 * c for c in rows[4][1]]), (None, rows[5][1]), (None, [-9.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(600, None), (601, []), (602, [0.0] * 6), (603, [1.0, None] * 3), (604, [math.nan] * 6), (605, [math.inf] * 6),
             (606, [1e-300] * 6), (607, [1e300] * 6), (608, [0.3, 0.1]), (609, [0.6, 0.2, 0.0, 0.0, 0.0, 0.0])]
    assert found_links(spark, rows) == plain_links(rows)
    assert found_links(spark, []) == [] and found_links(spark, [(1, None)]) == [(1, 0, 1)]
    assert found_links(spark, [(1, [1.0, 0.0]), (2, [0.9, math.sqrt(0.19)])]) == [(1, 1, 1), (2, 1, 1)]


def test_near_vectors_over_many_shards(spark):
    """More nodes than one shard holds: lone pairs at the very limit, chains and a large group."""
    rng = np.random.default_rng(2)
    base = unit_rows(rng, 4500, 32)
    pairs = at_cosine(rng, base[:300], 0.9001)
    chain = [base[300:301]]
    for _ in range(40):
        chain.append(at_cosine(rng, chain[-1], 0.92))
    group = at_cosine(rng, np.repeat(base[400:401], 900, axis=0), 0.96)
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, pairs, *chain[1:], group]))]
    got, want = found_links(spark, rows), plain_links(rows)
    links = sum(n for _, n, _ in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert sum(n for _, n, _ in got) >= 0.995 * links
    assert sum(a[2] != b[2] for a, b in zip(got, want)) <= 6


def test_pruned_graph_reaches_every_point():
    """A crowd around one point, whose nearest neighbour is that point for all."""
    rng = np.random.default_rng(3)
    middle = unit_rows(rng, 1, 64)
    crowd = at_cosine(rng, np.repeat(middle, 1500, axis=0), 0.97)
    points = np.vstack([middle, crowd, unit_rows(rng, 500, 64)]).astype(np.float32)
    graph = flatgraph.pruned_graph(points)
    seen, todo = {0}, [0]
    while todo:
        todo = [j for i in todo for j in graph[i].tolist() if 0 <= j <= 1500 and j not in seen and not seen.add(j)]
    assert len(seen) == 1501


def test_tight_cells_are_split():
    points = 1 + np.random.default_rng(4).standard_normal((3000, 8)) * 1e-12
    centres = flatgraph.centres_of(points, 4, 0)
    two, more = flatgraph._nearest(points, centres)
    assert np.bincount(two[:, 0]).max() < 2000 and (more >= 0).all()
