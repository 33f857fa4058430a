"""Ranked lexical search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
from tidemark.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranked(docs, items, top=10):
    rows = [(i, Counter(t)) for i, x in docs if (t := plain_terms(x))]
    number, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    weight = {t: math.floor(1000 * math.log((2 * number + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for i, x in items:
        asked.setdefault(i, set()).update(plain_terms(x))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in rows:
            m = 10 + 90 * sum(c.values()) * number // length
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is not None, i, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, k, s[2], s[3]) for k, s in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n long, score string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, balltree.ranked(d.repartition(3), b).collect()), key=repr)


def test_ranked_equals_brute_force(spark, odd_rows):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Ünit", "日本", "x9", "it's", "A_b"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(100, 900)]
    docs += [(900 + i, docs[3][1]) for i in range(300)] + odd_rows
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "--"), (23, "ONE word"), (24, "nowhere9"), (None, "two three"),
              (3, "twelve"), (5, items[5][1]), (25, docs[3][1])]
    assert found(spark, docs, items) == plain_ranked(docs, items)


def test_ranked_on_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []
    docs = [(1, "a b"), (1, "a b"), (None, "b"), (None, "a b")]
    assert found(spark, docs, [(7, "A")]) == plain_ranked(docs, [(7, "A")])


def test_terms_do_not_depend_on_slices(monkeypatch):
    text = "It's a  TEST\n\tof9 slices: über-long, ABC" * 5 + "x" * 50
    whole = [t for part in balltree.terms(text.encode()) for t in part]
    assert [t.decode() for t in whole] == plain_terms(text)
    for size in (1, 3, 8):
        monkeypatch.setattr(balltree, "SLICE", size)
        assert [t for part in balltree.terms(text.encode()) for t in part] == whole


def test_bounds_hold_with_shared_dimensions(monkeypatch):
    """Every node's bound is at least the score of each of its documents; searches are exact."""
    rng = np.random.default_rng(0)
    monkeypatch.setattr(balltree, "LEAF_ROWS", 4)
    for folds in (7, 4096):
        monkeypatch.setattr(balltree, "FOLD", folds)
        size, rows = 60, 150
        dense = np.where(rng.random((rows, size)) < 0.2, rng.integers(0, 10**7, (rows, size)), 0)
        dense[10:40] = dense[9]
        entry = dense > 0
        ends = np.concatenate([[0], np.cumsum(entry.sum(axis=1))])
        keys = np.empty(rows, object)
        keys[:] = [balltree.Key(i) for i in range(rows)]
        block = balltree.Block(keys, ends, np.nonzero(entry)[1], dense[entry], size)
        items = [np.flatnonzero(rng.random(size) < 0.15) for _ in range(20)] + [np.zeros(0, np.int64)]
        folded = np.zeros((min(folds, size), len(items)))
        for k, wanted in enumerate(items):
            np.add.at(folded[:, k], wanted % len(folded), 1)
        bounds, order = block.bounds(folded), [k.id for k in block.ids]
        best = [[] for _ in items]
        block.search(best, items, folded, np.zeros(size, bool))
        for k, wanted in enumerate(items):
            scores = dense[:, wanted].sum(axis=1)
            for node, (a, b) in enumerate(zip(block.first, block.last)):
                assert bounds[node, k] >= scores[order[a:b]].max()
            ranked = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s)[:10]
            assert sorted((-s, key.id) for s, key in best[k]) == ranked


def test_wide_numbers():
    n, tf = np.array([10**8]), np.array([5 * 10**9])
    m = 10 + 90 * 10**8 * 10**12 // 10**19
    got = balltree.term_scores(n, np.array([0, 1]), tf, 10**12, 10**19)
    assert got.tolist() == [10**9 * tf[0].item() // (1000 * tf[0].item() + 8 * m)]


def test_blocks_keep_every_row():
    import pyarrow as pa

    lists = pa.array([[1] * (k % 4) for k in range(30)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(30)), pa.array([5] * 30), lists, lists.cast(pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"]
    )
    old = balltree.BLOCK_ROWS, balltree.BLOCK_ENTRIES
    try:
        for rows, entries in ((7, 1000), (1000, 5), (1, 1), (1000, 1000)):
            balltree.BLOCK_ROWS, balltree.BLOCK_ENTRIES = rows, entries
            got = list(balltree._blocks([batch, batch.slice(3, 5)]))
            assert [i for b in got for i in b[0].to_pylist()] == [*range(30), *range(3, 8)]
            assert all(len(b[0]) <= rows and (b[2][-1] <= entries or len(b[0]) == 1) for b in got)
    finally:
        balltree.BLOCK_ROWS, balltree.BLOCK_ENTRIES = old
