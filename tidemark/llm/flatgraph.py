"""Embedding near duplicates on a robust-pruned flat graph.

Rows of one direction are one node. Nodes are dealt into shards of bounded size by several
independent clusterings (``shards_of``); in each, a node also joins the second nearest cluster
unless it is clearly farther, so the shards overlap. In every shard a task builds a graph by robust
pruning: of a node's nearest nodes, and of the nearest in coarser random parts of the shard, it keeps
those that no kept neighbour lies much closer to. The adjacency lists of all shards are united by node (``flat_graph``).

Every node is then searched in each of its shards over the united lists: a greedy beam search from
the shard's medoids, and a range expansion that follows every node within the wanted cosine and a
little below, beginning with the best found and the node itself. Found nodes that also lie in shards
not yet searched lead there in a next round, until no search has anywhere to go. Cosines near the
limit are computed again in double precision. A link found in several shards counts in one of them
(the smallest shard the two share in the earliest round), so no pair ever becomes a row: tasks send
back counts, and one label a node for the components.

Recall is audited: a bounded sample of nodes is compared with all nodes, and below ``LEAST_RECALL``
everything is done again with more clusterings. The audited share is returned with every row.

Defined cases: vectors that are null, empty or zero, or hold a null or a value that is not finite,
link with nothing (``n_links`` 0, ``component_id`` their own id). Shorter vectors are read as padded
with zeros. Repeated rows and equal vectors are links of each other; ids may repeat, and a null id
is never a ``component_id`` unless nothing but null ids can be reached. ``kept`` compares the two
null-safe. Tables may be empty; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.staging import Stage, ship

SHARD_NODES = 4096
CHILDREN = 32  # clusters a split makes at most
SAMPLE = 8192  # members of a cell its centres are fitted on
SPILL = 0.1  # a node joins its second cluster too unless it is clearly farther
CLUSTERINGS, MOST_CLUSTERINGS = 3, 24
NEAREST, RANDOM, ALPHA = 48, 16, 1.2
DEGREE, FARTHER = 20, 10  # kept of the nearest, and of nodes farther off
LED = 3  # of its nearest that lead back to a point
BEAM, MEDOIDS = 12, 8
WIDER = 0.05  # how far below the wanted cosine a range expansion still follows
SLAB, FRONTIER = 512, 1 << 16
AUDITED, LEAST_RECALL = 512, 0.98
DIRECTION = 1e12


# -- nodes -------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return finite & F.exists(vector, lambda c: c != 0)


def directions(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v, d``: usable rows with their vector and its direction on a fine grid."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    # Very large or small ones are divided by their largest entry, lest squares leave the doubles.
    largest = F.array_max(F.transform(doubles, F.abs))
    largest = F.when((largest > 1e100) | (largest < 1e-100), largest).otherwise(F.lit(1.0))
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), doubles.alias("v"), largest.alias("m"))
    rows = rows.select("id", F.transform("v", lambda c: c / F.col("m")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    grid = rows.withColumn("r", norm)
    return grid.select(
        "id", "v", F.transform("v", lambda c: F.floor(c / F.col("r") * DIRECTION + 0.5)).alias("d")
    )


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows as unit vectors of ``size`` doubles, shorter ones padded with zeros."""
    out = _values(column, size)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _values(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        out = flat.reshape(-1, size)
    else:
        out = np.zeros((len(column), size))
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every two rows, in doubles."""
    sizes = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    return np.einsum("ij,ij->i", a, b) / sizes


def _lists(column: pa.ChunkedArray, fill: int) -> np.ndarray:
    """A list<long> column as rows of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), max(1, int(lengths.max(initial=0)))), fill, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


# -- overlapping shards -----------------------------------------------------------------------------


def centres_of(points: np.ndarray, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """Cluster centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)[0][:, 0]
        for j in range(len(centres)):
            own = points[near == j]
            centres[j] = own.mean(axis=0) if len(own) else points[rng.integers(len(points))]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest centres of every point, and how much farther the second is, as a share of
    the distance between the two centres."""
    middle = centres.mean(axis=0)  # differences in a tight cell would drown in the norms
    points, centres = points - middle, centres - middle
    off = (centres**2).sum(axis=1) - 2 * points @ centres.T
    if len(centres) < 2:
        return np.zeros((len(points), 2), np.int64), np.full(len(points), np.inf)
    two = np.argpartition(off, 1, axis=1)[:, :2]
    rows = np.arange(len(points))[:, None]
    two = np.take_along_axis(two, np.argsort(off[rows, two], axis=1, kind="stable"), 1)
    gap = np.linalg.norm(centres[two[:, 0]] - centres[two[:, 1]], axis=1)
    more = (off[rows[:, 0], two[:, 1]] - off[rows[:, 0], two[:, 0]]) / 2
    # The distance to the plane between two centres, against half their distance being 0.5.
    return two, np.divide(more, gap * gap, out=np.full_like(more, np.inf), where=gap > 0)


def shards_of(nodes: DataFrame, stage: Stage, size: int, clusterings: int, total: int) -> DataFrame:
    """``node, shard``: the shards of every node, each of at most ``SHARD_NODES`` nodes.

    Cells larger than that are split at centres fitted on a bounded sample of their members,
    level by level; hot cells are dealt over tasks. Which cells are split is known from counts.
    """
    root = F.array(*[F.lit(str(t)) for t in range(clusterings)]) if total > SHARD_NODES else F.array(F.lit("0"))
    members = nodes.select("node", "v", F.explode(root).alias("cell"))
    done, level, last = [], 0, None
    while True:
        counts = stage.table(members.groupBy("cell").agg(F.count("*").alias("size")), f"cells-{level}")
        sized = members.join(counts, "cell")
        small = sized.where(F.col("size") <= SHARD_NODES).select("node", "cell")
        done.append(stage.table(small, f"small-{level}"))
        if counts.where(F.col("size") > SHARD_NODES).isEmpty():
            break
        big = sized.where(F.col("size") > SHARD_NODES)
        chance = F.pmod(F.xxhash64("node", "cell", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        sample = big.where(chance < SAMPLE / F.col("size"))

        def fit(t: pa.Table) -> pa.Table:
            points, whole, cell = _matrix(t["v"], size), t["size"][0].as_py(), t["cell"][0].as_py()
            k = max(2, min(CHILDREN, -(-4 * whole // SHARD_NODES)))
            # Each clustering starts from centres of its own, where the samples are the same too.
            centres = centres_of(points, k, zlib.crc32(cell.encode()))
            return pa.table({"cell": [cell], "centres": [centres.tobytes()]})

        centres = stage.table(sample.groupBy("cell").applyInArrow(fit, "cell string, centres binary"), f"centres-{level}")
        parts = F.ceil(F.col("size") / (4 * SHARD_NODES)).cast("long")
        dealt = big.withColumn("part", F.pmod(F.xxhash64("node"), parts))
        spread = counts.where(F.col("size") > SHARD_NODES).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        sent = spread.join(centres, "cell")

        def assign(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"node": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "cell": pa.array([], pa.string())})
            centres = np.frombuffer(right["centres"][0].as_py()).reshape(-1, size)
            two, more = _nearest(_matrix(left["v"], size), centres)
            spill = np.flatnonzero(more < SPILL)
            rows = np.concatenate([np.arange(len(two)), spill])
            child = np.concatenate([two[:, 0], two[spill, 1]])
            cell = key[0].as_py()
            took = left.select(["node", "v"]).take(pa.array(rows))
            return took.append_column("cell", pa.array([f"{cell}.{c}" for c in child.tolist()], pa.string()))

        children = (
            dealt.select("cell", "part", "node", "v").groupBy("cell", "part")
            .cogroup(sent.groupBy("cell", "part"))
            .applyInArrow(assign, "node long, v array<double>, cell string")
        )
        members = stage.table(children, f"members-{level + 1}")
        if last:
            stage.drop(last)
        last, level = f"members-{level + 1}", level + 1
    whole = reduce(DataFrame.unionByName, done)
    return whole.select("node", F.xxhash64("cell").alias("shard")).distinct()


# -- the graph ----------------------------------------------------------------------------------------


def _pruned(points: np.ndarray, rows: np.ndarray, sims: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Of every row's candidates, nearest first, at most ``degree``: each one leaves out those that
    lie ``ALPHA`` times closer to it than to the row."""
    s = np.take_along_axis(sims, cand, 1)
    order = np.lexsort((cand, -s), axis=1)
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    around = points[cand]
    between = 2 - 2 * np.matmul(around, around.transpose(0, 2, 1))
    away, live = 2 - 2 * s, s > -2
    live[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    index, out = np.arange(len(rows)), np.full((len(rows), degree), -1, np.int64)
    for d in range(degree):
        pick = live.argmax(axis=1)
        on = live[index, pick]
        out[on, d] = cand[on, pick[on]]
        live[index, pick] = False
        live &= ~(ALPHA**2 * between[index, pick] < away - 1e-5)
    return out


def _without_repeats(lists: np.ndarray) -> np.ndarray:
    lists = -np.sort(-lists, axis=1)
    lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
    return lists


def pruned_graph(points: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbours of every point (-1: none) after robust pruning, reverse edges included."""
    n = len(points)
    rng = np.random.default_rng(seed)
    # Coarser and coarser random parts of the shard: their nearest members lead out of a tight group.
    parts = [np.arange(n)] + [np.sort(rng.permutation(n)[: max(1, n // 8**k)]) for k in (1, 2)]
    kept = np.full((n, DEGREE + FARTHER), -1, np.int64)
    for at in range(0, n, SLAB):
        rows = np.arange(at, min(n, at + SLAB))
        sims = points[rows] @ points.T
        # Equal distances are told apart at random, so that copies do not all choose the same few.
        sims += rng.random(sims.shape, np.float32) * np.float32(1e-6)
        sims[np.arange(len(rows)), rows] = -2
        lists = [rng.integers(0, n, (len(rows), RANDOM))]
        for part, most in zip(parts, (NEAREST, NEAREST // 3, NEAREST // 3)):
            size = min(most, len(part))
            lists.append(part[np.argpartition(-sims[:, part], size - 1, axis=1)[:, :size]])
        kept[rows, :DEGREE] = _pruned(points, rows, sims, lists[1], DEGREE)
        kept[rows, DEGREE:] = _pruned(points, rows, sims, np.concatenate([lists[0], *lists[2:]], axis=1), FARTHER)
    # Reverse edges. First every point is led to from some of its own nearest, so that none stays
    # unreachable. Where the lists of those are full (many points around one), points with the same
    # nearest lead to each other as a tree. Then the lists are filled, nearest first.
    back, used, led = np.full((n, 3 * DEGREE + 1), -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def enter(a: np.ndarray, b: np.ndarray, most: int) -> None:
        place = used[b] + np.arange(len(b)) - np.searchsorted(b, b)
        ok = place < most
        back[b[ok], place[ok]] = a[ok]
        np.add.at(used, b[ok], 1)
        np.add.at(led, a[ok], 1)

    for d in range(DEGREE):
        a = np.flatnonzero((led < LED) & (kept[:, d] >= 0))
        a = a[np.argsort(kept[a, d], kind="stable")]
        enter(a, kept[a, d], 3 * DEGREE)
    a = np.flatnonzero((led < 1) & (kept[:, 0] >= 0))
    a = a[np.argsort(kept[a, 0], kind="stable")]
    first = np.searchsorted(kept[a, 0], kept[a, 0])
    place = np.arange(len(a)) - first
    b = np.where(place > 0, a[first + (place - 1) // LED], kept[a, 0])
    order = np.argsort(b, kind="stable")
    enter(a[order], b[order], 3 * DEGREE + 1)
    a, slot = np.nonzero(kept >= 0)
    b = kept[a, slot]
    order = np.lexsort((-np.einsum("ij,ij->i", points[a], points[b]), b))
    enter(a[order], b[order], DEGREE)
    return _without_repeats(np.concatenate([kept, back], axis=1))


def flat_graph(members: DataFrame, size: int) -> DataFrame:
    """``node, neighbours``: the adjacency lists of all shards, united."""

    def build(t: pa.Table) -> pa.Table:
        ids = t["node"].to_numpy()
        if len(ids) < 2:
            return pa.table({"node": pa.array([], pa.int64()), "neighbours": pa.array([], pa.list_(pa.int64()))})
        graph = pruned_graph(_matrix(t["v"], size).astype(np.float32))
        ends = np.concatenate([[0], np.cumsum((graph >= 0).sum(axis=1))])
        near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[graph[graph >= 0]]))
        return pa.table({"node": ids, "neighbours": near})

    lists = members.select("shard", "node", "v").groupBy("shard").applyInArrow(build, "node long, neighbours array<long>")
    united = F.array_distinct(F.flatten(F.collect_list("neighbours")))
    return lists.groupBy("node").agg(united.alias("neighbours"))


# -- search -----------------------------------------------------------------------------------------------


class Shard:
    """The nodes of one shard with their part of the flat graph."""

    def __init__(self, t: pa.Table, size: int):
        ids = t["node"].to_numpy()
        order = np.argsort(ids, kind="stable")
        t = t.take(pa.array(order))
        self.ids, self.weight = ids[order], t["n"].to_numpy()
        self.exact = _values(t["v"], size)
        unit = self.exact / np.linalg.norm(self.exact, axis=1, keepdims=True)
        self.points = unit.astype(np.float32)
        self.shards = _lists(t["shards"], -1)
        far = _lists(t["neighbours"], -1)
        at = np.searchsorted(self.ids, far).clip(max=len(self.ids) - 1)
        self.graph = np.where((far >= 0) & (self.ids[at] == far), at, -1)
        width = max(1, int((self.graph >= 0).sum(axis=1).max(initial=0)))
        self.graph = -np.sort(-self.graph, axis=1)[:, :width]
        centres = centres_of(unit, min(MEDOIDS, len(ids)), 1, 2).astype(np.float32)
        self.medoids = np.unique((self.points @ centres.T).argmax(axis=0))

    def search(self, queries: np.ndarray, starts: tuple[np.ndarray, np.ndarray], least: float):
        """Pairs (query, node) with cosine ``least`` or more: places in both, in any order.
        ``starts`` are pairs of a query and a node to set out from beside the medoids."""
        n, m = len(self.ids), len(queries)
        points, graph = self.points, self.graph
        q32 = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
        seen = np.zeros((m, n), bool)
        beam_s = np.full((m, BEAM), -np.inf, np.float32)
        beam_i, fresh = np.zeros((m, BEAM), np.int64), np.zeros((m, BEAM), bool)
        near = np.float32(least - WIDER)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def push(rows: np.ndarray, cand: np.ndarray, valid: np.ndarray) -> None:
            sims = np.matmul(points[cand], q32[rows][:, :, None])[:, :, 0]
            sims[~valid] = -np.inf
            r, c = np.nonzero(valid)
            seen[rows[r], cand[r, c]] = True
            r, c = np.nonzero(sims >= near)
            hits.append((rows[r], cand[r, c], sims[r, c]))
            s = np.concatenate([beam_s[rows], sims], axis=1)
            best = np.argpartition(-s, BEAM - 1, axis=1)[:, :BEAM]
            beam_s[rows] = np.take_along_axis(s, best, 1)
            beam_i[rows] = np.take_along_axis(np.concatenate([beam_i[rows], cand], axis=1), best, 1)
            fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], valid], axis=1), best, 1)

        every = np.arange(m)
        push(every, np.tile(self.medoids, (m, 1)), np.ones((m, len(self.medoids)), bool))
        who, where = starts
        place = np.arange(len(who)) - np.searchsorted(who, who)
        for k in range(int(place.max(initial=-1)) + 1):
            rows, cand = who[place == k], where[place == k][:, None]
            push(rows, cand, ~seen[rows[:, None], cand])
        while True:
            open_s = np.where(fresh, beam_s, -np.inf)
            best = open_s.argmax(axis=1)
            rows = np.flatnonzero(open_s[every, best] > -np.inf)
            if not len(rows):
                break
            fresh[rows, best[rows]] = False
            cand = graph[beam_i[rows, best[rows]]]
            valid = cand >= 0
            cand = np.where(valid, cand, 0)
            push(rows, cand, valid & ~seen[rows[:, None], cand])
        # Everything in range, and a little beyond, leads on to its neighbours.
        frontier = [np.concatenate(part) for part in zip(*hits)]
        found = [frontier]
        while len(frontier[0]):
            more = []
            for at in range(0, len(frontier[0]), FRONTIER):
                who, node = frontier[0][at : at + FRONTIER], frontier[1][at : at + FRONTIER]
                cand = graph[node]
                keys = (who[:, None] * n + cand)[cand >= 0]
                keys = np.unique(keys[~seen.reshape(-1)[keys]])
                seen.reshape(-1)[keys] = True
                for k in range(0, len(keys), FRONTIER):
                    who, node = keys[k : k + FRONTIER] // n, keys[k : k + FRONTIER] % n
                    sims = np.einsum("ij,ij->i", q32[who], points[node])
                    ok = sims >= near
                    more.append((who[ok], node[ok], sims[ok]))
            frontier = [np.concatenate(part) for part in zip(*more)] if more else [np.zeros(0, np.int64)] * 3
            found.append(frontier)
        who, node, sims = (np.concatenate(part) for part in zip(*found))
        rounding = 4 * points.shape[1] * np.finfo(np.float32).eps
        sure = sims >= least + rounding
        close = np.flatnonzero(~sure & (sims >= least - rounding))
        for at in range(0, len(close), FRONTIER):
            part = close[at : at + FRONTIER]
            sure[part] = _cosines(queries[who[part]], self.exact[node[part]]) >= least
        return who[sure], node[sure]


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let the components of ``a[i]`` and ``b[i]`` be one, in place; a label is a smallest member."""
    while True:
        left, right = labels[a], labels[b]
        apart = left != right
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        left, right = left[apart], right[apart]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


FOUND = "node long, found long, label long, next_shard array<long>, next_entry array<long>"


def _found(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
    names = ["node", "found", "label", "next_shard", "next_entry"]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _settle(shard: Shard, here: int, asked: list[tuple], least: float) -> pa.Table:
    """Search a shard. ``asked``: (node, vector, shards searched before, shards of this round,
    place in the shard or where to start). Nodes' counts, labels and where they lead."""
    ids = np.array([a[0] for a in asked], np.int64)
    own = np.searchsorted(shard.ids, ids).clip(max=len(shard.ids) - 1)
    inside = shard.ids[own] == ids
    n = len(shard.ids)
    labels = np.arange(n + len(asked))  # queries from other shards come after the shard's nodes
    mine = np.where(inside, own, n + np.arange(len(asked)))
    names = np.concatenate([shard.ids, ids])
    counts = np.zeros(len(asked), np.int64)
    leads: dict[int, dict[int, int]] = {}
    for at in range(0, len(asked), SLAB):
        part = asked[at : at + SLAB]
        starts = [np.searchsorted(shard.ids, a[4]) for a in part]
        who, node = shard.search(
            np.stack([a[1] for a in part]), (np.arange(len(part)), np.array(starts, np.int64)), least
        )
        keep = names[mine[at + who]] != shard.ids[node]
        who, node = who[keep], node[keep]
        _joined(labels, mine[at + who], node)
        order = np.argsort(who, kind="stable")
        who, node = who[order], node[order]
        ends = np.searchsorted(who, np.arange(len(part) + 1))
        for k in np.flatnonzero(np.diff(ends)):
            got, (_, _, before, now, _) = node[ends[k] : ends[k + 1]], part[k]
            theirs = shard.shards[got]
            first = np.where(np.isin(theirs, now), theirs, np.iinfo(np.int64).max).min(axis=1)
            count = first == here
            if before:
                count &= ~np.isin(theirs, before).any(axis=1)
            counts[at + k] = shard.weight[got[count]].sum()
            away = ~np.isin(theirs, [*before, *now, -1])
            if away.any():
                r, c = np.nonzero(away)
                lead = leads.setdefault(at + int(k), {})
                for target, entry in zip(theirs[r, c].tolist(), shard.ids[got[r]].tolist()):
                    lead[target] = min(entry, lead.get(target, entry))
    rows = []
    smallest = names[labels]
    for k in range(len(asked)):
        lead = leads.get(k, {})
        if counts[k] or lead or smallest[mine[k]] != ids[k]:
            rows.append((ids[k], counts[k], smallest[mine[k]], list(lead), list(lead.values())))
    asked_places = set(mine.tolist())
    for k in np.flatnonzero(smallest[:n] != shard.ids):
        if int(k) not in asked_places:
            rows.append((shard.ids[k], 0, smallest[k], [], []))
    return _found(rows)


def _own_round(size: int, least: float):
    def search(t: pa.Table) -> pa.Table:
        here, shard = t["shard"][0].as_py(), Shard(t, size)
        now = [[x for x in row if x != -1] for row in shard.shards.tolist()]
        ids = shard.ids.tolist()
        return _settle(shard, here, list(zip(ids, shard.exact, [[]] * len(ids), now, ids)), least)

    return search


def _later_round(size: int, least: float):
    def search(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _found([])
        columns = [queries[c].to_pylist() for c in ("query", "before", "now", "entry")]
        q, before, now, entry = columns
        vectors = _values(queries["qv"], size)
        return _settle(Shard(members, size), key[0].as_py(), list(zip(q, vectors, before, now, entry)), least)

    return search


def linked(nodes: DataFrame, stage: Stage, size: int, least: float, clusterings: int, total: int) -> DataFrame:
    """``node, found, label``: per node and search, the linked rows counted there, and a node of
    its component."""
    run = f"g{clusterings}"
    inner = stage.inside(run)
    member = inner.table(shards_of(nodes, inner, size, clusterings, total), "shards")
    placed = member.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    graph = flat_graph(member.join(nodes, "node"), size)
    full = inner.table(nodes.join(placed, "node").join(graph, "node", "left"), "graph")
    of_shard = full.select(
        F.explode("shards").alias("shard"), "node", "v", "n", "shards",
        F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"),
    )
    found = inner.table(of_shard.groupBy("shard").applyInArrow(_own_round(size, least), FOUND), "found-0")
    rounds = [found]
    searched = full.select("node", F.col("shards").alias("before"))
    while True:
        leads = found.where(F.size("next_shard") > 0).select(
            "node", F.explode(F.arrays_zip("next_shard", "next_entry")).alias("x")
        )
        leads = leads.groupBy("node", F.col("x.next_shard").alias("shard")).agg(F.min("x.next_entry").alias("entry"))
        leads = inner.table(leads, f"leads-{len(rounds)}")
        if leads.isEmpty():
            break
        now = leads.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("now"))
        state = inner.table(searched.join(now, "node"), f"searched-{len(rounds)}")
        queries = (
            leads.join(state, "node").join(nodes.select("node", "v"), "node")
            .select("shard", "entry", F.col("node").alias("query"), F.col("v").alias("qv"), "before", "now")
        )
        slices = leads.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_NODES).cast("long").alias("slices"))
        queries = queries.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("query"), "slices")).drop("slices")
        members = of_shard.join(slices, "shard").withColumn(
            "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
        )
        more = (
            members.drop("slices").groupBy("shard", "slice")
            .cogroup(queries.groupBy("shard", "slice"))
            .applyInArrow(_later_round(size, least), FOUND)
        )
        found = inner.table(more, f"found-{len(rounds)}")
        searched = searched.join(now, "node", "left").select(
            "node", F.concat("before", F.coalesce("now", F.array().cast("array<long>"))).alias("before")
        )
        searched = inner.table(searched, f"before-{len(rounds)}")
        rounds.append(found)
    return reduce(DataFrame.unionByName, rounds).select("node", "found", "label")


# -- audit and result -----------------------------------------------------------------------------------------


def audited_recall(nodes: DataFrame, counts: DataFrame, size: int, least: float) -> float:
    """The share of true links found for a bounded sample of nodes, half of them nodes with links
    found, by comparing the sample with all nodes."""
    shuffled = F.xxhash64("node", F.lit(17))
    known = nodes.join(counts, "node", "left").select("node", "v", F.coalesce("links", F.lit(0)).alias("links"))
    half = AUDITED // 2
    taken = known.orderBy(shuffled).limit(half).union(known.where("links > 0").orderBy(shuffled).limit(half))
    sample = taken.distinct().toArrow()
    if not sample.num_rows:
        return 1.0
    ids, queries, found = sample["node"].to_numpy(), _matrix(sample["v"], size), sample["links"].to_numpy()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = _matrix(part.column(1), size) @ queries.T >= least
                near &= part.column(0).to_numpy()[:, None] != ids
                total += near.T @ part.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "links"])

    rows = nodes.select("node", "v", "n").mapInArrow(compare, "node long, links long")
    true = {r.node: r.t for r in rows.groupBy("node").agg(F.sum("links").alias("t")).collect()}
    pairs = [(min(int(f), true[int(i)]), true[int(i)]) for i, f in zip(ids, found) if true[int(i)]]
    if not pairs:
        return 1.0
    # Of all links, and of the links of a node on average: one large group must not hide the rest.
    return min(sum(f for f, _ in pairs) / sum(t for _, t in pairs), sum(f / t for f, t in pairs) / len(pairs))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9
) -> DataFrame:
    """``key, n_links, component_id, kept, recall``: one row per row, see the module's text."""
    spark = vectors.sparkSession
    ship(spark)
    stage = Stage(spark, "flatgraph")
    rows = stage.table(directions(vectors, key, vector), "rows")
    # One node a direction; numbered once, as written, so that a repeated task gives the same.
    grouped = rows.groupBy("d").agg(F.min("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("first"))
    classes = stage.table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    about = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    total, size = about.n, about.size or 1
    nodes = classes.select("node", "v", "n")
    clusterings, recall = CLUSTERINGS, 1.0
    while True:
        found = linked(nodes, stage, size, least, clusterings, total)
        counts = stage.table(found.groupBy("node").agg(F.sum("found").alias("links")), f"counts-{clusterings}")
        recall = audited_recall(nodes, counts, size, least)
        if recall >= LEAST_RECALL or clusterings >= MOST_CLUSTERINGS:
            break
        stage.drop(f"g{clusterings}")
        clusterings *= 2
    ends = found.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    named = components(stage, ends, "parts").select("node", F.col("label").alias("part"))
    stage.drop(f"g{clusterings}")
    joined = classes.join(named, "node", "left").withColumn("part", F.coalesce("part", "node"))
    smallest = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    settled = (
        joined.join(smallest, "part").join(counts, "node", "left")
        .select("d", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    )
    settled = stage.table(settled, "settled")
    with_links = rows.select("id", "d").join(settled, "d").select("id", "n_links", "component_id")
    rest = vectors.where(~F.coalesce(usable(F.col(vector)), F.lit(False)))
    without = rest.select(F.col(key).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    out = with_links.unionByName(without)
    return out.select(
        F.col("id").alias(key), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"),
    )
