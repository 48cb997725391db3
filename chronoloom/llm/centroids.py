"""Lloyd's algorithm on whole numbers through two trees.

Vectors of ``dims`` finite components become integers floor(``scale`` * x) and are
packed once into blocks of BLOCK vectors, each with a cover tree of its own: a
node's children are points of it that are at least half its reach apart and
cover it within that half, and its points lie next to each other.  Each round
builds a cover tree over the centroids on the driver (``k`` of them, a parameter)
and sends both to the tasks.  A task walks pairs of a vector node and a
centroid node from the roots down, all of a level at once, the wider of the two
being split.  A centroid node goes when its least distance to the vector node
exceeds the greatest distance to another one's centre; where one centroid is
left, the node's count and sum are taken as a whole; leaves that still have
several are compared exactly.  Bounds are widened by SLACK against rounding, so
pruning never decides a tie.

Only a centroid's count and sums leave a task (k rows), and k times dims sums
reach the driver; blocks are written once to the shared folder and read each round.

Edge cases: null vectors, other lengths, and null or non-finite components are left out; components
beyond 2**27 after scaling are held to it, so that distances fit a long; an
inertia that doesn't fit is null.  Null ids hash as the empty text and stay;
repeated rows are vectors of their own, and equal digests are told apart by components; fewer vectors than
``k`` give as many centroids; an empty table gives an empty result.  Repeated
centroids are allowed (the smaller number takes all), empty ones stay as they were.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

CENTROIDS, DIMS, SCALE, SEED, ROUNDS = 16, 64, 64, 1, 3
BLOCK, LEAF = 1024, 16
MOST = 1 << 27
SLACK = 1e-9
BLOCK_SCHEMA = "ids binary, points binary, width int, centres binary, radii binary, child_from binary, child_to binary, point_from binary, point_to binary"


@dataclass
class CoverTree:
    """Points in tree order and, per node: its centre (a point), the radius about it, its children and its points."""

    points: np.ndarray
    order: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    child_from: np.ndarray
    child_to: np.ndarray
    point_from: np.ndarray
    point_to: np.ndarray


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers (points by others)."""
    if max(np.abs(points).max(initial=0), np.abs(others).max(initial=0)) < 1 << 22:  # exact in doubles
        p, o = points.astype(float), others.astype(float)
        return ((p * p).sum(1)[:, None] + (o * o).sum(1) - 2 * (p @ o.T)).astype(np.int64)
    out = np.empty((len(points), len(others)), np.int64)
    for j, o in enumerate(others.astype(np.int64)):
        out[:, j] = ((points.astype(np.int64) - o) ** 2).sum(1)
    return out


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree of at least one row of integers."""
    p = points.astype(np.int64)
    order = np.arange(len(p))
    far = np.sqrt(squared(p, p[:1])[:, 0])
    nodes = [[0, float(far.max()), 0, 0, 0, len(p)]]  # centre, radius, children, points
    away = {0: far}
    at = 0
    while at < len(nodes):
        centre, radius, _, _, first, last = nodes[at]
        own, near = order[first:last], away.pop(at)
        if len(own) > leaf and radius > 0:
            reach = 2.0 ** (math.ceil(math.log2(radius)) - 1)
            picked, owner = [centre], np.zeros(len(own), np.int64)
            while near.max() > reach:  # the farthest point becomes the next child's centre
                new = int(own[int(near.argmax())])
                d = np.sqrt(squared(p[own], p[new : new + 1])[:, 0])
                closer = d < near
                owner[closer], near = len(picked), np.minimum(near, d)
                picked.append(new)
            by = np.argsort(owner, kind="stable")
            order[first:last], near, sizes = own[by], near[by], np.bincount(owner, minlength=len(picked))
            nodes[at][2:4] = len(nodes), len(nodes) + len(picked)
            start = 0
            for c, n in zip(picked, sizes.tolist(), strict=True):
                away[len(nodes)] = near[start : start + n]
                nodes.append([c, float(near[start : start + n].max()), 0, 0, first + start, first + start + n])
                start += n
        at += 1
    table = np.array(nodes, float)
    place = np.empty(len(p), np.int64)
    place[order] = np.arange(len(p))
    whole = table[:, [0, 2, 3, 4, 5]].astype(np.int64).T
    return CoverTree(p[order], order, place[whole[0]], table[:, 1], *whole[1:])


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first:last one after another, and the range that each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def dual_assign(vectors: CoverTree, centroids: CoverTree, seen: dict | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each vector's nearest centroid (its number in the given order), in tree order,
    and the nodes that one centroid took whole (centroid, node).

    seen counts what was looked at: pairs of nodes, pruned ones, and exact distances."""
    out = np.empty(len(vectors.points), np.int64)
    number = centroids.order  # of the centroid in each place
    whole: list[tuple[int, int]] = []
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    seen = seen if seen is not None else {}
    while len(node):
        nodes, start, many = np.unique(node, return_index=True, return_counts=True)
        group = np.repeat(np.arange(len(nodes)), many)
        pairs = vectors.points[vectors.centres[node]] - centroids.points[centroids.centres[other]]
        d = np.sqrt((pairs.astype(float) ** 2).sum(1))
        rv, rc = vectors.radii[node], centroids.radii[other]
        most = np.minimum.reduceat(d + rv, start)  # some centroid is no farther from any of the node's points
        slack = SLACK * (1 + d + rv + rc)
        keep = d - rv - rc - slack <= most[group] + slack
        seen["pairs"], seen["pruned"] = seen.get("pairs", 0) + len(keep), seen.get("pruned", 0) + int((~keep).sum())
        node, other, group = node[keep], other[keep], group[keep]
        split_c = (centroids.child_to[other] > 0) & ((centroids.radii[other] >= vectors.radii[node]) | (vectors.child_to[node] == 0))
        many = np.bincount(group, minlength=len(nodes))
        inner = np.bincount(group, centroids.child_to[other] > 0, len(nodes)) > 0
        waits = np.bincount(group, split_c, len(nodes)) > 0  # some of its centroid nodes are split first
        alone = (many == 1) & ~inner & (centroids.point_to[other[np.searchsorted(group, np.arange(len(nodes)))]] - centroids.point_from[other[np.searchsorted(group, np.arange(len(nodes)))]] == 1)
        leaf = ~waits & ~alone & (vectors.child_to[nodes] == 0)
        for g in np.flatnonzero(alone):
            c = int(number[centroids.point_from[other[np.searchsorted(group, g)]]])
            whole.append((c, int(nodes[g])))
            out[vectors.point_from[nodes[g]] : vectors.point_to[nodes[g]]] = c
        for g in np.flatnonzero(leaf):
            mine = other[np.searchsorted(group, g) : np.searchsorted(group, g, "right")]
            places, _ = _spread(centroids.point_from[mine], centroids.point_to[mine])
            places = places[np.argsort(number[places])]  # ties go to the smaller number
            own = slice(vectors.point_from[nodes[g]], vectors.point_to[nodes[g]])
            seen["exact"] = seen.get("exact", 0) + (own.stop - own.start) * len(places)
            out[own] = number[places][squared(vectors.points[own], centroids.points[places]).argmin(1)]
        on = waits[group]
        far, of = _spread(centroids.child_from[other[on & split_c]], centroids.child_to[other[on & split_c]])
        stay = on & ~split_c
        down = ~(waits | alone | leaf)[group]
        below, from_ = _spread(vectors.child_from[node[down]], vectors.child_to[node[down]])
        node, other = np.concatenate([node[on & split_c][of], node[stay], below]), np.concatenate([far, other[stay], other[down][from_]])
        by = np.lexsort((other, node))
        node, other = node[by], other[by]
    return out, whole


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integers v of each vector that counts."""
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    held = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.lit(float(scale)) * x.cast("double")))
    rows = vectors.where((F.size(e) == dims) & finite)
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(held(x)).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest digests: k rows on the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in rows.orderBy(digest, "v").limit(k).select("v").collect()], np.int64)


def blocks(rows: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """The vectors in blocks, each with its cover tree, points as narrow as they fit."""

    def packed(ids: np.ndarray, points: np.ndarray):
        tree = cover_tree(points)
        width = next(w for w in (1, 2, 4) if np.abs(points).max() < 1 << 8 * w - 1)
        arrays = [ids[tree.order].tobytes(), tree.points.astype(f"<i{width}").tobytes(), width, *(x.tobytes() for x in (tree.centres, tree.radii, tree.child_from, tree.child_to, tree.point_from, tree.point_to))]
        names = ["ids", "points", "width", "centres", "radii", "child_from", "child_to", "point_from", "point_to"]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in arrays], names=names)

    def run(batches):
        ids, points = np.zeros((0, 2), np.int64), np.zeros((0, dims), np.int32)
        for batch in batches:
            own = np.stack([batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)], 1)
            ids = np.concatenate([ids, own])
            points = np.concatenate([points, batch.column(1).flatten().to_numpy().reshape(-1, dims)])
            while len(ids) >= block:
                yield packed(ids[:block], points[:block])
                ids, points = ids[block:], points[block:]
        if len(ids):
            yield packed(ids, points)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _trees(batches, dims: int):
    """The blocks of batches: ids, whether each is null, and the cover tree."""
    whole = lambda x: np.frombuffer(x, np.int64)
    for batch in batches:
        for ids, points, width, centres, radii, *spans in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
            ids, points = whole(ids).reshape(-1, 2), np.frombuffer(points, f"<i{width}").reshape(-1, dims).astype(np.int64)
            yield ids, CoverTree(points, np.arange(len(ids)), whole(centres), np.frombuffer(radii), *map(whole, spans))


def moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that has vectors goes to the floor of their mean."""
    dims, tree = centroids.shape[1], cover_tree(centroids, 1)

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, block in _trees(batches, dims):
            own, whole = dual_assign(block, tree)
            taken = np.zeros(len(own), bool)
            for c, node in whole:
                at = slice(block.point_from[node], block.point_to[node])
                taken[at] = True
                n[c] += at.stop - at.start
                sums[c] += block.points[at].sum(0)
            n += np.bincount(own[~taken], minlength=len(n))
            np.add.at(sums, own[~taken], block.points[~taken])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = held.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    new = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():  # k * dims rows
        new[r.cluster, r.dim] = int(r.total) // r.n
    return new


def assigned(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    dims, tree = centroids.shape[1], cover_tree(centroids, 1)

    def run(batches):
        for ids, block in _trees(batches, dims):
            own, _ = dual_assign(block, tree)
            distance = ((block.points - centroids[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0], mask=ids[:, 1] == 1), pa.array(own, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return held.mapInArrow(run, "vec_id long, cluster int, distance long")


def lloyd(vectors: DataFrame, k: int = CENTROIDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, rounds: int = ROUNDS, **columns) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    rows = kept(small_batches(vectors), dims=dims, scale=scale, **columns)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    held = written(blocks(rows, dims), "blocks")
    for _ in range(rounds):
        centroids = moved(held, centroids)
    found = written(assigned(held, centroids), "assigned")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    long = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, long(x), long(sum(sums.values())), digests[c]) for c, x in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql(k: int = CENTROIDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, rounds: int = ROUNDS) -> str:
    nearest = lambda r: f"(SELECT vec_id, v, c, d FROM (SELECT e.vec_id, e.v, m.c, list_sum([(e.v[i] - m.v[i]) * (e.v[i] - m.v[i]) FOR i IN range(1, {dims + 1})])::BIGINT AS d, row_number() OVER (PARTITION BY e.n ORDER BY d, m.c) AS q FROM e CROSS JOIN m{r} m) WHERE q = 1)"
    parts = [f"e AS MATERIALIZED (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v, row_number() OVER () AS n FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"]
    parts.append(f"m0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INT AS c, v FROM e ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})")
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED {nearest(r)}")
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(z.v, m.v) AS v FROM m{r} m LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY c, i) GROUP BY c) z ON m.c = z.c)")
    parts.append(f"f AS MATERIALIZED {nearest(rounds)}")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, f.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM f JOIN m{rounds} m ON f.c = m.c"


LLOYD_SQL = _lloyd_sql()
