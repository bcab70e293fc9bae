"""Clusters of vectors by Lloyd's rounds, with a tree over the vectors and one over the centroids.

Vectors become integers (``floor(SCALE * x)``). A task's vectors, those of one start centroid next to each other, are cut into blocks, and each block's distinct vectors
make a cover tree: by farthest-first order, the points that come before distance ``2 ** l`` are a net of that width, and a point hangs below the nearest one of the next
wider net. Blocks and their trees are written once. In each round the centroids make a tree of the same kind, and pairs of nodes go down both trees: a pair is
dropped if the bounds on its distances show that another centroid is nearer to all vectors below, strictly. A node of which one centroid is left is
assigned with all below it by its stored sum; pairs of single vectors and centroids are compared exactly, in integers.
Spark adds the sums of all blocks, and only the centroids reach the driver.

* Rows whose vector is null, hasn't exactly ``dims`` components, or holds null or non-finite ones are dropped.
* Ties go to the smaller number; equal centroids never lose a vector to a higher number. Clusters without vectors keep their centroid.
* Rows with equal ids are rows of their own and may both start a centroid (in order of their vectors); rows with a null id start one only if there are too few others.
* Fewer vectors than clusters give fewer clusters. An empty table gives an empty table. Only the id and vector columns are read.
* Components beyond ``2 ** 27 / SCALE`` raise an error, as squared distances would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored
from newsloom.llm.vectors import floors, matrices, named, whole

SCALE, DIMS, CLUSTERS, ROUNDS = 256, 64, 40, 5
#: Vectors of a block, and how many a task holds to sort them into blocks.
BLOCK, HELD = 1024, 32_768


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    x = a - b
    return np.einsum("ij,ij->i", x, x)


@dataclass
class Tree:
    """A cover tree over distinct points in farthest-first order. Node k stands for point k and all below it, node m + k for point k alone."""

    points: np.ndarray
    parent: np.ndarray
    radius: np.ndarray

    def __post_init__(self) -> None:
        m = len(self.points)
        order = np.argsort(self.parent, kind="stable")
        order = order[self.parent[order] >= 0]
        n = np.bincount(self.parent[order], minlength=m)
        self.size, self._order, self._n, self._at = m, order, n, np.cumsum(n) - n
        self.leaf = np.concatenate([n == 0, np.ones(m, bool)])
        self.point = np.concatenate([np.arange(m), np.arange(m)])
        self.reach = np.concatenate([self.radius, np.zeros(m)])

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes that aren't leaves, their points alone among them, and the place in ``nodes`` each came from."""
        n = self._n[nodes]
        origin = np.repeat(np.arange(len(nodes)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        below = self._order[self._at[nodes][origin] + inside]
        below = np.where(self._n[below] == 0, below + self.size, below)
        return np.concatenate([nodes + self.size, below]), np.concatenate([np.arange(len(nodes)), origin])


def cover_tree(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of distinct points, and the place of each of them in ``x``."""
    m = len(x)
    order, parent = np.zeros(m, np.int64), np.full(m, -1)
    level = np.full(m, np.iinfo(np.int64).max)
    near = squared(x, x[:1])
    for k in range(1, m):
        p = int(near.argmax())
        order[k] = p
        level[k] = (int(near[p]).bit_length() - 1) // 2  # floor of the base-2 logarithm of the distance
        d = squared(x, x[p : p + 1])
        wider = np.flatnonzero(level[:k] > level[k])
        parent[k] = wider[d[order[wider]].argmin()]
        near = np.minimum(near, d)
    points, radius = x[order], np.zeros(m)
    above, own = parent, np.arange(m)
    while (up := above >= 0).any():
        own, above = own[up], above[up]
        np.maximum.at(radius, above, np.sqrt(squared(points[above], points[own]).astype(np.float64)))
        above = parent[above]
    return Tree(points, parent, radius * (1 + 1e-12)), order


def assign(tree: Tree, centroids: Tree, number: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of ``tree`` with the number of the centroid that is nearest to all below each; each point is below one of them. ``number``: those of the points of ``centroids``."""
    root = lambda t: np.array([0 if not t.leaf[0] else t.size])
    q, c, done = root(tree), root(centroids), []
    while len(q):
        d2 = squared(tree.points[tree.point[q]], centroids.points[centroids.point[c]])
        d = np.sqrt(d2.astype(np.float64))
        rq, rc = tree.reach[q], centroids.reach[c]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        group = np.cumsum(np.diff(q, prepend=-1) != 0) - 1
        upper = np.minimum.reduceat(d + rq, first)[group]
        stay = d - rq - rc <= upper * (1 + 1e-9) + 1e-6
        q, c, d2, rq, rc = q[stay], c[stay], d2[stay], rq[stay], rc[stay]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        n = np.diff(np.append(first, len(q)))
        group = np.repeat(np.arange(len(first)), n)
        single = np.logical_and.reduceat(centroids.leaf[c], first)
        over = single & ((n == 1) | tree.leaf[q[first]])
        if over.any():
            ends = over[group]
            where, mine, dist, num = group[ends], q[ends], d2[ends], number[centroids.point[c[ends]]]
            best = np.lexsort((num, dist, where))
            lead = best[np.flatnonzero(np.diff(where[best], prepend=-1))]
            done.append((mine[lead], num[lead]))
            q, c, rq, rc, group = q[~ends], c[~ends], rq[~ends], rc[~ends], group[~ends]
            if not len(q):
                break
        # the wider of both sides is opened: the centroids' nodes of this node, or the node itself
        widest = np.zeros(int(group[-1]) + 1)
        np.maximum.at(widest, group, rc)
        closed = np.ones(len(widest), bool)
        np.logical_and.at(closed, group, centroids.leaf[c])
        open_c = (tree.leaf[q] | (widest[group] >= rq)) & ~closed[group]
        keep = open_c & centroids.leaf[c]
        to_open = open_c & ~centroids.leaf[c]
        kids, origin = centroids.children(c[to_open])
        parts_q, parts_c = [q[keep], q[to_open][origin]], [c[keep], kids]
        if (~open_c).any():
            qs, at = np.unique(q[~open_c], return_inverse=True)
            lists = np.split(c[~open_c][np.argsort(at, kind="stable")], np.cumsum(np.bincount(at))[:-1])
            below, origin = tree.children(qs)
            parts_q.append(np.repeat(below, [len(lists[o]) for o in origin]))
            parts_c.append(np.concatenate([lists[o] for o in origin]))
        q, c = np.concatenate(parts_q), np.concatenate(parts_c)
        order = np.lexsort((c, q))
        q, c = q[order], c[order]
    return done


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("node", pa.binary()), ("points", pa.binary()), ("parent", pa.binary()), ("radius", pa.binary())])


def _blocks(vectors: DataFrame, start: np.ndarray, dims: int, scale: int) -> DataFrame:
    """Blocks of vectors with their trees: ids, the point of each id, and the tree."""

    def cut(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = np.array([squared(start, v[None]).argmin() for v in x])
        order = np.argsort(near, kind="stable")
        for a in range(0, len(x), BLOCK):
            rows = order[a : a + BLOCK]
            points, same = np.unique(x[rows], axis=0, return_inverse=True)
            tree, at = cover_tree(points)
            place = np.zeros(len(at), np.int64)
            place[at] = np.arange(len(at))
            columns = {"ids": [[ids[r] for r in rows]], "node": [place[same.ravel()].tobytes()], "points": [tree.points.astype(np.int32).tobytes()], "parent": [tree.parent.astype(np.int64).tobytes()], "radius": [tree.radius.tobytes()]}
            yield pa.RecordBatch.from_pydict(columns, schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for batch, x in matrices(batches, dims, scale):
            ids += batch.column(0).to_pylist()
            held.append(x)
            n += len(x)
            if n >= HELD:
                yield from cut(ids, np.concatenate(held))
                ids, held, n = [], [], 0
        if n:
            yield from cut(ids, np.concatenate(held))

    return vectors.select("id", "vector").mapInArrow(run, "ids array<long>, node binary, points binary, parent binary, radius binary")


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            node, points, parent, radius = (np.frombuffer(batch.column(n)[k].as_py(), t) for n, t in (("node", np.int64), ("points", np.int32), ("parent", np.int64), ("radius", np.float64)))
            yield batch.column("ids")[k].as_py(), node, Tree(points.reshape(-1, dims).astype(np.int64), parent, radius)


def _centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    distinct, number = np.unique(centroids, axis=0, return_index=True)  # the first of equal ones
    tree, at = cover_tree(distinct)
    return tree, number[at]


def _sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and the sum of each component."""
    k, dims = centroids.shape
    names = [f"s{j}" for j in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, number = _centroid_tree(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, node, tree in _trees(batches, dims):
            times = np.bincount(node, minlength=tree.size)
            count, sums = np.tile(times, 2), np.tile(tree.points * times[:, None], (2, 1))
            for j in range(tree.size - 1, 0, -1):  # a point comes after its parent
                count[tree.parent[j]] += count[j]
                sums[tree.parent[j]] += sums[j]
            for nodes, cluster in assign(tree, over, number):
                np.add.at(n, cluster, count[nodes])
                np.add.at(total, cluster, sums[nodes])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(at, pa.int32()), "n": n[at]} | {c: total[at, j] for j, c in enumerate(names)})

    each = blocks.mapInArrow(run, ", ".join(["cluster int, n long", *(f"{c} long" for c in names)]))
    return each.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def _members(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance of each vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, number = _centroid_tree(centroids)
        for ids, node, tree in _trees(batches, dims):
            given = np.full(2 * tree.size, -1)
            for nodes, cluster in assign(tree, over, number):
                given[nodes] = cluster
            for j in range(1, tree.size):  # a parent's comes down
                if given[tree.parent[j]] >= 0:
                    given[j] = given[tree.parent[j]]
            cluster = np.where(given[: tree.size] >= 0, given[: tree.size], given[tree.size :])
            distance = squared(tree.points, centroids[cluster])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "cluster": pa.array(cluster[node], pa.int32()), "distance": distance[node]})

    return blocks.mapInArrow(run, "id long, cluster int, distance long")


def cluster_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row that is kept."""
    vectors = named(table, id=id_column, vector=vector).withColumn("id", F.col("id").cast("long"))
    digest = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.where(whole(F.col("vector"), dims)).orderBy(F.asc_nulls_last(digest), "vector").limit(clusters).select("vector").collect()
    spark = table.sparkSession
    if not first:
        return spark.createDataFrame([], "a long, b int, c long, d long, e long, f string").toDF(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    centroids = floors(np.array([r[0] for r in first], np.float64), scale)
    blocks = stored(_blocks(vectors, centroids.copy(), dims, scale))
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _sums(blocks, centroids).toLocalIterator():
            cluster, n, *sums = r
            moved[cluster] = [s // n for s in sums]
        centroids = moved
    members = stored(_members(blocks, centroids))
    sums = {r["cluster"]: r["total"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    known = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # a row for each cluster
    return members.join(known, "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
