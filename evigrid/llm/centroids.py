"""Centroid clustering of vectors in exact integers, with a vantage-point tree over the centroids.

Components become floor(SCALE * x). The first K centroids are the vectors with the smallest sha256 of "SEED:<id>". Each round gives every vector to its
nearest centroid (squared Euclidean distance, then the smaller number) and moves every centroid that has vectors to floor(sum / count) of each component.
After the last round vectors are assigned once more.

1. The integer vectors are a written table that each round scans once; nothing is shuffled but one row of sums per task and centroid.
2. The K centroids come to the driver, which builds a vantage-point tree over them and broadcasts it: K times the dimension is the bound of
   what is collected and broadcast. A node holds a vantage centroid and two children, near and far, each with the range of its
   centroids' distances from the vantage; a leaf holds a few centroids.
3. Each vector searches best-first: of its open nodes it takes the one with the smallest lower bound and stops when that bound is beyond its best
   distance. The pruning radius is inclusive and bounds are rounded down, so a centroid at the same distance with a smaller number is
   always met; only distances at leaves and vantages decide, and they are integers. Vectors of a batch take their steps together in numpy, a step for
   the vectors at one node at a time.
4. Sums are added per task in 64 bits and over tasks in decimals, so that results don't depend on the partitions. Rounds end early
   only if no centroid moved, as all further rounds would be the same.

Defined cases: only vectors with exactly DIMS components, none of them null, NaN, infinite or of 2^27 or more in size after scaling, are clustered;
others have no row. Up to that size distances fit 64 bits. Rows that repeat an id are vectors of their own; among the first centroids they are
in the order of their components. A null id counts as an empty one for the hash. Fewer than K vectors make fewer centroids; none, an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
LIMIT = 1 << 27
LEAF = 2
#: Open-node bounds held at once: vectors of a step times nodes of the tree
BOUNDS = 1 << 22


@dataclass
class Tree:
    """Nodes of a vantage-point tree: a vantage (-1 in leaves), the centroids of leaves, and children as (node, low, high)."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    leaf: list[list[int]] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)

    @staticmethod
    def over(centroids: np.ndarray, leaf: int = LEAF) -> Tree:
        tree = Tree(centroids)
        root = tree._add()
        todo = [(root, list(range(len(centroids))))]
        while todo:
            node, members = todo.pop()
            if len(members) <= leaf:
                tree.leaf[node] = members
                continue
            # the member farthest from the first one sees the others at the most different distances
            first = centroids[members] - centroids[members[0]]
            vantage = members.pop(int(np.argmax((first * first).sum(1))))
            away = np.sqrt(((centroids[members] - centroids[vantage]) ** 2).sum(1).astype(np.float64))
            order = np.argsort(away, kind="stable")
            tree.vantage[node] = vantage
            for half in np.array_split(order, 2):
                if len(half):
                    child = tree._add()
                    tree.children[node].append((child, float(away[half].min()), float(away[half].max())))
                    todo.append((child, [members[i] for i in half]))
        return tree

    def _add(self) -> int:
        self.vantage.append(-1)
        self.leaf.append([])
        self.children.append([])
        return len(self.vantage) - 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centroid and the squared distance."""
        number, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        step = max(1, BOUNDS // len(self.vantage))
        for first in range(0, len(x), step):
            last = first + step
            number[first:last], best[first:last] = self._search(x[first:last])
        return number, best

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        number, best = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        bound = np.full((n, len(self.vantage)), np.inf)
        bound[:, 0] = 0
        alive = np.arange(n)
        while len(alive):
            node = bound[alive].argmin(1)
            lowest = bound[alive, node]
            open_ = np.isfinite(lowest) & (lowest <= np.sqrt(best[alive].astype(np.float64)))
            alive, node, lowest = alive[open_], node[open_], lowest[open_]
            for at in np.unique(node).tolist():
                here = node == at
                rows = alive[here]
                bound[rows, at] = np.inf
                for c in self.leaf[at]:
                    self._meet(x, rows, c, number, best)
                if self.vantage[at] >= 0:
                    away = np.sqrt(self._meet(x, rows, self.vantage[at], number, best).astype(np.float64))
                    for child, low, high in self.children[at]:
                        # rounded down: a bound never exceeds the true distance
                        bound[rows, child] = np.maximum(lowest[here], np.maximum(away - high, low - away) - 1e-9 * (away + high) - 1e-9)
        return number, best

    def _meet(self, x: np.ndarray, rows: np.ndarray, c: int, number: np.ndarray, best: np.ndarray) -> np.ndarray:
        gap = x[rows] - self.centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        better = (d < best[rows]) | (d == best[rows]) & (c < number[rows])
        best[rows[better]], number[rows[better]] = d[better], c
        return d


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that can be clustered, as integers."""
    x = F.col("embedding").cast("array<double>")
    inside = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < LIMIT - 1), F.lit(False)))
    return vectors.where((F.size("embedding") == dims) & inside).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(tree, dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value.centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            number, _ = tree.value.nearest(x)
            order = np.argsort(number, kind="stable")
            present, at, sizes = np.unique(number[order], return_index=True, return_counts=True)
            if len(present):
                count[present] += sizes
                total[present] += np.add.reduceat(x[order], at, 0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "total"])
    return add


def _labels(tree, dims: int, names: list[str]):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, best = tree.value.nearest(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(best)], names)
    return label


def trained_centroids(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> np.ndarray:
    """The centroids after the rounds, a row each."""
    spark = rows.sparkSession
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(code, "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(Tree.over(centroids))
        parts = rows.select("v").mapInArrow(_sums(tree, dims), "cluster int, n long, total array<long>")
        spread = parts.select("cluster", "n", F.posexplode("total").alias("i", "s"))
        moved = centroids.copy()
        # at most k * dims rows
        for r in spread.groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            moved[r.cluster, r.i] = int(r.s) // int(r.n)
        tree.unpersist()
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance."""
    tree = rows.sparkSession.sparkContext.broadcast(Tree.over(centroids))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(_labels(tree, dims, ["vec_id", "cluster", "distance"]), f"vec_id {kind}, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that can be clustered."""
    rows = settled(integer_vectors(vectors, dims, scale))
    centroids = trained_centroids(rows, k, rounds, seed, dims)
    if not len(centroids):
        return rows.select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    out = settled(assigned(rows, centroids, dims))
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: list, kind: str):
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    return out.withColumns({
        "cluster_inertia": by_cluster([sums.get(c, 0) for c in range(len(centroids))], "long"), "inertia": F.lit(sum(sums.values())).cast("long"),
        "centroid_sha256": by_cluster(digests, "string")})


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """The same clustering with a block of common tables for each round: all distances in rows."""
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT rid, vec_id, unnest(range(64)) AS i, floor(1024 * unnest(e)::DOUBLE)::BIGINT AS x FROM kept),
starts AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM starts JOIN v USING (rid))"""]
    nearest = """
d{r} AS (SELECT v.rid, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
    move = """
m{r} AS (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN v USING (rid) GROUP BY ALL),
c{t} AS MATERIALIZED (
  SELECT o.c, o.i, CASE WHEN m.n IS NULL THEN o.x ELSE ((m.s - ((m.s % m.n + m.n) % m.n)) // m.n)::BIGINT END AS x
  FROM c{r} o LEFT JOIN m{r} m ON m.c = o.c AND m.i = o.i)"""
    for r in range(rounds):
        parts += [nearest.format(r=r), move.format(r=r, t=r + 1)]
    parts += [nearest.format(r=rounds), f"""
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)"""]
    return ",".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN h USING (c)"""


SQL = _sql()
