"""Nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stopping test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from foldgraph.llm.common import list_column, stream_groups

#: Scores closer than this are compared exactly before any is left out.
CLOSE = 1e-9


def chi_square_point(p: float, degrees: int) -> float:
    """The value that a chi-square variable stays below with probability ``p``, by bisection of its series."""

    def below(x: float) -> float:
        half, a = x / 2, degrees / 2
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-15 * total:
            k += 1
            term *= half / k
            total += term
        return float(total * np.exp(a * np.log(half) - half - _log_gamma(a)))

    low, high = 1e-9, degrees + 20 * np.sqrt(2.0 * degrees) + 50
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def _log_gamma(a: float) -> float:
    import math

    return math.lgamma(a)


class ProjectedTree:
    """A kd-tree over projections of vectors, in leaves of about ``leaf`` points.

    Maximum inner product becomes nearest distance by one more coordinate,
    which makes all points equally long; queries are scaled to that length.
    Random Gaussian projections are 2-stable: the squared projected distance
    over the squared distance is chi-square with as many degrees as there are
    projections.
    """

    def __init__(self, vectors: np.ndarray, norm: float, projections: int, leaf: int, seed: int):
        n, dim = vectors.shape
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        self.base = np.random.default_rng(seed).standard_normal((dim + 1, projections))
        points = vectors @ self.base[:-1] + rest[:, None] * self.base[-1]
        order, leaves, stack = np.arange(n), [], [(0, n)]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                leaves.append((a, b))
                continue
            part = points[order[a:b]]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
            stack += [(a, a + half), (a + half, b)]
        self.order, self.leaves = order, leaves
        boxed = points[order]
        self.low = np.stack([boxed[a:b].min(axis=0) for a, b in leaves])
        self.high = np.stack([boxed[a:b].max(axis=0) for a, b in leaves])
        self.vectors, self.norm = vectors, norm

    def search(self, queries: np.ndarray, k: int, sure: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of every candidate that may be among the ``k`` best.

        Each query visits leaves by the distance of their boxes in the
        projection and verifies the points of each by their inner product. It
        stops at the first leaf so far away that a point closer than its
        ``k``-th best would have been projected nearer with probability
        ``sure``. ``own`` is the place of a query's own point, or -1.
        """
        m = len(queries)
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        scaled = queries * (self.norm / lengths)[:, None]
        projected = scaled @ self.base[:-1]
        gap = np.maximum(np.maximum(self.low[None] - projected[:, None], projected[:, None] - self.high[None]), 0.0)
        far = np.einsum("qlm,qlm->ql", gap, gap)
        visit = np.argsort(far, axis=1)
        stop = chi_square_point(sure, self.base.shape[1])
        place = np.empty(len(self.order), dtype=np.int64)
        place[self.order] = np.arange(len(self.order))
        own_at = np.where(own >= 0, place[own], -1)
        best = np.full((m, k), -np.inf)  # inner products with the scaled query
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = np.arange(m)
        for turn in range(len(self.leaves)):
            nearest = far[active, visit[active, turn]]
            kth = best[active, 0]
            squared = np.where(np.isfinite(kth), np.maximum(2 * self.norm * self.norm - 2 * kth, 0.0), np.inf)
            active = active[nearest <= stop * squared]
            if not len(active):
                break
            leaf_of = visit[active, turn]
            by_leaf = np.argsort(leaf_of, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf_of[by_leaf])) + 1
            for group in np.split(by_leaf, cuts):
                rows = active[group]
                a, b = self.leaves[int(leaf_of[group[0]])]
                scores = scaled[rows] @ self.vectors[self.order[a:b]].T
                mine = (own_at[rows] >= a) & (own_at[rows] < b)
                scores[np.flatnonzero(mine), own_at[rows][mine] - a] = -np.inf
                q, p = np.nonzero(scores >= best[rows, :1] - CLOSE * self.norm * self.norm)
                finite = np.isfinite(scores[q, p])
                q, p = q[finite], p[finite]
                found.append((rows[q], self.order[a + p], scores[q, p]))
                both = np.concatenate([best[rows], scores], axis=1)
                best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                best[rows, 0] = best[rows].min(axis=1)
                best[rows] = np.sort(best[rows], axis=1)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        q, p, s = (np.concatenate(x) for x in zip(*found))
        good = s >= best[q, 0] - CLOSE * self.norm * self.norm
        return q[good], p[good]


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def nearest(
    vectors: DataFrame, *, every: int = 20, k: int = 20, key: str = "vec_id", column: str = "embedding", rows_per_block: int = 8192,
    projections: int = 8, leaf: int = 512, sure: float = 0.95, seed: int = 1,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its ``k`` nearest other rows.

    Nearness is the inner product in double precision, of the vectors as given;
    ties go to the smaller id. Every row is indexed: rows are dealt by a hash
    to blocks of about ``rows_per_block``, each block has its own tree, and
    blocks of queries meet blocks of rows, so what one task holds is bounded.
    Only the largest length and the commonest dimension come to the driver.

    Rows with a null id, a null, empty or zero vector, a null or non-finite
    component, or another dimension than most, take no part. An id is a row's
    name: rows that repeat an id with the same vector count once, and a query
    never finds its own id. Of many rows with one vector, the ``k + 1``
    smallest ids of a block suffice and the others cannot be among the ``k``.
    Queries with fewer candidates than ``k`` return all. Other columns are not read.
    """
    rows = usable(vectors, key, column)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")
    ).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema)
    norm, blocks = float(np.sqrt(shape.longest)), max(1, shape.n // rows_per_block)
    query_blocks = max(1, shape.n // every // rows_per_block)
    rows = rows.where(F.size("v") == shape.dim).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = (
        rows.where(F.col("vec_id") % every == 0)
        .withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(query_blocks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    indexed = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    cells = asked.select("block", "part", F.lit(True).alias("asks"), "vec_id", "v").unionByName(
        indexed.select("block", "part", F.lit(False).alias("asks"), "vec_id", "v")
    )
    cells = cells.repartition(blocks * query_blocks, "block", "part").sortWithinPartitions("block", "part", "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in stream_groups(batches, "block", "part"):
            ids = cell.column("vec_id").to_numpy()
            asks = cell.column("asks").to_numpy(zero_copy_only=False)
            data = list_column(cell, "v")[1].reshape(len(ids), -1)
            first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (data[1:] != data[:-1]).any(axis=1) | (asks[1:] != asks[:-1])]) if len(ids) else asks
            ids, asks, data = ids[first], asks[first], data[first]
            points, point_ids = data[~asks], ids[~asks]
            queries, query_ids = data[asks], ids[asks]
            if not len(points) or not len(queries):
                continue
            # Of equal vectors the k + 1 smallest ids are enough (ids ascend).
            _, same = np.unique(points, axis=0, return_inverse=True)
            by = np.argsort(same.ravel(), kind="stable")
            run_start = np.concatenate([[0], np.flatnonzero(np.diff(same.ravel()[by])) + 1])
            nth = np.arange(len(by)) - np.repeat(run_start, np.diff([*run_start, len(by)]))
            stay = np.sort(by[nth <= k])
            points, point_ids = points[stay], point_ids[stay]
            tree = ProjectedTree(points, norm, projections, leaf, seed)
            at = np.minimum(np.searchsorted(point_ids, query_ids), len(point_ids) - 1)
            own = np.where(point_ids[at] == query_ids, at, -1)
            for a in range(0, len(queries), 1024):
                q, p = tree.search(queries[a : a + 1024], k, sure, own[a : a + 1024])
                other = point_ids[p] != query_ids[a + q]
                q, p = q[other], p[other]
                score = (queries[a + q] * points[p]).sum(axis=1)
                order = np.lexsort((point_ids[p], -score, q))
                q, p, score = q[order], p[order], score[order]
                start = np.searchsorted(q, q, side="left")
                top = np.arange(len(q)) - start < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[a + q[top]]), pa.array(point_ids[p[top]]), pa.array(score[top])], names=["query_id", "vec_id", "score"]
                )

    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
