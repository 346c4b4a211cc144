"""Exact k-means with Hamerly's bounds (operator 12).

Vectors are integers and stay where they are: each round is one pass over a stored table that holds, with every vector, its centroid, an
upper bound on the distance to it and a lower bound on the distance to any other. Bounds are loosened by how far the centroids moved; a
vector whose upper bound stays below its lower bound (or below half the distance from its centroid to the nearest other) keeps its
centroid unseen. The others are measured against all centroids in exact integers. Bounds are doubles with a margin for rounding, so that
they decide only what is certain; ties are always measured.

A round writes the next table and drops the one before. Sums of centroids are kept by the driver and corrected by the vectors that moved
only: whole numbers, added up by Spark in limbs of 32 bits, so they have no bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.sources.scratch import Scratch

#: Vectors taken at once.
ROWS = 4096
#: Components up to which squared distances of 64 components are exact as doubles, and fit a long.
PLAIN, WIDE = 2.0**22, 2.0**26
#: Room for rounding in the bounds.
SLACK = 1e-9


@dataclass(frozen=True)
class ClusterParams:
    """``clusters``, ``rounds`` and ``dim`` of the vectors; ``scale``: components are floor(scale * x); ``seed``: goes into the ids' hashes."""

    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    seed: int = 3


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long, or as Python integers if one is larger than ``WIDE``."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not len(x) or np.abs(scaled).max() <= WIDE:
        return scaled.astype(np.int64)
    flat = [int(s) if math.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist())]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def squared(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, a row for each vector: longs, or Python integers where longs might not do."""
    largest = max((abs(c) for row in centroids for c in row), default=0)
    if vectors.dtype == object or largest > WIDE or vectors.shape[1] > 256:
        return np.stack([((vectors.astype(object) - c) ** 2).sum(axis=1) for c in np.array(centroids, object)], axis=1)
    other = np.array(centroids, np.int64)
    if len(vectors) and max(largest, np.abs(vectors).max()) <= PLAIN and vectors.shape[1] <= 64:
        a, b = vectors.astype(float), other.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in other], axis=1)


def bound(d: np.ndarray, upper: bool) -> np.ndarray:
    """A double not below (``upper``) or not above the square root of each exact squared distance."""
    if d.dtype != object:
        return np.sqrt(d.astype(float)) * (1 + SLACK if upper else 1 - SLACK)
    most = 1 << 1000
    roots = [(float(math.isqrt(v) + 1) * (1 + SLACK) if v < most else math.inf) if upper else float(math.isqrt(min(v, most))) * (1 - SLACK) for v in d.ravel().tolist()]
    return np.array(roots, float).reshape(d.shape)


class Round:
    """A round's centroids, how far each moved at most, and half its distance to the nearest other at least."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        own = np.array(centroids, object)
        apart = squared(own, centroids)
        far = bound(apart, False)
        np.fill_diagonal(far, math.inf)
        self.centroids, self.first = centroids, before is None
        self.half = far.min(axis=1) / 2
        moved = bound(np.array([sum((x - y) ** 2 for x, y in zip(c, b)) for c, b in zip(centroids, before or centroids)], object), True)
        self.moved = np.where([c == b for c, b in zip(centroids, before or centroids)], 0.0, moved)
        others = np.repeat(self.moved[None, :], len(moved), axis=0)
        np.fill_diagonal(others, 0.0)
        self.others = others.max(axis=1)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, upper and lower bound of each vector from those of the round before."""
        cluster = cluster.copy()
        if self.first:
            todo = np.arange(len(vectors))
        else:
            upper = (upper + self.moved[cluster]) * (1 + SLACK)
            lower = lower - self.others[cluster]
            lower = np.where(lower > 0, lower * (1 - SLACK), -math.inf)
            least = np.maximum(lower, self.half[cluster])
            todo = np.flatnonzero(~(upper < least))
            for c in np.unique(cluster[todo]):  # tighten the upper bound first
                at = todo[cluster[todo] == c]
                upper[at] = bound(squared(vectors[at], [self.centroids[c]])[:, 0], True)
            todo = todo[~(upper[todo] < least[todo])]
        if len(todo):
            d = squared(vectors[todo], self.centroids)
            best = d.argmin(axis=1).astype(np.int64)
            rows = np.arange(len(todo))
            cluster[todo], upper[todo] = best, bound(d[rows, best], True)
            far = bound(d, False)
            far[rows, best] = math.inf
            lower[todo] = far.min(axis=1)
        return cluster, upper, lower


_STATE = "vec_id long, x {kind}, cluster int, before int, upper double, lower double"


def _vectors(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), dim)


def _assign(shared, dim: int, scale: int):
    """The state's rows after a round's assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                before, upper, lower = (part.column(c).to_numpy().copy() for c in ("cluster", "upper", "lower"))
                cluster, upper, lower = shared.value.assign(whole(_vectors(part.column("x"), dim), scale), before, upper, lower)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "x", "cluster", "before", "upper", "lower"])

    return run


def _limbs(v: int) -> list[int]:
    """v as a sum of limbs times powers of 2^32; all but the last are from 0 to 2^32 - 1."""
    out = []
    while not -(1 << 31) <= v < 1 << 31:
        out.append(v & 0xFFFFFFFF)
        v >>= 32
    return [*out, v]


def _sums(dim: int, scale: int):
    """(cluster, place, limb, total) of the vectors that came to a cluster less those that left it; place ``dim`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                vectors = whole(_vectors(part.column("x"), dim), scale)
                for name, sign in (("cluster", 1), ("before", -1)):
                    owner = part.column(name).to_numpy()
                    for c in np.unique(owner[owner >= 0]).tolist():
                        own = vectors[owner == c]
                        for i, v in enumerate([*own.sum(axis=0).tolist(), len(own)]):
                            rows += [(c, i, j, x) for j, x in enumerate(_limbs(sign * v))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["cluster", "place", "limb", "total"])

    return run


def _distances(shared, dim: int, scale: int):
    """(vec_id, cluster, distance) with exact squared distances, null beyond a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                vectors, cluster, distance = whole(_vectors(part.column("x"), dim), scale), part.column("cluster").to_numpy(), [None] * part.num_rows
                for c in np.unique(cluster).tolist():
                    at = np.flatnonzero(cluster == c)
                    for i, d in zip(at.tolist(), squared(vectors[at], [shared.value.centroids[c]])[:, 0].tolist()):
                        distance[i] = d if d < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("cluster"), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def usable(column: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none of them null or not finite."""
    number = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(math.inf))
    return F.coalesce((F.size(column) == dim) & F.forall(column, number), F.lit(False))


def k_means(vectors: DataFrame, params: ClusterParams = ClusterParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector after the last assignment.

    Centroids start as the vectors whose ``<seed>:<id>`` has the smallest SHA-256; of rows with equal ids the one whose vector sorts first
    comes first, and a repeated row is a vector of its own; a null id sorts last and its row is clustered like others. A vector goes to the
    nearest centroid, of equals to the smaller number; a round replaces each centroid that has vectors by the floor of their mean. With
    fewer vectors than clusters there are as many centroids as vectors. Components may be any finite numbers: distances are exact, null
    where a long cannot hold one, and so are their sums. Vectors of another length, null, or with a component that is null or not finite
    take no part; other columns take no part; an empty table gives an empty result.
    """
    p, spark = params, vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    x = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(usable(F.col("x"), p.dim))
    base = base.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(math.inf).alias("upper"), F.lit(-math.inf).alias("lower"))
    kind = _STATE.format(kind=base.schema["x"].dataType.simpleString())
    keep = Scratch(spark)
    name = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = base.select("x", name.alias("name")).orderBy(F.asc_nulls_last("name"), "x").limit(p.clusters).collect()
    if not seeds:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [[int(v) for v in whole(np.array(r["x"], float), p.scale).tolist()] for r in seeds]
    before, state, sums = None, base, [[0] * (p.dim + 1) for _ in centroids]
    for i in range(p.rounds + 1):
        now = spark.sparkContext.broadcast(Round(centroids, before))  # as large as the centroids
        state = keep.put(f"state{i}", state.mapInArrow(_assign(now, p.dim, p.scale), kind))
        keep.drop(f"state{i - 1}")
        if i == p.rounds:
            break
        moved = state.where("cluster <> before").select("cluster", "before", "x").mapInArrow(_sums(p.dim, p.scale), "cluster long, place long, limb long, total long")
        for r in moved.groupBy("cluster", "place", "limb").agg(F.sum("total").alias("total")).collect():  # some rows for each component of a centroid
            sums[r["cluster"]][r["place"]] += r["total"] << 32 * r["limb"]
        before, centroids = centroids, [[v // s[-1] for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids)]
    found = keep.put("distances", state.mapInArrow(_distances(now, p.dim, p.scale), "vec_id long, cluster int, distance long"))
    keep.drop(f"state{p.rounds}")
    whole_sum = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("long"))
    by = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(whole_sum.alias("total")).collect()}  # a row for each centroid
    every = sum(by.values()) if None not in by.values() else None
    inertia = F.get(F.array(*[F.lit(by.get(c, 0)).cast("long") for c in range(len(centroids))]), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(F.col("vec_id").alias(id_col), "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(every if every is not None and every < 1 << 63 else None).cast("long").alias("inertia"), F.get(F.lit(digests), F.col("cluster")).alias("centroid_sha256"))


def k_means_sql(params: ClusterParams = ClusterParams()) -> str:
    """The result of ``k_means`` on a view ``embeddings``, for components whose distances fit a long."""
    p = params
    distance = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding, list_transform(embedding, lambda y: CAST(floor({p.scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {p.dim} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || vec_id) NULLS LAST, embedding) - 1 AS n, x FROM v QUALIFY n < {p.clusters})",
    ]
    for i in range(p.rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT row, vec_id, v.x, arg_min(c.n, (d, c.n)) AS n, min(d) AS d FROM (SELECT v.*, c.n AS cn, {distance} AS d FROM v, c{i} AS c) AS v JOIN c{i} AS c ON c.n = cn GROUP BY ALL)")
        if i < p.rounds:
            ctes.append(f"m{i} AS (SELECT n, place, CAST(floor(sum(y)::HUGEINT // count(*)) AS BIGINT) - CASE WHEN sum(y) < 0 AND sum(y)::HUGEINT % count(*) <> 0 THEN 1 ELSE 0 END AS y FROM (SELECT n, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY n, place)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN (SELECT n, list(y ORDER BY place) AS x FROM m{i} GROUP BY n) AS m USING (n))")
    last = p.rounds
    return f"WITH {', '.join(ctes)} SELECT vec_id, CAST(n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} AS c USING (n)"
