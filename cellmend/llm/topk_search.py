"""Exact top-k search by distributed histogram selection (operator 6).

Every vector is scored against a block of queries. A first pass counts scores in a histogram of equal bins for each query; the counts
of all tasks add up to the bin that holds the k-th best score, which the next pass divides again, until a bin is one value wide. A
last pass keeps the scores above the k-th value and, of those equal to it, the smallest ids that are still needed.

A task reports only bins that its own k best reach (the k-th best of all is never below the k-th best of a part), so a query costs a
task k rows at most, whatever ties there are. The queries are taken in blocks of bounded size, each a pass over the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.sources.scratch import shared_folder, stored

#: Queries of a pass and bins of a histogram.
BLOCK = 2048
BINS = 256
#: Vectors scored at once.
ROWS = 2048
#: Squared lengths up to which products of doubles are exact, and beyond which they take Python's integers.
PLAIN, LARGEST = 2.0**52, 2.0**62
#: The least score, and what stands for none.
LEAST, NONE = -(2**63) + 1, -(2**63)
#: Beyond PLAIN a component is cut into a multiple of HALF and a rest.
HALF = 65536.0


def scaled(column: str = "embedding", by: int = 256) -> Column:
    """floor(by * x) of each component, as double; null if the vector or a component is null, or one is not finite (by times as large)."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * by) != F.lit(float("inf"))))
    return F.when(F.col(column).isNotNull() & fine, F.transform(x, lambda v: F.floor(v * by).cast("double")))


def products(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """Exact integer products of the rows of a and b (of whole numbers), ``NONE`` where a long cannot hold one; ``plain``: no product
    reaches 2^53."""
    if plain:
        return (a @ b.T).astype(np.int64)
    with np.errstate(over="ignore"):
        large_a, large_b = ((x * x).sum(axis=1) >= LARGEST for x in (a, b))
    if large_a.any() or large_b.any():
        out = np.empty((len(a), len(b)), np.int64)
        out[np.ix_(~large_a, ~large_b)] = products(a[~large_a], b[~large_b], False)
        for rows, cols in ((large_a, np.ones(len(b), bool)), (~large_a, large_b)):
            whole_a, whole_b = ([[int(v) for v in r] for r in x.tolist()] for x in (a[rows], b[cols]))
            sums = [[sum(x * y for x, y in zip(r, c)) for c in whole_b] for r in whole_a]
            out[np.ix_(rows, cols)] = np.array([[v if LEAST <= v < 2**63 else NONE for v in r] for r in sums], np.int64).reshape(len(whole_a), len(whole_b))
        return out
    high_a, high_b = np.floor(a / HALF), np.floor(b / HALF)
    low_a, low_b = a - high_a * HALF, b - high_b * HALF
    whole = [(x @ y.T).astype(np.int64) for x, y in ((high_a, high_b), (high_a, low_b), (low_a, high_b), (low_a, low_b))]
    return (whole[0] << 32) + ((whole[1] + whole[2]) << 16) + whole[3]


def _scores(block: dict[int, tuple[np.ndarray, np.ndarray]], plain: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and integer scores (one row for each query of that dimension) of pieces of the batches; a query's own is -2^63."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids, lists = part.column(0).to_numpy(), part.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim, (query_ids, queries) in block.items():
                at = np.flatnonzero(sizes == dim)
                if not len(at):
                    continue
                vectors = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                scores = products(queries, vectors, plain)
                scores[query_ids[:, None] == ids[at][None, :]] = NONE
                yield dim, ids[at], scores


def _histogram(shared, k: int):
    """(query, bin, n) of the bins of each query's interval that the part's k best reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, plain, low, span, width, need = shared.value
        counts = {dim: np.zeros((len(ids), BINS), np.int64) for dim, (ids, _) in block.items()}
        for dim, _, scores in _scores(block, plain, batches):
            above = scores.view(np.uint64) - low[dim].view(np.uint64)[:, None]  # differences of longs, which may need 64 bits
            row, col = np.nonzero((scores >= low[dim][:, None]) & (above < np.uint64(span)))
            counts[dim] += np.bincount(row * BINS + (above[row, col] // np.uint64(width)).astype(np.int64), minlength=counts[dim].size).reshape(counts[dim].shape)
        for dim, table in counts.items():
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            row, col = np.nonzero((table > 0) & (above < need[dim][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(block[dim][0][row]), pa.array(np.full(len(row), dim)), pa.array(col), pa.array(table[row, col])], names=["query_id", "dim", "bin", "n"])

    return run


def _select(shared):
    """(query, id, score) above the k-th value, and the part's smallest ids at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, plain, low, need = shared.value
        ties: dict[tuple[int, int], np.ndarray] = {}
        for dim, ids, scores in _scores(block, plain, batches):
            row, col = np.nonzero(scores > low[dim][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(block[dim][0][row]), pa.array(ids[col]), pa.array(scores[row, col])], names=["query_id", "vec_id", "score"])
            row, col = np.nonzero((scores == low[dim][:, None]) & (need[dim][:, None] > 0))
            for i in np.unique(row).tolist():
                found = np.concatenate([ties.get((dim, i), ids[:0]), ids[col[row == i]]])
                ties[dim, i] = np.sort(found)[: need[dim][i]]
        rows = [(block[dim][0][i], v, low[dim][i]) for (dim, i), found in ties.items() for v in found]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[j]) for r in rows], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row its k best other rows by integer inner product of the scaled vectors.

    Ties go to the smaller id; a query with fewer candidates has all of them. Vectors that are null, or hold a null or non-finite
    component, and rows without id take no part; only vectors of the same length meet (empty ones score 0). Rows that share an id are
    never each other's candidates; a query repeated with the same vector is asked once, one repeated with another vector is asked with
    the vector that sorts first. Scores are exact for components of any size; a pair whose score does not fit a long has none and is left
    out, and a component that is not finite when scaled counts as not finite. An empty table gives an empty result; columns other than the two named and the query's take no part.
    """
    spark = vectors.sparkSession
    base = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(vector_col).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and x is not null").withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))
    asked = stored(base.where("asks").groupBy("vec_id").agg(F.min("x").alias("x")))
    total = asked.count()
    blocks = -(-total // BLOCK)
    norm = base.agg(F.max("norm")).first()[0] or 0.0
    plain_products = norm < PLAIN
    # the interval of all scores
    least, whole_span = (-int(norm) - 1, 2 * int(norm) + 3) if norm < LARGEST else (LEAST, 2**64 - 1)
    found, top = None, shared_folder(spark)
    plain = base.select("vec_id", "x")
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect() if blocks > 1 else asked.collect()  # about BLOCK rows
        block, low, need, known = {}, {}, {}, {}
        for dim in {len(r["x"]) for r in part}:
            own = [r for r in part if len(r["x"]) == dim]
            block[dim] = (np.array([r["vec_id"] for r in own]), np.array([r["x"] for r in own], float).reshape(len(own), dim))
            low[dim], need[dim] = np.full(len(own), least, np.int64), np.full(len(own), k, np.int64)
            known[dim] = {q: j for j, q in enumerate(block[dim][0].tolist())}
        span = whole_span  # of scores, from low on
        while True:
            width = -(-span // BINS)
            shared = spark.sparkContext.broadcast((block, plain_products, low, span, width, need))
            counts = plain.mapInArrow(_histogram(shared, k), "query_id long, dim long, bin long, n long").groupBy("query_id", "dim", "bin").agg(F.sum("n").alias("n"))
            place = Window.partitionBy("query_id", "dim").orderBy(F.desc("bin"))
            counts = counts.withColumn("upto", F.sum("n").over(place)).withColumn("above", F.col("upto") - F.col("n"))
            want = spark.createDataFrame([(q, dim, int(need[dim][j])) for dim in known for q, j in known[dim].items()], "query_id long, dim long, need long")
            hits = counts.join(F.broadcast(want), ["query_id", "dim"]).where("above < need").groupBy("query_id", "dim").agg(F.min_by("bin", F.col("bin")).alias("bin"), F.max("above").alias("above"), F.max("upto").alias("upto")).collect()
            for r in hits:  # one row for each query of the block
                j = known[r["dim"]][r["query_id"]]
                low[r["dim"]][j] = int(low[r["dim"]][j]) + r["bin"] * width
                need[r["dim"]][j] -= r["above"]
            shared.destroy()
            if width == 1:
                break
            span = width
        shared = spark.sparkContext.broadcast((block, plain_products, low, need))
        found = plain.mapInArrow(_select(shared), "query_id long, vec_id long, score long")
        found.write.parquet(f"{top}/block={i}")
        shared.destroy()
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    out = spark.read.schema(found.schema).parquet(*[f"{top}/block={i}" for i in range(blocks)])  # each block is stored once
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
