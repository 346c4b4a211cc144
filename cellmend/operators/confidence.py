"""How sure a repair is, and which repairs to have checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmend.operators.stats import MARKER


def related_columns(edges: list[tuple[str, str]], column: str) -> list[str]:
    """Both ends of the column's edges, repeated if an edge is."""
    return [b if a == column else a for a, b in edges if column in (a, b)]


def connected_columns(edges: list[tuple[str, str]], columns: list[str]) -> list[str]:
    """The columns that are related to another one; the others' cells have no score of their own."""
    return [c for c in columns if related_columns(edges, c)]


def best_two(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., first, second)``: the two highest probabilities; a single one twice, a second of 0 as 1e-10."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("probability")))
    two = candidates.select(*keys, "probability", place.alias("place")).where("place <= 2")  # tasks send two rows of a key at most
    pair = two.groupBy(*keys).agg(F.max("probability").alias("first"), F.min("probability").alias("second"))
    return pair.withColumn("second", F.when(F.col("second") == 0, F.lit(1e-10)).otherwise(F.col("second")))


def log_margin(two: DataFrame) -> DataFrame:
    """With ``margin``: the log of the first over the second, 0 where that is not positive."""
    ratio = F.try_divide("first", "second")
    return two.withColumn("margin", F.when(ratio > 0, F.log(ratio)).otherwise(F.lit(0.0)))


def min_max(df: DataFrame, column: str, by: list[str], flat: float | None = None) -> DataFrame:
    """The column scaled to 0 to 1 within each ``by``; where all are equal, left as it is or set to ``flat``."""
    ends = df.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col(column) if flat is None else F.lit(flat))
    return df.join(F.broadcast(ends), by).withColumn(column, scaled).drop("lo", "hi")  # a row for each column or pair of columns


def confidence_scores(repaired: DataFrame, cooc: DataFrame, edges: list[tuple[str, str]], columns: list[str], margins: DataFrame) -> DataFrame:
    """``(row_id, attr, score)`` for every cell: the mean over related columns of (1 + margin) * co-occurrence, both scaled; 0.5 for
    columns without relations. ``margins(row_id, attr, margin)`` may lack cells (0)."""
    related = [F.struct(F.lit(c).alias("attr"), F.lit(o).alias("other"), F.lit(i).alias("place"), F.col(c).alias("val"), F.col(o).alias("other_val")) for c in connected_columns(edges, columns) for i, o in enumerate(related_columns(edges, c))]
    every = repaired.select("row_id", F.explode(F.array(*[F.lit(c) for c in columns])).alias("attr"))
    margin = every.join(margins.hint("merge"), ["row_id", "attr"], "left").na.fill(0.0, ["margin"])
    margin = min_max(margin, "margin", ["attr"], 0.0)
    if not related:
        return every.withColumn("score", F.lit(0.5))
    pairs = repaired.select("row_id", F.inline(F.array(*related))).join(cooc, ["attr", "val", "other", "other_val"], "left")
    pairs = min_max(pairs.withColumn("w", F.coalesce(F.col("w"), F.lit(0)).cast("double")), "w", ["attr", "other", "place"])
    mean = pairs.groupBy("row_id", "attr").agg(F.avg("w").alias("w"))
    return margin.join(mean.hint("merge"), ["row_id", "attr"], "left").select("row_id", "attr", F.coalesce((1 + F.col("margin")) * F.col("w"), F.lit(0.5)).alias("score"))


def budget(total: int, ratio: float = 0.01, most: int = 0, candidates: int | None = None) -> int:
    """Cells that may be checked: ``most`` if positive, else a share of all; never more than there are candidates."""
    wanted = most if most > 0 else int(total * ratio)
    return max(0, wanted if candidates is None else min(wanted, candidates))


def least_confident(scores: DataFrame, columns: list[str], k: int, zero_means_all: bool = False) -> DataFrame:
    """The k lowest scores, by row and column order of equals. k of 0 or less gives none (or all, if asked for)."""
    if k <= 0:
        return scores if zero_means_all else scores.limit(0)
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("attr"))
    return scores.orderBy("score", "row_id", place).limit(k)
