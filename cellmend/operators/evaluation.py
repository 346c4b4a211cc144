"""A repair against the truth, cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_diff(dirty: DataFrame, repaired: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """``(row_id, attr, dirty, repaired, truth, is_error, is_attempt, is_correct)`` of cells that were wrong or changed."""
    side = lambda df, name: df.select("row_id", *[F.col(c).cast("string").alias(f"{name}_{c}") for c in columns])
    joined = side(dirty, "d").join(side(repaired, "r").hint("merge"), "row_id").join(side(truth, "t").hint("merge"), "row_id")  # rows: never broadcast
    rows = joined.select("row_id", F.inline(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"d_{c}").alias("dirty"), F.col(f"r_{c}").alias("repaired"), F.col(f"t_{c}").alias("truth")) for c in columns])))
    wrong, tried, right = (~F.col(a).eqNullSafe(F.col(b)) for a, b in (("dirty", "truth"), ("dirty", "repaired"), ("repaired", "truth")))
    out = rows.withColumn("is_error", wrong).withColumn("is_attempt", tried).withColumn("is_correct", wrong & tried & ~right)
    return out.where(F.col("is_error") | F.col("is_attempt"))


def evaluate(dirty: DataFrame, repaired: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """One row: counts of errors, attempts, correct, missed and wrong repairs, and the rates that follow (0 where undefined)."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    e, a, c = F.col("is_error"), F.col("is_attempt"), F.col("is_correct")
    counts = cell_diff(dirty, repaired, truth, columns).agg(one(e).alias("errors"), one(a).alias("attempts"), one(c).alias("correct"), one(e & ~a).alias("missed"), one(a & ~c).alias("wrong"))
    rate = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    rates = counts.withColumn("precision", rate("correct", "attempts")).withColumn("recall", rate("correct", "errors")).withColumn("detection_rate", rate("attempts", "errors")).withColumn("repair_accuracy", rate("correct", "attempts"))
    return rates.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def summarise(results: DataFrame, metrics: list[str]) -> DataFrame:
    """``(metric, mean, std)`` over a table of results, with the sample standard deviation (0 for one result)."""
    long = results.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
