"""Dependencies of an event stream by event time: counts of pairs of columns in windows, and how the measure drifts between windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellmend.operators.stats import mu_plus_of


def windowed_pairs(events: DataFrame, columns: list[str], time: str, length: str, late: str | None = None) -> DataFrame:
    """``(start, a, b, va, vb, n)``: pair counts of each window of event time. Of a stream, a window ends when the watermark, ``late`` behind
    the newest event, has passed it; events that come later than that are dropped. Rows without a time are in no window."""
    rows = events.where(F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if late else rows
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    long = rows.select(F.col(time), F.inline(F.array(*pairs)))
    return long.groupBy(F.window(time, length), "a", "b", "va", "vb").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "a", "b", "va", "vb", "n")


def pair_stream(events: DataFrame, columns: list[str], time: str, length: str, late: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each closed window's counts to Parquet at ``path``."""
    counts = windowed_pairs(events, columns, time, length, late)
    return counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift(counts: DataFrame) -> DataFrame:
    """``(start, lhs, rhs, score, change)``: mu+ of every ordered pair of columns in each window, and its change since the window before
    that has events (null in the first)."""
    return mu_plus_of(counts, ("start",)).withColumn("change", F.col("score") - F.lag("score").over(Window.partitionBy("lhs", "rhs").orderBy("start")))
