"""Weighted majority votes inside groups of equivalent columns.

All modes of a group come from one count of its pairs of columns; each column is then joined once with the modes of its values, so a
group reads its rows twice whatever its size, and the result of a group is stored before the next one reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.operators.stats import MARKER, ordered_pairs, pair_counts
from cellmend.sources.scratch import stored


def mode_per_group(df: DataFrame, key: str, target: str, marker: str = MARKER) -> DataFrame:
    """``(key, mode, weight)``: for each key but the marker, its most frequent target (the smallest of equals) and how often."""
    counts = df.where(F.col(key) != marker).groupBy(F.col(key).alias("key"), F.col(target).alias("mode")).agg(F.count("*").alias("weight"))
    place = Window.partitionBy("key").orderBy(F.desc("weight"), "mode")
    return counts.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")


def winner(votes: list[tuple[Column, Column]], marker: str = MARKER) -> Column:
    """The value with the largest sum of weights among (value, weight) votes; null without votes, in a tie, or if it is the marker."""
    given = F.filter(F.array(*[F.struct(v.alias("v"), w.alias("w")) for v, w in votes]), lambda x: x["v"].isNotNull())
    sums = F.transform(F.array_distinct(F.transform(given, lambda x: x["v"])), lambda v: F.struct(F.aggregate(F.filter(given, lambda x: x["v"] == v), F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("w"), v.alias("v")))
    ranked = F.sort_array(sums, asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when(first.isNotNull() & (second.isNull() | (second["w"] < first["w"])) & (first["v"] != marker), first["v"])


def modes_of(df: DataFrame, group: list[str], marker: str = MARKER) -> DataFrame:
    """``(attr, val, modes)``: for each value but the marker of each column of the group, a map from every other column of the group to
    the struct (mode, weight) of ``mode_per_group``. Stored."""
    pairs = ordered_pairs(pair_counts(df, group)).where(F.col("val") != marker)
    best = pairs.groupBy("attr", "val", "other").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("other_val").alias("mode"))).alias("best"))
    entry = F.struct("other", F.struct(F.col("best.mode").alias("mode"), (-F.col("best.less")).alias("weight")))
    return stored(best.groupBy("attr", "val").agg(F.map_from_entries(F.collect_list(entry)).alias("modes")))  # one entry for each column


def _with_votes(df: DataFrame, group: list[str], columns: list[str], marker: str) -> DataFrame:
    """``df`` with ``_vote_i``: the vote on the i-th of the columns."""
    modes, out = modes_of(df, group, marker), df
    for i, key in enumerate(group):
        own = modes.where(F.col("attr") == key).select(F.col("val").alias(f"_key_{i}"), F.col("modes").alias(f"_modes_{i}"))
        out = out.join(own, F.col(key) == F.col(f"_key_{i}"), "left").drop(f"_key_{i}")
    cast = {c: [(F.col(f"_modes_{i}")[c]["mode"], F.col(f"_modes_{i}")[c]["weight"]) for i, key in enumerate(group) if key != c] for c in columns}
    return out.select(*df.columns, *[winner(cast[c], marker).alias(f"_vote_{i}") for i, c in enumerate(columns)])


def votes(df: DataFrame, group: list[str], column: str, marker: str = MARKER) -> DataFrame:
    """``df`` with ``inferred``: the other columns' vote on the column, or null."""
    return _with_votes(df, group, [column], marker).withColumnRenamed("_vote_0", "inferred")


def repair_group(df: DataFrame, group: list[str], marker: str = MARKER) -> DataFrame:
    """Every column of the group overwritten by its votes; all votes read the group as it came."""
    if len(group) <= 1:
        return df
    out = _with_votes(df, group, group, marker)
    return out.select(*[F.coalesce(f"_vote_{group.index(c)}", F.col(c)).alias(c) if c in group else F.col(c) for c in df.columns])


def repair_consistency(df: DataFrame, groups: list[list[str]], marker: str = MARKER) -> DataFrame:
    """The groups in turn, each on the stored result of the one before."""
    wide = [g for g in groups if len(g) > 1]
    return reduce(lambda d, g: repair_group(stored(d), g, marker), wide[1:], repair_group(df, wide[0], marker)) if wide else df


def repaired_by_groups(groups: list[list[str]]) -> list[str]:
    """Columns that later inference leaves alone: all but the first of every group."""
    return [c for g in groups for c in g[1:]]
