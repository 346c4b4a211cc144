"""Which columns depend on which: from a measured and a supplied dependency matrix to groups and edges.

Matrices are long tables ``(lhs, rhs, score)`` of one row for each pair of columns, so the last step runs on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Matrix = dict[tuple[str, str], float]


@dataclass(frozen=True)
class Structure:
    nodes: list[str]
    groups: list[list[str]] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)


def aligned(measured: DataFrame, supplied: DataFrame) -> DataFrame:
    """``(lhs, rhs, afd, fd)`` of every pair that either matrix has; a missing score is 0."""
    return measured.withColumnRenamed("score", "afd").join(supplied.withColumnRenamed("score", "fd"), ["lhs", "rhs"], "full").na.fill(0.0, ["afd", "fd"])


def positive_scores(both: DataFrame) -> DataFrame:
    """``(lhs, rhs, score)``: measured scores that the supplied matrix agrees with, else 0."""
    return both.select("lhs", "rhs", F.when((F.col("afd") != 0) & (F.col("fd") > 0), F.col("afd")).otherwise(F.lit(0.0)).alias("score"))


def hybrid_scores(both: DataFrame, beta: float = 0.1) -> DataFrame:
    """``(lhs, rhs, score)``: measured scores over beta shrink by what the supplied matrix holds against them."""
    return both.select("lhs", "rhs", F.when((F.col("fd") < 0) & (F.col("afd") > beta), F.col("afd") * (1 + F.col("fd"))).otherwise(F.col("afd")).alias("score"))


def row_distances(measured: DataFrame) -> DataFrame:
    """``(a, b, distance)``: Euclidean, over the coordinates that both columns' scores have."""
    a, b = (measured.select(F.col("lhs").alias(n), "rhs", F.col("score").alias(f"{n}_score")).where(F.col("score").isNotNull()) for n in "ab")
    return a.join(b, "rhs").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("a_score") - F.col("b_score"), F.lit(2.0)))).alias("distance"))


def best_parents(scores: DataFrame, columns: list[str]) -> DataFrame:
    """``(rhs, parent, score)``: the best lhs of each column, the first in column order of equals."""
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("lhs"))
    rank = F.row_number().over(Window.partitionBy("rhs").orderBy(F.desc("score"), place))
    return scores.withColumn("rank", rank).where("rank = 1").select("rhs", F.col("lhs").alias("parent"), "score")


def supplied_edges(supplied: DataFrame, least: float = 0.5) -> DataFrame:
    """``(parent, child)``: pairs that the supplied matrix is sure of."""
    return supplied.where(F.col("score") > least).select(F.col("lhs").alias("parent"), F.col("rhs").alias("child"))


def as_matrix(scores: DataFrame) -> Matrix:
    return {(r["lhs"], r["rhs"]): r["score"] for r in scores.collect() if r["score"] is not None}  # a row for each pair of columns


def reaches(edges: list[tuple[str, str]], start: str, goal: str) -> bool:
    seen, open_ = set(), [start]
    while open_:
        node = open_.pop()
        if node == goal:
            return True
        if node not in seen:
            seen.add(node)
            open_ += [b for a, b in edges if a == node]
    return False


def distance(afd: Matrix, a: str, b: str, columns: list[str]) -> float:
    common = [(afd[a, c], afd[b, c]) for c in columns if (a, c) in afd and (b, c) in afd]
    return math.sqrt(sum((x - y) ** 2 for x, y in common)) if common else math.inf


def construct(afd: Matrix, fd: Matrix, columns: list[str], alpha: float = 0.1, beta: float = 0.1) -> Structure:
    """Groups of equivalent columns, then at most one parent for each other column.

    Columns are equivalent if both directions are positive and their rows of scores differ by ``alpha`` at most. A column's parent is its
    best positive lhs, or the first column if it has none; the edge needs a hybrid score other than 0, starts at the parent's group's first
    column, and is left out where it would close a cycle.
    """
    positive = {p: s for p, s in afd.items() if s != 0 and fd.get(p, 0.0) > 0}
    hybrid = {p: s * (1 + fd.get(p, 0.0)) if fd.get(p, 0.0) < 0 and s > beta else s for p, s in afd.items()}
    free, parts = list(columns), []
    while free:
        part = [free.pop(0)]
        grown = True
        while grown:
            grown = False
            for c in list(free):
                if all((g, c) in positive and (c, g) in positive and distance(afd, g, c, columns) <= alpha for g in part):
                    part.append(c)
                    free.remove(c)
                    grown = True
        parts.append(part)
    head = {c: p[0] for p in parts for c in p}
    edges: list[tuple[str, str]] = []
    for c in (p[0] for p in parts if len(p) == 1):
        parent = max(columns, key=lambda x: positive.get((x, c), 0.0))
        if hybrid.get((parent, c), 0.0) == 0:
            continue
        parent = head[parent]
        if parent != c and not reaches(edges, c, parent):
            edges.append((parent, c))
    return Structure(list(columns), [p for p in parts if len(p) > 1], edges)
