"""Dependencies between columns found in the data: a level-wise search over stripped partitions.

A set of columns cuts the rows into classes of equal values; only classes of two rows or more are kept (the stripped partition), as
single rows break no dependency. The partition of a larger set is made from that of a smaller one: classes shrink and rows drop out as
sets grow. A class is named by its smallest row_id, so names never collide. The error of X -> A is the share of rows to remove for it to
hold: in each class of X all but the most frequent value of A. All sets of a level are made and measured in one job each.

The driver holds the lattice of column sets, a row for each set and column; rows and classes stay in tables.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.operators.stats import domain_sizes, ordered_pairs, pair_counts
from cellmend.sources.scratch import Scratch


def _classes(rows: DataFrame) -> DataFrame:
    """``(place, cls, row_id)`` of ``(place, part, val, row_id)``: the classes of two rows or more, named by their smallest row."""
    named = rows.groupBy("place", "part", "val").agg(F.min("row_id").alias("cls"), F.count("*").alias("n")).where("n > 1")
    return rows.join(named.drop("n"), ["place", "part", "val"]).select("place", "cls", "row_id")


def removals(partition: DataFrame, coded: DataFrame, asked: dict[int, list[str]], columns: list[str]) -> dict[tuple[int, str], int]:
    """For each set of columns (its place) and asked right side, the rows to remove for the dependency to hold."""
    wanted = [(place, columns.index(a)) for place, rhs in asked.items() for a in rhs]
    if not wanted:
        return {}
    of = F.create_map(*[x for place, rhs in asked.items() for x in (F.lit(place), F.array(*[F.lit(columns.index(a)) for a in rhs]))])
    cells = partition.where(F.col("place").isin(list(asked))).join(coded, "row_id").select("place", "cls", "vals", F.explode(of[F.col("place")]).alias("rhs"))
    counts = cells.groupBy("place", "rhs", "cls", F.get("vals", F.col("rhs")).alias("val")).agg(F.count("*").alias("n"))
    lost = counts.groupBy("place", "rhs", "cls").agg((F.sum("n") - F.max("n")).alias("lost")).groupBy("place", "rhs").agg(F.sum("lost").alias("lost"))
    found = {(r["place"], r["rhs"]): r["lost"] for r in lost.collect()}  # a row for each set and column
    return {(place, columns[a]): found.get((place, a), 0) for place, a in wanted}


def find_dependencies(table: DataFrame, columns: list[str], most: int = 3, error: float = 0.0, scratch: Scratch | None = None) -> DataFrame:
    """``(lhs, rhs, error)``: the dependencies of ``most`` left columns at most whose error does not exceed ``error`` and none of whose left
    sides can lose a column; ``lhs`` is an array in the columns' order. A column of one value depends on the empty left side.

    Values are compared as strings, nulls as equal. The rows need a unique ``row_id``. An empty table has no dependencies.
    """
    scratch = scratch or Scratch(table.sparkSession)
    spark = table.sparkSession
    coded = scratch.put("coded", table.select("row_id", F.array(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("")) for c in columns]).alias("vals")))
    rows = coded.count()
    allowed = int(error * rows + 1e-9)
    found: list[tuple[list[str], str, float]] = []

    def minimal(lhs: tuple[str, ...], rhs: str) -> bool:
        return not any(r == rhs and {*x} <= {*lhs} for x, r, _ in found)

    sets: list[tuple[str, ...]] = [()]
    partition = scratch.put("level", coded.select(F.lit(0).alias("place"), F.lit(0).cast("long").alias("cls"), "row_id")) if rows > 1 else None
    alive = {(): 0} if rows > 1 else {}
    for level in range(min(most, len(columns) - 1) + 1 if rows else 0):
        asked = {place: [a for a in columns if a not in x and minimal(x, a)] for place, x in enumerate(sets)}
        lost = removals(partition, coded, {p: a for p, a in asked.items() if a and sets[p] in alive}, columns) if alive else {}
        for place, rhs in asked.items():
            found += [(list(sets[place]), a, lost.get((place, a), 0) / rows) for a in rhs if lost.get((place, a), 0) <= allowed]
        # larger sets: those that still have something to find, of which a class of two rows is left
        larger = [x for x in combinations(columns, level + 1) if any(a not in x and minimal(x, a) for a in columns)]
        larger = [x for x in larger if x[:-1] in alive or x[:-1] in sets]
        if level == most or not larger:
            break
        grows: dict[int, list[tuple[int, int]]] = {}
        for place, x in enumerate(larger):
            if x[:-1] in alive:
                grows.setdefault(alive[x[:-1]], []).append((place, columns.index(x[-1])))
        before, sets = partition, larger
        if not grows:
            alive = {}
            continue
        more = F.create_map(*[v for p, xs in grows.items() for v in (F.lit(p), F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column")) for i, c in xs]))])
        grown = before.where(F.col("place").isin(list(grows))).join(coded, "row_id").select("row_id", "cls", "vals", F.inline(more[F.col("place")]))
        partition = scratch.put("next", _classes(grown.select("place", F.col("cls").alias("part"), F.get("vals", F.col("column")).alias("val"), "row_id")))
        scratch.drop("level")
        scratch.paths["level"] = scratch.paths.pop("next")
        alive = {larger[r["place"]]: r["place"] for r in partition.select("place").distinct().collect()}  # a row for each set
    scratch.drop("level", "coded")
    return spark.createDataFrame(found, "lhs array<string>, rhs string, error double")


def pair_errors(table: DataFrame, columns: list[str]) -> DataFrame:
    """``(lhs, rhs, error)`` of every ordered pair of columns: the share of rows to remove for the one to decide the other; from one count of
    the pairs."""
    best = ordered_pairs(pair_counts(table, columns)).groupBy("attr", "other", "val").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return best.groupBy("attr", "other").agg((1 - F.sum("most") / F.sum("n")).alias("error")).select(F.col("attr").alias("lhs"), F.col("other").alias("rhs"), "error")


def generated_matrix(table: DataFrame, columns: list[str], limit: float = 0.1) -> DataFrame:
    """``(lhs, rhs, score)``, a dependency matrix from the data where nobody supplies one: pairs of an error up to ``limit`` are dependencies,
    sure from 1 down to 0.5 by the error; others are none, the surer the larger the error. Pairs whose left side is a key say nothing (0)."""
    rows = table.count()
    keys = domain_sizes(table, columns).first().asDict()  # one row
    unique = [c for c in columns if keys[c] == rows]
    score = F.when(F.col("lhs").isin(unique), 0.0).when(F.col("error") <= limit, 1 - F.col("error") / (2 * limit)).otherwise(-F.col("error"))
    return pair_errors(table, columns).select("lhs", "rhs", score.alias("score"))


def _conflicts(table: DataFrame, dependencies: list[tuple[list[str], str]]) -> DataFrame:
    """``(place, key, row_id, conflicts, major)``: rows of classes that break a dependency; ``major``: of its most frequent value (the
    smallest of equals)."""
    text = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit(""))
    cells = [F.struct(F.lit(i).alias("place"), F.array(*[text(c) for c in lhs], F.lit("")).alias("key"), text(rhs).alias("val")) for i, (lhs, rhs) in enumerate(dependencies)]
    rows = table.select("row_id", F.inline(F.array(*cells)))
    own = rows.groupBy("place", "key", "val").agg(F.count("*").alias("own"))
    every = own.groupBy("place", "key").agg(F.sum("own").alias("every"), F.min(F.struct((-F.col("own")).alias("less"), "val")).alias("top"), F.count("*").alias("values")).where("values > 1")
    broken = own.join(every, ["place", "key"]).select("place", "key", "val", (F.col("every") - F.col("own")).alias("conflicts"), (F.col("val") == F.col("top.val")).alias("major"))
    return rows.join(broken, ["place", "key", "val"]).drop("val")


def violations(table: DataFrame, dependencies: list[tuple[list[str], str]]) -> DataFrame:
    """``(place, row_id, conflicts)``: rows that break each dependency (by place in the list) and with how many rows they do: those of equal
    left values and another right one. Rows without conflicts are left out."""
    return _conflicts(table, dependencies).select("place", "row_id", "conflicts")


def suspect_rows(table: DataFrame, dependencies: list[tuple[list[str], str]], rounds: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``(row_id, round)``: rows without which no conflict is left, few of them.

    In a class of one dependency the cheapest way is to take all rows but those of its most frequent value. Over several dependencies a row
    that is wrong conflicts more than those it disagrees with, so a round takes the minority rows that conflict (over all dependencies)
    more than any majority row of their class; the conflicts that this settles no longer count in the next round. When a round finds none,
    or after ``rounds``, the minority rows that are left go.
    """
    scratch, taken, left = scratch or Scratch(table.sparkSession), [], table
    for i in range(rounds + 1):
        rows = scratch.put("conflicts", _conflicts(left, dependencies))
        weights = rows.groupBy("row_id").agg(F.sum("conflicts").alias("weight"))
        minor = rows.where("not major")
        if not minor.take(1):
            break
        weighed = rows.join(weights, "row_id")
        most = weighed.where("major").groupBy("place", "key").agg(F.max("weight").alias("most"))
        sure = weighed.where("not major").join(most, ["place", "key"]).where("weight > most").select("row_id").distinct()
        if i == rounds or not sure.take(1):
            taken.append(scratch.put("taken", minor.select("row_id").distinct().withColumn("round", F.lit(i))))
            break
        chosen = scratch.put("taken", sure.withColumn("round", F.lit(i)))
        taken.append(chosen)
        left = scratch.put(f"left{i}", left.join(chosen, "row_id", "left_anti"))
        scratch.drop("conflicts", f"left{i - 1}")
    out = table.select("row_id").limit(0).withColumn("round", F.lit(0))
    for t in taken:
        out = out.unionByName(t)
    return out
