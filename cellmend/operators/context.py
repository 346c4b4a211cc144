"""Rows to show beside a questioned cell: the most similar ones, its neighbours, and a few of the whole table.

Similar rows are a top-k join of sets: a row is the set of its (column, value) pairs, but markers. Equal rows are one kind, which meets
others once and stands for its k + 1 smallest ids, and cells of one column and kind are one question; so what is joined grows with the
different rows, not with their copies. A kind meets the lists of its own values from the rarest on; after p of its m values, a row that was
not met shares m - p of them at most. So a question is settled as soon as its k + 1 best rows share more than that, and lists of frequent
values are read for those only that nothing rarer settles. What a question keeps from one step to the next are its k + 1 best rows; each of
its cells leaves out its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.operators.stats import MARKER
from cellmend.sources.scratch import Scratch


def _best(met: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of each ``by`` that share the most, by id of equals; tasks send k of one at most."""
    place = Window.partitionBy(*by).orderBy(F.desc("shared"), "other_id")
    return met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def similar_rows(table: DataFrame, asked: DataFrame, columns: list[str], k: int = 3, marker: str = MARKER, scratch: Scratch | None = None) -> DataFrame:
    """``(row_id, attr, rank, other_id, shared)``: for each asked (row_id, attr) cell the k other rows that hold the most of its row's
    values in the other columns (the smaller row_id of equals); rows that share nothing are left out, markers are never shared.

    Cells that the table lacks have no rows. ``row_id`` is unique in the table; repeated questions are asked once.
    """
    scratch = scratch or Scratch(table.sparkSession)
    same = [F.col(f"own.{c}") == F.col(c) for c in columns]
    # equal rows are one kind; of a kind the k + 1 smallest ids are enough, as a cell leaves out its own row only
    numbered = table.select("row_id", *columns).withColumn("_place", F.row_number().over(Window.partitionBy(*columns).orderBy("row_id"))).where(F.col("_place") <= k + 1)
    kinds = scratch.put("kinds", numbered.groupBy(*columns).agg(F.sort_array(F.collect_list("row_id")).alias("ids")).withColumn("kind", F.get("ids", F.lit(0))))
    values = kinds.select(F.col("kind").alias("other"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("val")) for c in columns]))).where(F.col("val") != marker)
    counts = scratch.put("counts", values.groupBy("column", "val").agg(F.count("*").alias("n")))
    cells = asked.where(F.col("attr").isin(columns)).select("row_id", "attr").distinct().join(table.select("row_id", F.struct(*columns).alias("own")).hint("merge"), "row_id")
    cells = scratch.put("cells", cells.join(kinds.select("kind", *columns), same).select("row_id", "attr", "kind", "own"))
    own = cells.select("kind", "attr", "own").distinct()
    tokens = own.select("kind", "attr", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"own.{c}").alias("val")) for c in columns])))
    tokens = tokens.where((F.col("column") != F.col("attr")) & (F.col("val") != marker)).join(counts, ["column", "val"])
    cell = Window.partitionBy("kind", "attr")  # a row for each column
    tokens = scratch.put("tokens", tokens.select("kind", "attr", "column", "val", F.row_number().over(cell.orderBy("n", "column")).alias("place"), F.count("*").over(cell).alias("m")))
    open_, best, found, done, upto = scratch.put("open", own.join(tokens.select("kind", "attr", "m").distinct(), ["kind", "attr"])), None, [], 0, 1
    others = kinds.select(F.col("kind").alias("other"), "ids", F.struct(*columns).alias("theirs"))
    shared: Column = reduce(lambda a, b: a + b, [((F.col("attr") != c) & (F.col(f"own.{c}") == F.col(f"theirs.{c}")) & (F.col(f"own.{c}") != marker)).cast("int") for c in columns])
    while True:
        step = tokens.where((F.col("place") > done) & (F.col("place") <= upto)).join(open_.select("kind", "attr"), ["kind", "attr"], "left_semi")
        pairs = step.select("kind", "attr", "column", "val").join(values, ["column", "val"]).select("kind", "attr", "other").distinct()
        met = pairs.join(others, "other").join(open_, ["kind", "attr"]).select("kind", "attr", F.explode("ids").alias("other_id"), shared.alias("shared"))
        best = scratch.put("best", _best(met if best is None else met.unionByName(best.join(open_.select("kind", "attr"), ["kind", "attr"], "left_semi").select("kind", "attr", "other_id", "shared")).distinct(), ["kind", "attr"], k + 1))
        last = best.where(F.col("rank") == k + 1).select("kind", "attr", "shared")
        state = open_.join(last, ["kind", "attr"], "left")
        settled = F.coalesce((F.col("m") <= upto) | (F.col("shared") > F.col("m") - upto), F.lit(False))
        found.append(best.join(state.where(settled).select("kind", "attr"), ["kind", "attr"], "left_semi"))
        rest = state.where(~settled).select("kind", "attr", "own", "m")
        if not rest.take(1):
            break
        open_, done, upto = scratch.put("open", rest), upto, 2 * upto
    lists = reduce(DataFrame.unionByName, found).groupBy("kind", "attr").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "shared"))).alias("rows"))  # k + 1
    mine = F.slice(F.filter("rows", lambda x: x["other_id"] != F.col("row_id")), 1, k)
    listed = cells.join(lists, ["kind", "attr"]).select("row_id", "attr", F.posexplode(mine).alias("place", "row"))
    return listed.select("row_id", "attr", (F.col("place") + 1).alias("rank"), "row.other_id", "row.shared")


def nearby_rows(asked: DataFrame, reach: int = 1) -> DataFrame:
    """``(row_id, attr, rank, other_id)``: the rows before and after each asked cell's, the nearest first."""
    steps = F.array(*[F.struct(F.lit(2 * d + after).cast("int").alias("rank"), (F.col("row_id") + (d if after else -d)).alias("other_id")) for d in range(1, reach + 1) for after in (0, 1)])
    return asked.select("row_id", "attr", F.inline(steps))


def random_rows(table: DataFrame, asked: DataFrame, k: int = 2, seed: int = 7) -> DataFrame:
    """``(row_id, attr, rank, other_id)``: the k rows of the table whose ids have the smallest hashes, the same for all cells."""
    drawn = table.select(F.col("row_id").alias("other_id"), F.xxhash64("row_id", F.lit(seed)).alias("hash")).orderBy("hash", "other_id").limit(k)
    drawn = drawn.select("other_id", F.row_number().over(Window.orderBy("hash", "other_id")).alias("rank"))
    return asked.select("row_id", "attr").join(F.broadcast(drawn)).select("row_id", "attr", "rank", "other_id")  # k rows


def context_rows(table: DataFrame, asked: DataFrame, columns: list[str], related: dict[str, list[str]] | None = None, similar: int = 3, nearby: int = 1, random: int = 2, marker: str = MARKER) -> DataFrame:
    """``(row_id, attr, rows)``: for each asked cell a text of its similar, nearby and random rows, each as the questioned column and those
    related to it (all, where none are)."""
    asked = asked.where(F.col("attr").isin(columns)).select("row_id", "attr").distinct()
    parts = [("similar", similar_rows(table, asked, columns, similar, marker).drop("shared")), ("near", nearby_rows(asked, nearby)), ("random", random_rows(table, asked, random))]
    every = reduce(DataFrame.unionByName, [p.select("row_id", "attr", F.lit(i).alias("kind"), F.lit(name).alias("name"), "rank", "other_id") for i, (name, p) in enumerate(parts)])
    listed = lambda names: F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in names])
    shown = F.create_map(*[x for c in columns for x in (F.lit(c), listed([c, *[o for o in (related or {}).get(c, []) if o in columns]] if (related or {}).get(c) else columns))])
    wide = table.select(F.col("row_id").alias("other_id"), *columns)
    texts = every.where("row_id <> other_id").join(wide.hint("merge"), "other_id").select("row_id", "attr", "kind", "rank", F.concat(F.col("name"), F.lit(": "), shown[F.col("attr")]).alias("text"))
    rows = texts.groupBy("row_id", "attr").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "text"))).alias("texts"))  # a few for each cell
    return rows.select("row_id", "attr", F.array_join("texts.text", " | ").alias("rows"))
