"""Dependency measures and co-occurrence of the columns of a categorical table.

Tables are wide: a ``row_id`` and string columns, missing values filled with a marker that counts as a value. All pair statistics come
from one pass: each row yields its pairs of columns, which are counted with map-side combining and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.sources.scratch import stored

MARKER = "[NULL Cell]"


def fill(df: DataFrame, columns: list[str], row_id: str = "row_id", marker: str = MARKER) -> DataFrame:
    """``row_id`` and the columns in order, as strings without nulls."""
    return df.select(row_id, *[F.coalesce(F.col(c).cast("string"), F.lit(marker)).alias(c) for c in columns])


def cells(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """``(row_id, attr, val)``: a row for each cell."""
    return df.unpivot([row_id], columns, "attr", "val")


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(attr, val, n)``."""
    return cells(df, columns).groupBy("attr", "val").agg(F.count("*").alias("n"))


def domain_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values each column has."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """The rows of ids below n: a table's first rows, as ids are places."""
    return df.where(F.col("row_id") < n)


def domain(df: DataFrame, column: str) -> DataFrame:
    """``(val, pos, n)``: the column's values with the first row that has each."""
    return df.groupBy(F.col(column).alias("val")).agg(F.min("row_id").alias("pos"), F.count("*").alias("n"))


def pdep_self(df: DataFrame, y: str) -> DataFrame:
    """``(pdep)``: the chance that two rows drawn with replacement agree in y."""
    return df.groupBy(y).agg(F.count("*").alias("n")).agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n"), F.lit(2.0))).alias("pdep"))


def _dependency(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """One row: pdep of rhs given lhs, distinct lhs values (dx), rows (n)."""
    xy = df.groupBy(*lhs, rhs).agg(F.count("*").alias("n"))
    x = xy.groupBy(*lhs).agg(F.sum("n").alias("nx"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    return x.agg((F.sum(F.col("sq") / F.col("nx")) / F.sum("nx")).alias("pdep"), F.count("*").alias("dx"), F.sum("nx").alias("n"))


def pdep(df: DataFrame, lhs: str | list[str], rhs: str) -> DataFrame:
    """``(pdep)``: the chance that two rows that agree in lhs agree in rhs."""
    return _dependency(df, [lhs] if isinstance(lhs, str) else list(lhs), rhs).select("pdep")


def mu_of(dependent: Column, own: Column, n: Column, dx: Column) -> Column:
    """The measure from pdep(X to Y), pdep(Y), the rows and the values of X; 0 where every X is unique or Y is constant."""
    raw = 1 - F.try_divide(1 - dependent, 1 - own) * F.try_divide((n - 1).cast("double"), (n - dx).cast("double"))
    return F.when((n == dx) | (own == 1), F.lit(0.0)).otherwise(F.coalesce(raw, F.lit(0.0)))


def mu(df: DataFrame, lhs: str | list[str], rhs: str) -> DataFrame:
    """``(mu)``: pdep corrected for chance."""
    both = _dependency(df, [lhs] if isinstance(lhs, str) else list(lhs), rhs).join(F.broadcast(pdep_self(df, rhs).withColumnRenamed("pdep", "own")))  # one row each
    return both.select(mu_of(F.col("pdep"), F.col("own"), F.col("n"), F.col("dx")).alias("mu"))


def mu_plus(df: DataFrame, lhs: str | list[str], rhs: str) -> DataFrame:
    return mu(df, lhs, rhs).select(F.greatest(F.lit(0.0), "mu").alias("mu_plus"))


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, va, vb, n)`` for each unordered pair of columns, a before b in the list."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, va string, vb string, n long")
    return df.select(F.inline(F.array(*pairs))).groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def ordered_pairs(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., attr, val, other, other_val, n)``: each pair of ``pair_counts`` in both orders."""
    return pairs.select(*by, F.inline(F.array(*[F.struct(F.col(a).alias("attr"), F.col(va).alias("val"), F.col(b).alias("other"), F.col(vb).alias("other_val"), "n") for a, va, b, vb in (("a", "va", "b", "vb"), ("b", "vb", "a", "va"))])))


def mu_plus_of(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., lhs, rhs, score)`` for every ordered pair of columns, from counts of pairs (see ``pair_counts``) of each ``by``."""
    x = ordered_pairs(pairs, by).groupBy(*by, "attr", "other", "val").agg(F.sum("n").alias("nx"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    one = x.groupBy(*by, "attr", "other").agg((F.sum(F.col("sq") / F.col("nx")) / F.sum("nx")).alias("pdep"), F.count("*").alias("dx"), F.sum("nx").alias("n"), (F.sum(F.col("nx").cast("double") * F.col("nx")) / F.pow(F.sum("nx"), F.lit(2.0))).alias("self"))
    own = one.select(*by, F.col("attr").alias("other"), F.col("other").alias("attr"), F.col("self").alias("own"))
    return one.join(own, [*by, "attr", "other"]).select(*by, F.col("attr").alias("lhs"), F.col("other").alias("rhs"), F.greatest(F.lit(0.0), mu_of(F.col("pdep"), F.col("own"), F.col("n"), F.col("dx"))).alias("score"))


def mu_plus_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(lhs, rhs, score)`` for every ordered pair of columns."""
    return mu_plus_of(pair_counts(df, columns))


def cooccurrence_of(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """As ``cooccurrence``, from counts of pairs."""
    return ordered_pairs(pairs).withColumn("w", F.col("n") * len(columns) ** 2).drop("n")


def cooccurrence(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(attr, val, other, other_val, w)``: rows that hold both values, weighted by the square of the number of columns."""
    return cooccurrence_of(pair_counts(df, columns), columns)


def cooccurrence_lookup(cooc: DataFrame, attr: str, val: str, other: str, other_val: str) -> DataFrame:
    """``(w)``: one pair's weight, 0 if it never occurs."""
    hit = (F.col("attr") == attr) & (F.col("val") == val) & (F.col("other") == other) & (F.col("other_val") == other_val)
    return cooc.where(hit).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"))


def value_totals(cooc: DataFrame) -> DataFrame:
    """``(attr, val, total)``: a value's weight over all partners."""
    return cooc.groupBy("attr", "val").agg(F.sum("w").alias("total"))


def table_hash(df: DataFrame) -> DataFrame:
    """``(hash)``: of the table's rows, whatever their order; from the MD5 of each row's values as strings (nulls as a character of their own)."""
    text = F.concat_ws(chr(1), *[F.coalesce(F.col(c).cast("string"), F.lit(chr(2))) for c in df.columns])
    row = F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("long")
    whole = F.concat_ws("-", F.bit_xor("h").cast("string"), F.sum(F.pmod("h", F.lit(1 << 31))).cast("string"), F.count("*").cast("string"))
    return df.select(row.alias("h")).agg(F.left(F.md5(whole.cast("binary")), F.lit(12)).alias("hash"))


class Counts:
    """What a table says about its columns' values, each counted once and stored: single values, pairs, and the number of rows."""

    def __init__(self, table: DataFrame, columns: list[str]):
        self.table, self.columns = table, columns
        long = table.select("row_id", F.inline(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("val")) for c in columns])))
        #: (attr, val, pos, n): each value with the first row that has it.
        self.values = stored(long.groupBy("attr", "val").agg(F.min("row_id").alias("pos"), F.count("*").alias("n")))
        #: (attr, val, other, other_val, n): see ``ordered_pairs``.
        self.pairs = stored(ordered_pairs(pair_counts(table, columns)))
        #: For each (column, other column) the most values that one value of the other occurs with.
        lists = self.pairs.groupBy("attr", "other", "other_val").agg(F.count("*").alias("n")).groupBy("attr", "other").agg(F.max("n").alias("n"))
        self.longest = {(r["attr"], r["other"]): r["n"] for r in lists.collect()}  # a row for each pair of columns
        sizes = self.values.groupBy("attr").agg(F.count("*").alias("values"), F.sum("n").alias("rows"), F.min("n").alias("rarest"), F.max("n").alias("most")).collect()  # a row for each column
        self.cardinality = {c: 0 for c in columns} | {r["attr"]: r["values"] for r in sizes}
        #: The least and the largest count of a column's values.
        self.ends = {r["attr"]: (r["rarest"], r["most"]) for r in sizes}
        self.rows = max((r["rows"] for r in sizes), default=0)

    def of(self, column: str) -> DataFrame:
        """``(val, pos, n)`` of one column."""
        return self.values.where(F.col("attr") == column).select("val", "pos", "n")
