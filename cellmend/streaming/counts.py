"""Counts of a table that grows and is corrected, kept by a stream.

Counts are sums, so a correction takes the row's old values away and adds the new ones. A stateful step keeps each row's values and turns
changes into signed rows; each micro-batch adds up its signed rows (partial counts) and stores them under its number, so a batch that runs
again replaces its own. The counts are the sums over all batches, which ``compact`` adds up from time to time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellmend.operators.stats import cooccurrence_of, mu_plus_of
from cellmend.sources.tables import exists, folders


#: Rows whose ids differ in so many low bits only have one entry in the state.
GROUP_BITS = 8


def signed_rows(changes: DataFrame, columns: list[str]) -> DataFrame:
    """``(row_id, sign, columns...)`` of a stream ``(row_id, version, gone, columns...)``: a row's old values with -1, its new ones with 1.

    Of a row's changes the one of the highest version counts (of equals the one whose values sort last), whenever it comes; older ones
    change nothing any more. ``gone`` takes a row away. The state holds each row's values once, those of 256 ids that follow one another as
    one entry, as a call for each row would cost more than its work.
    """
    fields = ", ".join(f"`{c}` string" for c in columns)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}
        newest: dict[int, tuple] = {}
        for part in parts:
            ids = part["row_id"].tolist() if key[0] is not None else [None] * len(part)
            for row, *r in zip(ids, *(part[c].tolist() for c in ("version", "gone", *columns))):
                last = newest.get(row) or known.get(row)
                if last is None or r[0] > last[0] or (r[0] == last[0] and row in newest and (r[1], *map(str, r[2:])) > (last[1], *map(str, last[2:]))):
                    newest[row] = tuple(r)
        if not newest:
            return
        rows = [(row, sign, *values[2:]) for row, new in newest.items() for sign, values in ((-1, known.get(row)), (1, new)) if values and not values[1]]
        state.update((pickle.dumps(known | newest),))
        if rows:
            yield pd.DataFrame(rows, columns=["row_id", "sign", *columns])

    named = changes.select(F.shiftright("row_id", GROUP_BITS).alias("group"), "row_id", "version", F.coalesce("gone", F.lit(False)).alias("gone"), *columns)
    return named.groupBy("group").applyInPandasWithState(step, f"row_id long, sign int, {fields}", "rows binary", "append", GroupStateTimeout.NoTimeout)


def partial_counts(signed: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, va, vb, n)``: what signed rows add to the counts of pairs of columns and, with b and vb null, of single values."""
    ones = [F.struct(F.lit(a).alias("a"), F.lit(None).cast("string").alias("b"), F.col(a).alias("va"), F.lit(None).cast("string").alias("vb")) for a in columns]
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return signed.select(F.inline(F.array(*ones, *pairs)), "sign").groupBy("a", "b", "va", "vb").agg(F.sum("sign").alias("n")).where("n <> 0")


def count_stream(changes: DataFrame, columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of a stream of changes (see ``signed_rows``) under ``path``."""

    def batch(rows: DataFrame, number: int) -> None:
        partial_counts(rows, columns).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")

    return signed_rows(changes, columns).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """The last complete sum of batches, and the batches after it."""
    names = [n for n in folders(spark, path) if exists(spark, f"{path}/{n}/_SUCCESS")]
    base = max((n for n in names if n.startswith("base-")), default=None)
    after = base.removeprefix("base-") if base else ""
    return base, [n for n in names if n.startswith("batch-") and n.removeprefix("batch-") > after]


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(a, b, va, vb, n)`` of the whole table as it stands, see ``partial_counts``."""
    base, batches = _parts(spark, path)
    found = [f"{path}/{n}" for n in ([base] if base else []) + batches]
    schema = "a string, b string, va string, vb string, n long"
    parts = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return parts.groupBy("a", "b", "va", "vb").agg(F.sum("n").alias("n")).where("n <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Add up what is there; readers take the sum instead of its batches once it is complete."""
    _, batches = _parts(spark, path)
    if batches:
        merged_counts(spark, path).write.mode("overwrite").parquet(f"{path}/base-{max(batches).removeprefix('batch-')}")


def value_counts(merged: DataFrame) -> DataFrame:
    """``(attr, val, n)``."""
    return merged.where("b is null").select(F.col("a").alias("attr"), F.col("va").alias("val"), "n")


def counted_pairs(merged: DataFrame) -> DataFrame:
    """As ``stats.pair_counts``."""
    return merged.where("b is not null")


def mu_plus(merged: DataFrame) -> DataFrame:
    """As ``stats.mu_plus_matrix``."""
    return mu_plus_of(counted_pairs(merged))


def cooccurrence(merged: DataFrame, columns: list[str]) -> DataFrame:
    """As ``stats.cooccurrence``."""
    return cooccurrence_of(counted_pairs(merged), columns)
