"""Repair of arriving rows by a model that stays as it is: rows are independent, so each micro-batch is repaired on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cellmend.operators.network import Local
from cellmend.operators.repair import repair
from cellmend.operators.stats import Counts
from cellmend.sources.scratch import Scratch


def repair_stream(arriving: DataFrame, train: DataFrame, networks: dict[str, Local], columns: list[str], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the repaired rows of a streaming table to Parquet at ``path``. ``train`` (a stored table) gives the counts."""

    counts = Counts(train, columns)  # once for all batches

    def batch(rows: DataFrame, number: int) -> None:
        scratch = Scratch(rows.sparkSession)
        repaired, _ = repair(rows, networks, columns, train=train, counts=counts, scratch=scratch, **options)
        repaired.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again replaces its own output
        scratch.clear()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
