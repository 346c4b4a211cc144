"""Results of experiments: one table of rows (experiment, dataset, metrics...), a folder for each, read with the folders as columns."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.operators.evaluation import summarise
from cellmend.sources.tables import exists, folders, read_text, remove, write_text

METRICS = ["precision", "recall", "f1", "detection_rate", "repair_accuracy"]


class Results:
    """Experiments below ``root``; their names sort by age (such as times of day in digits)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, experiment: str, dataset: str, metrics: DataFrame, settings: dict | None = None) -> None:
        """Keep a data set's row of metrics, with the settings that gave it; a second result replaces the first."""
        noted = metrics.withColumn("settings", F.lit(json.dumps(settings or {}, sort_keys=True, default=str))).withColumn("saved", F.lit(datetime.now(timezone.utc).isoformat()))
        noted.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/experiment={experiment}/dataset={dataset}")
        write_text(self.spark, f"{self.root}/latest", experiment)

    def all(self) -> DataFrame | None:
        """``(metrics..., settings, saved, experiment, dataset)``, or None where nothing is kept."""
        if not folders(self.spark, f"{self.root}/runs"):
            return None
        out = self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/runs")
        return out.withColumns({c: F.col(c).cast("string") for c in ("experiment", "dataset")})

    def load(self, experiment: str, dataset: str | None = None) -> DataFrame | None:
        """An experiment's rows, or None without any."""
        found = self.all()
        if found is None:
            return None
        found = found.where(F.col("experiment") == experiment)
        found = found if dataset is None else found.where(F.col("dataset") == dataset)
        return found if found.take(1) else None

    def by_f1(self) -> DataFrame | None:
        """All rows, the best first; equals by name."""
        found = self.all()
        return None if found is None else found.orderBy(F.desc("f1"), "experiment", "dataset")

    def recent(self, n: int = 10) -> DataFrame | None:
        """``(experiment, datasets, mean_f1)`` of the last n experiments, the last one first."""
        found = self.all()
        return None if found is None else found.groupBy("experiment").agg(F.count_distinct("dataset").alias("datasets"), F.avg("f1").alias("mean_f1")).orderBy(F.desc("experiment")).limit(n)

    def latest(self) -> str | None:
        """The experiment saved last, or else the one whose name sorts last."""
        if exists(self.spark, f"{self.root}/latest"):
            return read_text(self.spark, f"{self.root}/latest")
        found = self.all()
        return None if found is None else found.agg(F.max("experiment")).first()[0]

    def delete(self, experiment: str, force: bool = False) -> bool:
        """Remove an experiment's rows; False, and nothing removed, where there are none, or where it is the latest one and not ``force``."""
        if not exists(self.spark, f"{self.root}/runs/experiment={experiment}") or (self.latest() == experiment and not force):
            return False
        if self.latest() == experiment:
            remove(self.spark, f"{self.root}/latest")
        remove(self.spark, f"{self.root}/runs/experiment={experiment}")
        return True

    def summary(self, experiment: str) -> DataFrame | None:
        """``(metric, mean, std)`` over an experiment's data sets."""
        found = self.load(experiment)
        return None if found is None else summarise(found, [c for c in METRICS if c in found.columns])

    def export(self, experiment: str, path: str, kind: str = "csv") -> None:
        """Write an experiment's rows as CSV or JSON; one without rows is an error."""
        found = self.load(experiment)
        if found is None:
            raise ValueError(f"experiment {experiment} has no results")
        writer = found.orderBy("dataset").coalesce(1).write.mode("overwrite")
        writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def save_repaired(repaired: DataFrame, columns: list[str], path: str) -> None:
    """The repaired table as CSV with a header, in the order of its rows, without their numbers."""
    repaired.orderBy("row_id").select(*columns).write.mode("overwrite").option("header", True).csv(path)


def save_evaluation(metrics: DataFrame, diff: DataFrame, path: str) -> None:
    """One line of JSON with the metrics (``metrics``), and one for each cell that was wrong or changed (``cells``)."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    diff.withColumn("missed", F.col("is_error") & ~F.col("is_attempt")).withColumn("wrong", F.col("is_attempt") & ~F.col("is_correct")).write.mode("overwrite").json(f"{path}/cells")
