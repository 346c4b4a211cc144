"""Reading and writing: categorical tables, their schemas and versions, score matrices, structures and results.

A data set is a folder with ``discrete_cols.json`` (the ordered columns), ``clean.csv`` and ``dirty.csv``; variants of both files lie in
``variants/<name>``. Folders are looked up through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.operators.stats import MARKER, fill
from cellmend.operators.structure import Structure
from cellmend.sources.scratch import stored

#: The strings that CSV readers of data frames take as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def missing_to_null(column: Column) -> Column:
    return F.when(~column.isin(NA_TOKENS), column)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a schema."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def load_columns(spark: SparkSession, root: str, name: str) -> list[str]:
    return json.loads(read_text(spark, f"{root}/{name}/discrete_cols.json"))


def data_path(root: str, name: str, variant: str | None = None) -> str:
    return f"{root}/{name}/variants/{variant}" if variant else f"{root}/{name}"


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    return [d for d in folders(spark, root) if exists(spark, f"{root}/{d}/clean.csv")]


def list_variants(spark: SparkSession, root: str, name: str) -> list[str]:
    top = f"{root}/{name}/variants"
    return [v for v in folders(spark, top) if exists(spark, f"{top}/{v}/dirty.csv")]


#: What follows an opening quote up to the closing one, and a whole value with the comma after it.
_INNER = '[^"]*+(?:""[^"]*+)*+'
_VALUE = f'(?:"{_INNER}"[^,]*+|[^",][^,]*+)?+,'
#: Lines that end inside a quoted value, if they begin outside of one or inside of one.
_OPENS = f'^(?:{_VALUE})*+"{_INNER}$'
_STAYS = f'^{_INNER}(?:"[^,]*+,(?:{_VALUE})*+"{_INNER})?$'
_END = "\n"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, _start, _at, value, _flips, _fixed)``: the lines of text files, read in blocks; ``_at`` orders a block's lines.

    Whether a line ends inside a quoted value (1) or not (0) may depend on whether it begins inside of one. ``_fixed`` is how it ends where
    that does not matter (else null); ``_flips`` is 1 where it ends the other way than it began.
    """
    raw = spark.read.option("lineSep", _END).text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    marked = F.contains("value", F.lit('"'))
    lines = lines.withColumns({"_out": F.when(marked, F.rlike("value", F.lit(_OPENS)).cast("int")).otherwise(0), "_in": F.when(marked, F.rlike("value", F.lit(_STAYS)).cast("int")).otherwise(1)})
    return lines.withColumns({"_fixed": F.when(F.col("_out") == F.col("_in"), F.col("_out")), "_flips": (F.col("_out") > F.col("_in")).cast("int")}).drop("_out", "_in")


def _state(rows: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
    """With ``_inside``: whether each row begins inside a quoted value, from the rows before it and how the first begins."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("_flips").over(upto))
    last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_upto")), ignorenulls=True).over(before)
    since = F.coalesce(F.sum("_flips").over(before), F.lit(0)) - F.coalesce(last["_upto"], F.lit(0))
    return rows.withColumn("_inside", (F.coalesce(last["_fixed"], start) + since) % 2 == 1).drop("_upto")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, place, record)``: the records of CSV files, whose quoted values may hold line ends; ``place`` counts them from 0 in each
    file. Empty lines between records are none.

    Files are read in blocks, whatever they hold. Whether a block begins inside a value follows from what each block before it does to
    either beginning (one row for each block); then a block's lines need their own block only. Files without values over several lines
    and without empty lines are not shuffled for it.
    """
    lines = _lines(spark, path)
    empty = F.rtrim(F.col("value"), F.lit("\r")) == ""
    odd = (F.col("_flips") > 0) | (F.col("_fixed") == 1) | empty
    fixed = F.max(F.when(F.col("_fixed").isNotNull(), F.struct("_at", "_fixed")))
    blocks = stored(lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.max(odd).alias("_odd"), fixed.alias("_last")))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    if not blocks.where("_odd").take(1):
        sums = blocks.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lines"))
        return lines.join(sums, ["_file", "_start"]).select("_file", (F.col("_lines") + F.col("_at") - F.col("_first")).alias("place"), F.col("value").alias("record"))
    after = F.col("_last").isNull() | (F.col("_at") > F.col("_last._at"))
    of_blocks = lines.join(blocks.select("_file", "_start", "_last"), ["_file", "_start"]).groupBy("_file", "_start").agg(F.sum(F.when(after, F.col("_flips")).otherwise(0)).alias("_flips"), F.first("_last._fixed").alias("_fixed"))
    # a block that fixes its end counts as fixed to what follows of it
    of_blocks = of_blocks.select("_file", "_start", ((F.col("_fixed") + F.col("_flips")) % 2).cast("int").alias("_fixed"), F.when(F.col("_fixed").isNull(), F.col("_flips") % 2).otherwise(0).cast("int").alias("_flips"))
    begins = stored(_state(of_blocks, ["_file"], "_start", F.lit(0)).select("_file", "_start", F.col("_inside").cast("int").alias("_begin")))
    own = _state(lines.join(begins, ["_file", "_start"]), ["_file", "_start"], "_at", F.col("_begin"))  # a block's lines, which one task has read
    own = own.where(F.col("_inside") | ~empty)
    own = own.withColumn("_own", F.sum((~F.col("_inside")).cast("long")).over(Window.partitionBy("_file", "_start").orderBy("_at")))
    own = stored(own.select("_file", "_start", "_at", "_own", "value"))
    sums = own.groupBy("_file", "_start").agg(F.max("_own").alias("_new"))
    sums = sums.select("_file", "_start", F.coalesce(F.sum("_new").over(before), F.lit(0)).alias("_records"))
    placed = own.join(sums, ["_file", "_start"]).withColumn("place", F.col("_records") + F.col("_own") - 1)
    whole = placed.groupBy("_file", "place").agg(F.array_sort(F.collect_list(F.struct("_start", "_at", "value"))).alias("parts"))  # a record's lines
    return whole.select("_file", "place", F.array_join("parts.value", _END).alias("record"))


def numbered(records: DataFrame) -> DataFrame:
    """``(row_id, record)``: records but each file's first with their place from 0 on, file by file in the order of their names."""
    files = records.groupBy("_file").agg((F.max("place")).alias("_rows"))  # without the header; a row for each file
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = records.where("place > 0").join(F.broadcast(files) if files.count() <= 10_000 else files, "_file")
    return rows.select((F.col("_before") + F.col("place") - 1).alias("row_id"), "record")


def read_csv(spark: SparkSession, path: str, columns: list[str], marker: str = MARKER) -> DataFrame:
    """``row_id`` (place in the file, from 0) and the columns as strings, missing values as the marker.

    Files are read in blocks; quoted values may hold line ends, commas and doubled quotes, and a quote inside a value that does not begin
    with one is a character like others. Lines end with a line feed, after a carriage return or not. All files have one header.
    """
    records = csv_records(spark, path).withColumn("record", F.rtrim("record", F.lit("\r")))
    heads = [r["record"] for r in records.where("place = 0").select("record").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError(f"{path} has files of different headers")
    names = next(csv.reader([heads[0].removeprefix("\ufeff")])) if heads else list(columns)
    if lacking := [c for c in columns if c not in names]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = numbered(records).select("row_id", F.from_csv("record", fields, {"escape": '"', "multiLine": "true"}).alias("r"))
    return fill(rows.select("row_id", *[missing_to_null(F.col(f"r.c{names.index(c)}")).alias(c) for c in columns]), columns, marker=marker)


def read_pair(spark: SparkSession, root: str, name: str, variant: str | None = None, marker: str = MARKER) -> tuple[DataFrame, DataFrame]:
    """The dirty and the clean table; rows belong together by ``row_id``."""
    columns, top = load_columns(spark, root, name), data_path(root, name, variant)
    return read_csv(spark, f"{top}/dirty.csv", columns, marker), read_csv(spark, f"{top}/clean.csv", columns, marker)


def verify_dataset(spark: SparkSession, root: str, name: str, variant: str | None = None) -> dict:
    """What is there and whether it fits: files, columns, row counts and their equality, errors as texts."""
    out: dict = {"dataset": name, "variant": variant, "errors": []}
    try:
        columns = load_columns(spark, root, name)
        out["columns"] = columns
    except (FileNotFoundError, ValueError) as e:
        return out | {"valid": False, "errors": [f"schema: {e}"]}
    for kind in ("dirty", "clean"):
        path = f"{data_path(root, name, variant)}/{kind}.csv"
        if not exists(spark, path):
            out["errors"].append(f"no {kind} file")
            continue
        try:
            out[f"{kind}_rows"] = read_csv(spark, path, columns).count()
        except ValueError as e:
            out["errors"].append(f"{kind}: {e}")
    if out.get("dirty_rows") != out.get("clean_rows"):
        out["errors"].append("row counts differ")
    return out | {"valid": not out["errors"]}


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """``(lhs, rhs, score)`` of a square CSV matrix whose first column names the rows; empty cells are left out."""
    raw = spark.read.option("header", True).csv(path)
    names = columns or raw.columns[1:]
    wide = raw.select(F.col(f"`{raw.columns[0]}`").alias("lhs"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names])
    return wide.unpivot(["lhs"], names, "rhs", "score").where(F.col("score").isNotNull() & F.col("lhs").isin(names))


def write_matrix(scores: DataFrame, columns: list[str], path: str) -> None:
    wide = scores.groupBy("lhs").pivot("rhs", columns).agg(F.first("score"))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("lhs"))
    wide.orderBy(place).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_structure(spark: SparkSession, structure: Structure, path: str) -> None:
    write_text(spark, path, json.dumps({"nodes": structure.nodes, "consistencies": structure.groups, "initial_edges": structure.edges}, indent=2))


def load_structure(spark: SparkSession, path: str) -> Structure:
    d = json.loads(read_text(spark, path))
    return Structure(d["nodes"], d["consistencies"], [tuple(e) for e in d["initial_edges"]])


def settings_hash(settings: dict) -> str:
    """Twelve hexadecimal digits that name a set of settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


class TableCache:
    """Tables by category and key as Parquet, written whole before they count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, category: str, key: str) -> str:
        return f"{self.root}/{category}/{key}.parquet"

    def exists(self, category: str, key: str) -> bool:
        return exists(self.spark, f"{self.path(category, key)}/_SUCCESS")

    def save(self, category: str, key: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(self.path(category, key))
        return self.spark.read.parquet(self.path(category, key))

    def load(self, category: str, key: str, make=None) -> DataFrame | None:
        """The table; if it is not there, what ``make()`` gives is saved first (or None without it)."""
        if self.exists(category, key):
            return self.spark.read.parquet(self.path(category, key))
        return self.save(category, key, make()) if make else None

    def list(self, category: str | None = None) -> dict[str, list[str]]:
        return {c: [k.removesuffix(".parquet") for k in folders(self.spark, f"{self.root}/{c}")] for c in ([category] if category else folders(self.spark, self.root))}

    def size(self) -> int:
        fs, p = _files(self.spark, self.root)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def clear(self, category: str | None = None) -> int:
        found = self.list(category)
        for c, keys in found.items():
            for k in keys:
                fs, p = _files(self.spark, self.path(c, k))
                fs.delete(p, True)
        return sum(map(len, found.values()))


def format_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"
