"""CSV files whose values hold line ends and quotes, read in blocks of any size, against a plain reader of whole files."""

import csv
import io
import json
import random

import pytest

from cellmend.operators.stats import MARKER
from cellmend.sources import dataset_source, tables

PIECES = ["a", "bc", ",", "\n", '"', '""', "é", " ", "\n\n", "x,y", ""]


@pytest.fixture(params=[24, 200, 1 << 20])
def blocks(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [tuple(MARKER if v in tables.NA_TOKENS else v for v in r) for r in rows[1:]]


def read(spark, path, columns):
    rows = tables.read_csv(spark, str(path), columns).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(len(rows)))
    return [tuple(r)[1:] for r in rows]


def test_values_over_lines_equal_a_plain_reader(spark, tmp_path, blocks):
    rng = random.Random(8)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["p", "q", "r"])
    for _ in range(60):
        writer.writerow(["".join(rng.choices(PIECES, k=rng.randrange(5))) + "." for _ in range(3)])
    (tmp_path / "t.csv").write_text(out.getvalue(), newline="")
    assert read(spark, tmp_path / "t.csv", ["p", "q", "r"]) == plain(out.getvalue())


def test_quotes_inside_values_empty_lines_and_carriage_returns(spark, tmp_path, blocks):
    text = 'n,size\n1,5" disk\n\n2,"3"" ""disk"""\n3,"a\n\nb,"\n4,"x"\n\n5,7"\n6,""\n7,NA\n"8","\n"\n'
    want = [("1", '5" disk'), ("2", '3" "disk"'), ("3", "a\n\nb,"), ("4", "x"), ("5", '7"'), ("6", MARKER), ("7", MARKER), ("8", "\n")]
    assert plain(text) == want
    (tmp_path / "t.csv").write_text(text, newline="")
    assert read(spark, tmp_path / "t.csv", ["n", "size"]) == want
    (tmp_path / "r.csv").write_text("n,size\r\n1,a\r\n2,b\r\n", newline="")
    assert read(spark, tmp_path / "r.csv", ["size"]) == [("a",), ("b",)]


def test_files_follow_each_other(spark, tmp_path):
    for k, body in enumerate(['1,"a\nb"\n', "", "2,c\n3,d\n"]):
        (tmp_path / f"part-{k}.csv").write_text("n,v\n" + body)
    assert read(spark, tmp_path, ["v", "n"]) == [("a\nb", "1"), ("c", "2"), ("d", "3")]
    with pytest.raises(ValueError, match="lacks w"):
        tables.read_csv(spark, str(tmp_path), ["w"])
    (tmp_path / "part-9.csv").write_text("v,n\nx,4\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_csv(spark, str(tmp_path), ["n"])


@pytest.mark.parametrize("size", [7, 60, 1 << 20])
def test_data_source_reads_ranges_that_respect_quotes(spark, tmp_path, size):
    rng = random.Random(11)
    for kind in ("dirty", "variants/v/clean"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["p", "q", "r"])
        for i in range(25):
            writer.writerow([f"{i}", *["".join(rng.choices(PIECES, k=rng.randrange(5))) + "." for _ in range(2)]])
        path = tmp_path / f"shop/{kind}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(out.getvalue() + '\n25,5" x,\n', newline="")
    (tmp_path / "shop/discrete_cols.json").write_text(json.dumps(["q", "p", "r"]))
    df = dataset_source.read_dataset(spark, str(tmp_path), "shop", size=size)
    assert df.columns == ["row_id", "q", "p", "r"]
    want = [(i, r[1], r[0], r[2]) for i, r in enumerate(plain((tmp_path / "shop/dirty.csv").read_text()))]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == want and len(want) == 26
    part = dataset_source.read_dataset(spark, str(tmp_path), "shop", "clean", "v", ["r"], size=size)
    assert [tuple(r) for r in part.orderBy("row_id").collect()] == [(i, r[2]) for i, r in enumerate(plain(path.read_text()))]
    assert spark.read.format("cellmend").options(root=str(tmp_path), dataset="shop").load().count() == 26
    with pytest.raises(Exception, match="no column z"):
        dataset_source.read_dataset(spark, str(tmp_path), "shop", columns=["z"]).count()
