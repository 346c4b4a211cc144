"""Counts kept by streams: corrections and retractions against a recount, event-time windows with late rows against a batch."""

from datetime import datetime, timedelta

import pytest

from cellmend.operators import stats
from cellmend.streaming import counts, drift

COLUMNS = ["A", "B", "C"]
SCHEMA = "row_id long, version long, gone boolean, A string, B string, C string"


def pairs_of(df):
    return sorted((r["a"], r["b"], r["va"], r["vb"], r["n"]) for r in df.collect())


def test_counts_after_corrections_equal_a_recount(spark, tmp_path):
    first = [(i, 0, False, f"a{i % 3}", f"b{i % 4}", f"c{i % 2}") for i in range(30)]
    second = [(i, 2, None, f"a{i % 3}", "b9", f"c{i % 2}") for i in range(0, 30, 5)] + [(40, 1, False, "a0", "b0", "c0"), (7, 1, True, "a0", "b0", "c0")]
    third = [(0, 1, False, "late", "late", "late"), (5, 3, False, "a5", "b5", "c5"), (5, 3, False, "a5", "b5", "c5"), (7, 2, False, "a7", "b7", "c7"), (41, 0, True, "x", "y", "z")]
    now = {}
    for k, part in enumerate((first, second, third)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts.count_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), COLUMNS, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        for r in part:
            if r[0] not in now or r[1] > now[r[0]][1]:
                now[r[0]] = r
        rows = spark.createDataFrame([(r[0], *r[3:]) for r in now.values() if not r[2]], "row_id long, A string, B string, C string")
        merged = counts.merged_counts(spark, f"{tmp_path}/out")
        assert pairs_of(counts.counted_pairs(merged)) == pairs_of(stats.pair_counts(rows, COLUMNS))
        if k == 1:
            counts.compact(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, counts.value_counts(merged).collect())) == sorted(map(tuple, stats.value_histogram(rows, COLUMNS).collect()))
    score = lambda df: {(r["lhs"], r["rhs"]): round(r["score"], 9) for r in df.collect()}
    assert score(counts.mu_plus(merged)) == score(stats.mu_plus_matrix(rows, COLUMNS))
    assert counts.cooccurrence(merged, COLUMNS).exceptAll(stats.cooccurrence(rows, COLUMNS)).count() == 0


def test_rows_of_like_ids_share_an_entry_of_the_state(spark, tmp_path):
    rows = [(i, 0, False, f"a{i % 3}", f"b{i % 4}", None if i % 7 == 0 else "c") for i in range(600)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = counts.count_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), COLUMNS, f"{tmp_path}/out", f"{tmp_path}/state")
    stream.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in stream.recentProgress if p["stateOperators"]) == 3
    assert counts.counted_pairs(counts.merged_counts(spark, f"{tmp_path}/out")).agg({"n": "sum"}).first()[0] == 3 * 600


def test_windows_close_behind_the_watermark_and_drop_late_rows(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    schema = "ts timestamp, A string, B string"
    rows = [[(at(m), f"a{m % 2}", f"b{m % 3}") for m in range(0, 60, 2)], [(at(5), "slow", "slow"), (at(130), "a0", "b0"), (None, "no", "time")], [(at(10), "late", "late"), (at(125), "fine", "fine")], [(at(600), "a0", "b0")], [(at(601), "a0", "b0")]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        drift.pair_stream(stream, ["A", "B"], "ts", "30 minutes", "60 minutes", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r["start"], r["va"], r["vb"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = [r for part in rows for r in part if r[0] and r[1] != "late" and r[0] < at(600)]
    want = drift.windowed_pairs(spark.createDataFrame(batch, schema), ["A", "B"], "ts", "30 minutes")
    assert got == sorted((r["start"], r["va"], r["vb"], r["n"]) for r in want.collect())
    assert any(va == "slow" for _, va, _, _ in got) and any(va == "fine" for _, va, _, _ in got)


def test_drift_is_the_change_of_the_measure(spark):
    rows = [(datetime(2024, 1, 1, h), f"a{i % 3}", f"b{i % 3}" if h == 0 or i % 4 else "x") for h in (0, 5) for i in range(24)]
    df = spark.createDataFrame(rows, "ts timestamp, A string, B string")
    got = {(r["start"].hour, r["lhs"], r["rhs"]): (r["score"], r["change"]) for r in drift.drift(drift.windowed_pairs(df, ["A", "B"], "ts", "1 hour")).collect()}
    for h in (0, 5):
        part = df.where(f"hour(ts) = {h}")
        for r in stats.mu_plus_matrix(part, ["A", "B"]).collect():
            score, change = got[h, r["lhs"], r["rhs"]]
            assert score == pytest.approx(r["score"])
            assert change is None if h == 0 else change == pytest.approx(score - got[0, r["lhs"], r["rhs"]][0])
