"""The threshold search finds what scoring every value finds, and looks at few."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cellmend.operators import confidence, network, repair
from cellmend.operators.network import Local
from cellmend.operators.stats import MARKER, Counts
from cellmend.sources.scratch import Scratch, stored, temporary


def table(spark, rng, n, sizes):
    """Columns of so many values, the first few of them frequent, some missing."""
    names = [f"c{i}" for i in range(len(sizes))]
    value = lambda i, size: MARKER if rng.random() < 0.03 else f"v{i}_{min(rng.randrange(size), rng.randrange(size))}"
    rows = [(i, *[value(j, s) for j, s in enumerate(sizes)]) for i in range(n)]
    return spark.createDataFrame(rows, ["row_id", *names]), names


def of_all(df, local, columns, compensate):
    """What ``score_candidates`` says: the winner, its probability and the margin of each evidence."""
    evidence = repair._evidence(local, columns, compensate)
    scored = repair.score_candidates(df, df, local, columns, compensate)
    margins = {tuple(r[c] for c in evidence): r["margin"] for r in confidence.log_margin(confidence.best_two(scored, evidence)).collect()}
    best = {}
    for r in scored.collect():
        key = tuple(r[c] for c in evidence)
        if r["val"] != MARKER:
            rank = (round(r["score"] or 0.0, 13), -r["pos"])
            if key not in best or rank > best[key][0]:
                best[key] = (rank, r["val"], r["probability"])
    return {k: (v[1], round(v[2], 9), round(margins[k], 6)) for k, v in best.items()}


NETWORKS = [Local("c0", ("c1",), ()), Local("c0", (), ("c1",)), Local("c0", ("c1", "c2"), ("c3",)), Local("c0", ("c2",), ("c1", "c3")), Local("c0", (), ("c2", "c3"))]


@pytest.mark.parametrize("local, compensate", [*zip(NETWORKS, [True, True, True, False, False])], ids=str)
def test_search_equals_scoring_every_value(spark, local, compensate):
    rng = random.Random(str(local))
    df, columns = table(spark, rng, 120, [50, 9, 3, 20, 2])
    df = df.cache()
    want = of_all(df, local, columns, compensate)
    evidence = repair._evidence(local, columns, compensate)
    got = repair.repair_column(df, df, local, columns, compensate, depth=2).select(*evidence, "val", "probability", "margin").distinct().collect()
    assert {tuple(r[c] for c in evidence): (r["val"], round(r["probability"], 9), round(r["margin"], 6)) for r in got} == want


def probe(spark, n):
    """A key of five rows a value, a target that it decides, a flag and a unique column."""
    rows = [(i, f"k{i // 2}", f"t{i // 2}" if i % 50 else f"t{i // 3}", str(i % 2), f"u{i}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, key string, target string, flag string, single string")


def test_candidates_grow_with_the_rows(spark):
    columns, seen = ["key", "target", "flag", "single"], {}
    for n in (400, 1600):
        df, scratch = probe(spark, n).cache(), Scratch(spark)
        local = Local("target", ("key",), ())
        known = repair._known(df, repair._evidence(local, columns, True), scratch)
        best, scored = repair.search(known, Counts(df, columns), local, columns, True, 5.0, MARKER, scratch)
        assert best.count() == known.count() == n
        seen[n] = sum(s.count() for s in scored)
        fixed = repair.repair_column(df, df, local, columns).where(F.col("val") != F.concat(F.lit("t"), F.substring("key", 2, 9)))
        assert fixed.count() <= n // 50
    assert seen[1600] <= 4.5 * seen[400] and seen[1600] < 80 * 1600


def test_a_repair_keeps_no_tables_of_former_columns(spark):
    df, columns = table(spark, random.Random(3), 120, [5, 4, 3, 3])
    nets = {c: Local(c, (columns[i - 1],), ()) for i, c in enumerate(columns) if i}
    scratch = Scratch(spark)
    out, changed, facts = repair.repair_with_facts(df, nets, columns, scratch=scratch)
    assert sorted(scratch.paths) == ["facts", f"rows-{columns[-1]}"] and len(scratch.paths["facts"]) == 3
    assert out.count() == 120 and facts.count() == 360 and changed.count() == changed.distinct().count()
    scratch.clear()
    assert scratch.paths == {}


def test_temporary_tables_go(spark):
    with temporary():
        path = stored(spark.range(3)).inputFiles()[0].removeprefix("file://")
        with temporary():
            inner = stored(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and not os.path.exists(inner)
    assert not os.path.exists(path)
    assert os.path.exists(stored(spark.range(3)).inputFiles()[0].removeprefix("file://"))


def test_scores_that_agree_to_twelve_decimals_go_by_first_appearance(spark):
    columns = ["T", "D", *[f"E{i}" for i in range(7)]]
    rows = [(i, "x" if i < 100 else "y", "dx" if i < 100 else "dy", *"ooooooo") for i in range(200)] + [(200 + i, MARKER, "dy", *"qqqqqqq") for i in range(4)]
    df = spark.createDataFrame(rows, ["row_id", *columns])
    nets = network.local_networks(columns, [("T", c) for c in columns[1:]])
    fixed = {r["row_id"]: r["T"] for r in repair.repair(df, nets, columns, ["T"])[0].collect()}
    assert fixed == {i: "y" if 100 <= i < 200 else "x" for i in range(204)}  # the missing ones' scores are below 1e-13
