"""The table-repair operators on worked examples, a known structure, files and odd input."""

import json
import math
from collections import Counter
import random
import time

import pytest
from pyspark.sql import functions as F

from cellmend.functions import text
from cellmend.operators import confidence, consistency, evaluation, network, repair, stats, structure
from cellmend.operators.stats import MARKER
from cellmend.plans import cleaning
from cellmend.sources import results, tables
from cellmend.streaming.repair import repair_stream

COLUMNS = ["A", "B", "C"]
ROWS = [(0, "a1", "b1", "c1"), (1, "a1", "b1", "c1"), (2, "a1", "b2", "c1"), (3, "a2", "b2", "c2"), (4, "a2", "b2", "c2"), (5, "a2", MARKER, "c2")]


@pytest.fixture(scope="module")
def worked(spark):
    return spark.createDataFrame(ROWS, "row_id long, A string, B string, C string").cache()


def test_worked_measures(worked):
    got = {(r["lhs"], r["rhs"]): round(r["score"], 6) for r in stats.mu_plus_matrix(worked, COLUMNS).collect()}
    assert got == {("A", "B"): 0.090909, ("A", "C"): 1.0, ("B", "A"): 0.259259, ("B", "C"): 0.259259, ("C", "A"): 1.0, ("C", "B"): 0.090909}
    for (a, b), v in got.items():
        assert round(stats.mu_plus(worked, a, b).first()[0], 6) == v
    w = {(r["val"], r["other_val"]): r["w"] for r in stats.cooccurrence(worked, COLUMNS).where("attr = 'B' and other = 'C'").collect()}
    assert w == {("b1", "c1"): 18, ("b2", "c1"): 9, ("b2", "c2"): 18, (MARKER, "c2"): 9}


def test_measure_guards(spark):
    df = spark.createDataFrame([(0, "x", "k"), (1, "y", "k")], "row_id long, u string, k string")
    assert stats.mu(df, "u", "k").first()[0] == 0 and stats.mu(df, "k", "u").first()[0] == 0
    assert {r["score"] for r in stats.mu_plus_matrix(df, ["u", "k"]).collect()} == {0.0}
    assert stats.mu_plus_matrix(df, ["u"]).count() == 0


def test_worked_repair(worked):
    nets = network.local_networks(COLUMNS, [("A", "B")])
    scored = {(r["val"], r["B"], r["C"]): r for r in repair.score_candidates(worked, worked, nets["A"], COLUMNS).collect()}
    r = scored["a1", "b2", "c1"]
    assert (round(r["penalty"], 6), round(r["probability"], 6), round(r["score"], 6)) == (0.965517, 0.166667, 0.16092)
    assert round(scored["a2", MARKER, "c2"]["score"], 6) == 0.482759
    scored = {(r["val"], r["A"], r["C"]): r for r in repair.score_candidates(worked, worked, nets["B"], COLUMNS).collect()}
    assert round(scored["b1", "a1", "c1"]["score"], 6) == 0.337513 and round(scored["b2", "a2", "c2"]["score"], 6) == 0.489394
    changed = {(r["row_id"], r["attr"]): (r["old"], r["new"]) for r in repair.repair(worked, nets, COLUMNS)[1].collect()}
    assert changed == {(2, "B"): ("b2", "b1"), (5, "B"): (MARKER, "b2")}
    plain = {(r["row_id"], r["attr"]): r["new"] for r in repair.repair(worked, nets, COLUMNS, compensate=False)[1].collect()}
    assert plain[2, "A"] == "a2"
    weak = network.filter_weak(nets, {("A", "B"): 0.0909, ("B", "A"): 0.2593})
    assert sorted(weak) == ["A", "C"]


def test_worked_votes(worked):
    got = {r["row_id"]: (r["A"], r["B"], r["C"]) for r in consistency.repair_consistency(worked, [["A", "B", "C"]]).collect()}
    assert got == {i: (a, {2: "b1", 5: "b2"}.get(i, b), c) for i, a, b, c in ROWS}
    assert consistency.repaired_by_groups([["A", "B", "C"]]) == ["B", "C"]
    assert consistency.repair_consistency(worked, [["A"]]) is worked


def test_repair_of_two_columns_equals_a_row_at_a_time(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("pqr"), rng.choice(["x", "y", MARKER]), rng.choice("uv")) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, A string, B string, C string")
    nets = network.local_networks(COLUMNS, [("A", "B"), ("C", "B")])
    got = {r["row_id"]: (r["A"], r["B"], r["C"]) for r in repair.repair(df, nets, COLUMNS)[0].collect()}
    data = [dict(zip(("i", *COLUMNS), r)) for r in rows]
    values = {c: list(dict.fromkeys(r[c] for r in data)) for c in COLUMNS}

    def n(**want):
        return sum(all(r[k] == v for k, v in want.items()) for r in data)

    for row in data:
        now = dict(row)
        for c in COLUMNS:
            parents, children = nets[c].parents, nets[c].children
            near = {c, *parents, *children}
            weight = {v: 0 if v == MARKER else 1 + math.sqrt(sum((9 * n(**{c: v, o: now[o]})) ** 2 for o in COLUMNS if o not in near)) for v in values[c]}
            best, chosen = -1, None
            for v in values[c]:
                if v == MARKER:
                    continue
                q, r = math.prod(len(values[p]) for p in parents), len(values[c])
                given = {p: now[p] for p in parents}
                p = 1.0 if len(parents) == 1 and now[parents[0]] == MARKER else (n(**{c: v, **given}) + 5 / (q * r)) / (n(**given) + 5 / q)
                for k in children:
                    if now[k] != MARKER:
                        p *= (n(**{c: v, k: now[k]}) + 5 / (r * len(values[k]))) / (n(**{c: v}) + 5 / r)
                if round(weight[v] / sum(weight.values()) * p, 12) > best:
                    best, chosen = round(weight[v] / sum(weight.values()) * p, 12), v
            now[c] = chosen
        assert got[row["i"]] == tuple(now[c] for c in COLUMNS)


FLIGHT = ["src", "flight", "sched_dep", "act_dep", "sched_arr", "act_arr"]
MEASURED = [
    [None, 0.0, 0.0, 0.0, 0.0, 0.0],
    [0.0, None, 0.41184, 0.30625, 0.31147, 0.28064],
    [0.0, 0.48855, None, 0.13988, 0.35731, 0.13017],
    [0.0, 0.64416, 0.25405, None, 0.19732, 0.39787],
    [0.0, 0.56824, 0.53706, 0.16725, None, 0.22058],
    [0.0, 0.70819, 0.27044, 0.47555, 0.28629, None],
]
GIVEN = [[0.0, -1, -1, -1, -1, -1], [-0.95, 0, 0.95, 0.9, 0.95, -0.95], [-0.95, -0.95, 0, -1, -0.95, -1], [-1, -0.95, -0.95, 0, -0.95, -0.95], [-0.95, -0.95, -0.95, -0.95, 0, -1], [-0.95, -0.95, -0.95, -0.95, -0.95, 0]]


def matrix(values, names):
    return {(a, b): float(values[i][j]) for i, a in enumerate(names) for j, b in enumerate(names) if values[i][j] is not None}


def test_structure():
    found = structure.construct(matrix(MEASURED, FLIGHT), matrix(GIVEN, FLIGHT), FLIGHT)
    assert found.groups == [] and found.edges == [("flight", "sched_dep"), ("flight", "act_dep"), ("flight", "sched_arr")]
    # a score that the supplied matrix takes away wholly leaves no edge; the fallback to the first column keeps others
    names = ["a", "b"]
    for sure, edges in ((-1.0, []), (-0.5, [("a", "b")])):
        assert structure.construct({("a", "b"): 0.6, ("b", "a"): 0.0}, {("a", "b"): sure, ("b", "a"): -1.0}, names).edges == edges
    alike = {("a", "b"): 0.9, ("b", "a"): 0.95, ("a", "c"): 0.3, ("b", "c"): 0.35}
    for alpha, groups in ((0.1, [["a", "b"]]), (0.01, [])):
        assert structure.construct(alike, {("a", "b"): 1.0, ("b", "a"): 1.0}, ["a", "b", "c"], alpha=alpha).groups == groups
    del alike["a", "c"]  # no coordinate in common
    assert structure.construct(alike, {("a", "b"): 1.0, ("b", "a"): 1.0}, ["a", "b", "c"]).groups == []


def test_hill_climb_stops_where_no_move_gains(spark):
    rng = random.Random(4)
    rows = [(i, a := rng.choice("xy"), a if rng.random() < 0.9 else "z", rng.choice("uv")) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, A string, B string, C string").cache()
    card = network.cardinalities(df, COLUMNS)

    def family(child, parents):
        n, u = {}, {}
        for r in rows:
            key = tuple(r[1 + COLUMNS.index(p)] for p in parents)
            n[key, r[1 + COLUMNS.index(child)]] = n.get((key, r[1 + COLUMNS.index(child)]), 0) + 1
            u[key] = u.get(key, 0) + 1
        q, r = math.prod(card[p] for p in parents), card[child]
        return sum(math.lgamma(v + 50 / (q * r)) - math.lgamma(50 / (q * r)) for v in n.values()) - sum(math.lgamma(v + 50 / q) - math.lgamma(50 / q) for v in u.values())

    def total(edges):
        return sum(family(c, [a for a, b in edges if b == c]) for c in COLUMNS)

    assert abs(network.family_score(df, "B", ["A", "C"], card).first()[0] - family("B", ["A", "C"])) < 1e-6
    points = [(x / 7,) for x in range(1, 80)] + [(float(10**k),) for k in range(2, 9)]
    for x, y in spark.createDataFrame(points, "x double").select("x", network.lgamma(F.col("x"))).collect():
        assert abs(y - math.lgamma(x)) < 1e-9 * max(1, abs(y))
    edges = network.hill_climb(df, COLUMNS)
    assert ("A", "B") in edges or ("B", "A") in edges
    for a in COLUMNS:
        for b in COLUMNS:
            if a != b:
                without = [e for e in edges if e not in ((a, b), (b, a))]
                for other in (without, [*without, (a, b)]):
                    if not structure.reaches(without, b, a) or other == without:
                        assert total(other) <= total(edges) + 1e-3
    assert ("C", "A") in network.hill_climb(df, COLUMNS, [("C", "A")])


def test_confidence(spark, worked):
    cands = spark.createDataFrame([(0, "A", 0.6), (0, "A", 0.3), (1, "A", 0.5), (2, "A", 0.4), (2, "A", 0.0)], "row_id long, attr string, probability double")
    two = {r["row_id"]: (r["first"], r["second"], r["margin"]) for r in confidence.log_margin(confidence.best_two(cands, ["row_id", "attr"])).collect()}
    assert two[0][:2] == (0.6, 0.3) and two[1] == (0.5, 0.5, 0.0) and two[2][1] == 1e-10 and abs(two[0][2] - math.log(2)) < 1e-12
    none = spark.createDataFrame([], "row_id long, attr string, margin double")
    scores = confidence.confidence_scores(worked, stats.cooccurrence(worked, COLUMNS), [("A", "B")], COLUMNS, none)
    assert scores.count() == 18 and {r["score"] for r in scores.where("attr = 'C'").collect()} == {0.5}
    low = confidence.least_confident(scores, COLUMNS, 3).collect()
    assert [(r["row_id"], r["attr"]) for r in low] == [(2, "A"), (2, "B"), (5, "A")]
    assert confidence.least_confident(scores, COLUMNS, 0).count() == 0 and confidence.least_confident(scores, COLUMNS, 0, True).count() == 18
    assert confidence.budget(1000) == 10 and confidence.budget(1000, most=50, candidates=7) == 7 and confidence.budget(10) == 0
    assert confidence.related_columns([("A", "B"), ("B", "C")], "B") == ["A", "C"]


def test_evaluation(worked):
    truth = worked.withColumn("B", F.when(F.col("row_id") == 2, "b1").when(F.col("row_id") == 5, "b2").otherwise(F.col("B")))
    same = evaluation.evaluate(worked, worked, truth, COLUMNS).first()
    assert (same["errors"], same["attempts"], same["f1"], same["precision"]) == (2, 0, 0.0, 0.0)
    assert evaluation.evaluate(worked, truth, truth, COLUMNS).first()["f1"] == 1.0
    wrong = worked.withColumn("A", F.lit("zz"))
    r = evaluation.evaluate(worked, wrong, truth, COLUMNS).first()
    assert (r["wrong"], r["missed"], r["detection_rate"]) == (6, 2, 3.0)


def test_rows_are_not_broadcast(worked):
    fixed = worked.withColumn("A", F.lit("a1"))
    for df in (evaluation.cell_diff(worked, fixed, worked, COLUMNS), repair.changed_cells(worked, fixed, COLUMNS)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_text(spark, monkeypatch):
    raw = ['```json\n{"corrected": "x", "confidence": "high", "reasoning": "r",}\n```', '{"corrected": "y"}', "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string")
    got = {r["i"]: r["a"] for r in df.select("i", text.parse_answer(F.col("raw")).alias("a")).collect()}
    assert got[0]["corrected"] == "x" and got[1]["corrected"] == "y" and got[3] is None and (got[2] is None or got[2]["corrected"] is None)
    monkeypatch.setenv("SOME_KEY", "v")
    assert text.from_environment({"a": "${env:SOME_KEY}", "b": ["${env:NO_SUCH:d}", 3]}) == {"a": "v", "b": ["d", 3]}


def test_files(spark, tmp_path):
    root = tmp_path / "data"
    for top, dirty in ((root / "shop", "x,NA,1\ny,,2\n"), (root / "shop/variants/more", 'x,"a, b",1\ny,b,2\n')):
        top.mkdir(parents=True)
        (top / "clean.csv").write_text("k,v,n\nx,a,1\ny,b,2\n")
        (top / "dirty.csv").write_text("k,v,n\n" + dirty)
    (root / "shop/discrete_cols.json").write_text(json.dumps(["v", "k"]))
    (root / "empty").mkdir()
    assert tables.list_datasets(spark, str(root)) == ["shop"] and tables.list_variants(spark, str(root), "shop") == ["more"]
    dirty, clean = tables.read_pair(spark, str(root), "shop")
    assert [tuple(r) for r in dirty.orderBy("row_id").collect()] == [(0, MARKER, "x"), (1, MARKER, "y")] and clean.columns == ["row_id", "v", "k"]
    assert tables.read_pair(spark, str(root), "shop", "more")[0].orderBy("row_id").first()["v"] == "a, b"
    assert tables.verify_dataset(spark, str(root), "shop")["valid"] and not tables.verify_dataset(spark, str(root), "empty")["valid"]
    lines = [f"{i},w{i}" for i in range(5000)]
    (tmp_path / "many").mkdir()
    for k in range(3):  # files of very unlike sizes, in blocks
        part = lines[(0, 100, 4000)[k] : (100, 4000, 5000)[k]]
        (tmp_path / f"many/part-{k}.csv").write_text("\n".join(["i,w", *part]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    many = tables.read_csv(spark, f"{tmp_path}/many", ["w", "i"])
    assert all(r["w"] == f"w{r['row_id']}" and r["i"] == str(r["row_id"]) for r in many.collect()) and many.count() == 5000
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "lines.csv").write_text('w\n"a\nb"\nc\n')
    assert [r["w"] for r in tables.read_csv(spark, f"{tmp_path}/lines.csv", ["w"]).orderBy("row_id").collect()] == ["a\nb", "c"]
    with pytest.raises(FileNotFoundError):
        tables.load_columns(spark, str(root), "none")
    s = structure.Structure(["a", "b", "c"], [["a", "b"]], [("a", "c")])
    tables.save_structure(spark, s, f"{tmp_path}/s.json")
    assert tables.load_structure(spark, f"{tmp_path}/s.json") == s
    scores = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.25)], "lhs string, rhs string, score double")
    tables.write_matrix(scores, ["a", "b"], f"{tmp_path}/m")
    assert sorted(map(tuple, tables.read_matrix(spark, f"{tmp_path}/m").collect())) == [("a", "b", 0.5), ("b", "a", 0.25)]
    cache = tables.TableCache(spark, f"{tmp_path}/cache")
    assert cache.load("scores", "x") is None and cache.load("scores", "x", lambda: scores).count() == 2 and cache.exists("scores", "x")
    assert cache.list() == {"scores": ["x"]} and cache.size() > 0 and cache.clear() == 1 and not cache.exists("scores", "x")
    assert tables.settings_hash({"a": 1, "b": 2}) == tables.settings_hash({"b": 2, "a": 1}) and tables.format_size(2048) == "2.0 KB"


def test_checked_cells(spark, worked):
    def sure(cells):
        return cells["value"].map(lambda v: json.dumps({"corrected": "b1", "confidence": "high"}) if v == "b2" else "broken")

    chosen = spark.createDataFrame([(2, "B"), (5, "B"), (99, "B"), (2, "none")], "row_id long, attr string")
    fixed, log = cleaning.check_cells(worked, chosen, {}, COLUMNS, sure)
    assert {r["row_id"]: r["B"] for r in fixed.collect()}[2] == "b1" and fixed.count() == 6
    assert {(r["row_id"], r["applied"]) for r in log.collect()} == {(2, True), (5, False)}

    def failing(cells):
        raise RuntimeError("down")

    fixed, log = cleaning.check_cells(worked, chosen, {}, COLUMNS, failing, cleaning.Asking(waits=(0.0,)))
    assert {r["error"] for r in log.collect()} == {"RuntimeError: down"} and fixed.exceptAll(worked).count() == 0


def test_cleaning_hands_every_margin_to_the_confidence(spark, monkeypatch):
    rows = [(i, f"k{i % 4}", f"v{i % 4}" if i % 17 != 3 else "v9") for i in range(40)]
    dirty = spark.createDataFrame(rows, "row_id long, K string, V string")
    given, plain = [], confidence.confidence_scores

    def spy(*args):
        given.append(args[-1])
        return plain(*args)

    monkeypatch.setattr(confidence, "confidence_scores", spy)
    settings = cleaning.Settings(method="edges", edges=(("K", "V"),), use_search=False, use_weak_filter=False, check_ratio=0.05)
    result = cleaning.clean(dirty, ["K", "V"], settings=settings, provider=cleaning.keep_all)
    asked = {(r["row_id"], r["attr"]) for r in result.checked.collect()}
    got = {(r["row_id"], r["attr"]): r["margin"] for r in given[0].collect()}
    assert len(got) == 80 and asked
    n = Counter((k, v) for _, k, v in rows)
    for i, k, _ in rows:
        both = sorted((n[k, v] for v in {v for _, _, v in rows}), reverse=True)[:2]
        share = network.CPD_SIZE / 20  # four keys and five values
        assert abs(got[i, "V"] - math.log((both[0] + share) / (both[1] + share))) < 1e-9


def test_cleaning_and_stream(spark, tmp_path):
    rows = [(i, f"k{i % 4}", f"v{i % 4}" if i % 17 != 3 else "v9", "s" if i % 4 < 2 else "t") for i in range(80)]
    dirty = spark.createDataFrame(rows, "row_id long, K string, V string, S string")
    truth = dirty.withColumn("V", F.concat(F.lit("v"), (F.col("row_id") % 4).cast("string")))
    given = spark.createDataFrame([("K", "V", 0.9), ("V", "K", 0.8), ("K", "S", 0.9), ("S", "K", -0.9), ("V", "S", 0.5), ("S", "V", -0.9)], "lhs string, rhs string, score double")
    result = cleaning.clean(dirty, ["K", "V", "S"], given, truth, cleaning.Settings(use_search=False), cleaning.keep_all)
    assert result.metrics.first()["f1"] > 0.9 and result.checked is not None
    cleaning.clean(dirty, ["K", "V", "S"], given, truth, cleaning.Settings(method="edges", edges=(("K", "V"),), use_search=False, first_rows=10)).repaired.count()
    train = f"{tmp_path}/train"
    dirty.write.parquet(train)
    nets = network.local_networks(["K", "V", "S"], [("K", "V")])
    query = repair_stream(spark.readStream.schema(dirty.schema).parquet(train), spark.read.parquet(train), nets, ["K", "V", "S"], f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert {r["V"] for r in spark.read.parquet(f"{tmp_path}/out").where("K = 'k1'").collect()} == {"v1"}


def test_state_results_and_sinks(spark, tmp_path):
    rows = [(i, f"k{i % 4}", f"v{i % 4}" if i % 17 != 3 else "v9") for i in range(80)]
    dirty = spark.createDataFrame(rows, "row_id long, K string, V string")
    truth = dirty.withColumn("V", F.concat(F.lit("v"), (F.col("row_id") % 4).cast("string")))
    settings = cleaning.Settings(method="edges", edges=(("K", "V"),), use_search=False, use_weak_filter=False, check_ratio=0.02)
    cache = tables.TableCache(spark, f"{tmp_path}/cache")
    assert cleaning.load_state(cache, "one") is None
    state = cleaning.infer(dirty, ["K", "V"], settings=settings)
    cleaning.save_state(cache, "one", state)
    again = cleaning.load_state(cache, "one")
    assert (again.structure, again.edges, again.relations) == (state.structure, state.edges, {"K": ["V"], "V": ["K"]})
    seen = []

    def sure(cells):
        seen.extend(cells.to_dict("records"))
        return cells["value"].map(lambda v: json.dumps({"corrected": v + "!", "confidence": "high"}))

    monkey = cleaning.check(again, ["K", "V"], settings, sure)
    log = monkey[1]
    changed = {(r["row_id"], r["attr"]): r["new"] for r in state.changed.collect()}
    assert log.count() == 3 and all(r["applied"] and r["original"] == changed[r["row_id"], r["attr"]] for r in log.collect())
    counters = cleaning.repair_counters(again.changed, log).first()
    assert (counters["changed"], counters["asked"], counters["applied"], counters["high"], counters["medium"]) == (len(changed), 3, 3, 3, 0)
    assert cleaning.repair_counters(again.changed).first()["asked"] == 0
    facts = {(r["row_id"], r["attr"]): r for r in again.facts.collect()}
    fact = facts[3, "V"]
    assert fact["val"] == "v3" and fact["context"] == f"V=v3 given K=k3: {100 * fact['probability']:.1f}%"

    metrics = evaluation.evaluate(dirty, state.repaired, truth, ["K", "V"])
    f1 = metrics.first()["f1"]
    assert 0 < f1 < 1
    store = results.Results(spark, f"{tmp_path}/results")
    assert store.all() is None and store.latest() is None and store.recent() is None and store.load("x") is None
    with pytest.raises(ValueError, match="no results"):
        store.export("x", f"{tmp_path}/none")
    for name, frame in (("20260102", metrics), ("20260101", metrics.withColumn("f1", F.lit(0.05)))):
        store.save(name, "shop", frame, {"alpha": 0.1})
    store.save("20260101", "farm", metrics.withColumn("f1", F.lit(0.15)))
    assert store.latest() == "20260101" and [r["experiment"] for r in store.by_f1().collect()] == ["20260102", "20260101", "20260101"]
    assert [(r["experiment"], r["datasets"], r["mean_f1"]) for r in store.recent().collect()] == [("20260102", 1, f1), ("20260101", 2, 0.1)]
    assert store.recent(1).count() == 1 and json.loads(store.load("20260102", "shop").first()["settings"]) == {"alpha": 0.1}
    spread = {r["metric"]: (r["mean"], round(r["std"], 6)) for r in store.summary("20260101").collect()}
    assert spread["f1"] == (0.1, 0.070711) and store.summary("none") is None
    store.export("20260101", f"{tmp_path}/csv")
    store.export("20260101", f"{tmp_path}/json", "json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/json").count() == 2
    results.save_repaired(state.repaired, ["K", "V"], f"{tmp_path}/repaired")
    assert spark.read.option("header", True).csv(f"{tmp_path}/repaired").columns == ["K", "V"]
    results.save_evaluation(metrics, evaluation.cell_diff(dirty, state.repaired, truth, ["K", "V"]), f"{tmp_path}/evaluation")
    assert spark.read.json(f"{tmp_path}/evaluation/cells").count() == len(changed) and spark.read.json(f"{tmp_path}/evaluation/metrics").first()["f1"] == f1


def test_questions_hold_relations_and_inference(spark, worked):
    asked = []

    def provider(cells):
        return cells.apply(lambda r: json.dumps({"corrected": "|".join((r["related"], r["inference"], r["question"][:8])), "confidence": "medium"}), axis=1)

    chosen = spark.createDataFrame([(2, "B"), (3, "C")], "row_id long, attr string")
    facts = spark.createDataFrame([(2, "B", "B=b1 given A=a1: 50.0%")], "row_id long, attr string, context string")
    related = cleaning.relations([("A", "B")], network.local_networks(COLUMNS, [("A", "B"), ("C", "B")]))
    assert related == {"A": ["B"], "B": ["A", "C"], "C": ["B"]}
    fixed, log = cleaning.check_cells(worked, chosen, related | {"C": []}, COLUMNS, provider, facts=facts)
    got = {(r["row_id"], r["attr"]): r["corrected"] for r in log.collect()}
    assert got == {(2, "B"): "A=a1; C=c1|B=b1 given A=a1: 50.0%|Column B", (3, "C"): "A=a2; B=b2; C=c2||Column C"} and not asked
    assert fixed.where("row_id = 3").first()["C"].startswith("A=a2")


def test_experiments(spark):
    rows = [(i, f"k{i % 4}", f"v{i % 4}" if i % 17 != 3 else "v9") for i in range(80)]
    dirty = spark.createDataFrame(rows, "row_id long, K string, V string")
    truth = dirty.withColumn("V", F.concat(F.lit("v"), (F.col("row_id") % 4).cast("string")))
    given = spark.createDataFrame([("K", "V", 0.9), ("V", "K", -0.8)], "lhs string, rhs string, score double")
    plain = cleaning.Settings(use_search=False)
    parts = {r["part"]: r for r in cleaning.ablation(dirty, ["K", "V"], given, truth, plain).collect()}
    best = parts["all"]["f1"]
    assert best > 0.3 and parts["all"]["f1_loss"] == 0.0 and parts["supplied"]["f1_loss"] == best and parts["groups"]["f1_loss"] == 0.0
    found = cleaning.search_parameters(dirty, ["K", "V"], given, truth, [0.05, 0.1], [0.1, None], plain).collect()
    assert [(r["place"], r["f1"]) for r in found] == [(0, best), (1, 0.0), (2, best), (3, 0.0)] and found[1]["error"]
    assert cleaning.best_of(spark.createDataFrame(found)).first()["place"] == 0
    swept = {r["variant"]: r["f1"] for r in cleaning.sweep_error_ratios(spark, {"dirty": dirty, "clean": truth}, ["K", "V"], given, truth, plain).collect()}
    assert swept == {"dirty": best, "clean": 0.0}


def test_plans_of_wide_repairs_stay_short(spark):
    columns = [f"c{i:02d}" for i in range(15)]
    rng = random.Random(7)
    df = spark.createDataFrame([(i, *[f"v{rng.randrange(3)}" for _ in columns]) for i in range(30)], "row_id long, " + ", ".join(f"{c} string" for c in columns))
    nets = network.local_networks(columns, [(columns[i], columns[i + 1]) for i in range(14)])
    began = time.time()
    fixed = repair.repair(df, nets, columns, columns[:4])[0]
    assert fixed.count() == 30
    lines = fixed._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert lines < 30 and time.time() - began < 120
    voted = consistency.repair_consistency(df, [columns[:5], columns[5:8], columns[8:]])
    assert voted._jdf.queryExecution().optimizedPlan().toString().count("\n") < 60


def test_answers_and_environment(spark, monkeypatch):
    cases = {'{"a": 1 , \n }': '{"a": 1  \n }', "[1,2,]": "[1,2]", "say ```json\n [1 , ] \n``` end": "[1  ]", "```\nx\n```": "x", "a ``` b": "a ``` b", " kept ": " kept ", "1,,}": "1,}", "": "", "``````": ""}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r["raw"]: r["fixed"] for r in df.select("raw", text.fix_json(F.col("raw")).alias("fixed")).collect()} == cases
    assert spark.createDataFrame([(None,)], "raw string").select(text.fix_json(F.col("raw"))).first()[0] is None
    monkeypatch.setenv("SOME_KEY", "v")
    monkeypatch.delenv("NO_SUCH", raising=False)
    given = {"a": "${env:SOME_KEY} rest", "b": "${env:NO_SUCH}", "c": "${env:NO_SUCH:}", "d": "${env:}", "e": "x ${env:SOME_KEY}", "f": "${env:SOME_KEY", "g": [{"h": "${env:NO_SUCH:a:b}"}]}
    assert text.from_environment(given) == {"a": "v", "b": None, "c": "", "d": "${env:}", "e": "x ${env:SOME_KEY}", "f": "${env:SOME_KEY", "g": [{"h": "a:b"}]}
