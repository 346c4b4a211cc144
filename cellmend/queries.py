"""A query for each operator on views of the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions.text import fix_json, short_name
from cellmend.operators import confidence, consistency, context, discovery, evaluation, network, repair, stats, structure
from cellmend.operators.network import Local
from cellmend.operators.stats import MARKER
from cellmend.plans import cleaning, questions
from cellmend.sources import dataset_source, tables
from cellmend.sources.results import Results, save_evaluation, save_repaired
from cellmend.sources.scratch import shared_folder, stored
from cellmend.streaming import counts, drift
from cellmend.streaming.repair import repair_stream

GEO = ["c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]
SMALL = ["n_name", "r_name", "c_mktsegment"]
EDGES = [("n_name", "r_name")]
NETS = network.local_networks(SMALL, EDGES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region, as strings."""
    c, n, r = (_t(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return stats.fill(wide.withColumnRenamed("c_custkey", "row_id"), GEO)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``geo`` with some regions shifted to the next one and some nations missing."""
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("next_key"), F.col("r_name").alias("next_name"))
    g = geo(spark, sf_dir).join(r, F.col("next_key") == (F.col("n_regionkey").cast("int") + 1) % 5)
    shifted = F.when(F.col("row_id") % 20 == 3, F.col("next_name")).otherwise(F.col("r_name"))
    missing = F.when(F.col("row_id") % 25 == 7, F.lit(MARKER)).otherwise(F.col("n_name"))
    return g.withColumn("r_name", shifted).withColumn("n_name", missing).select("row_id", *GEO)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' dirty columns."""
    g = dirty(spark, sf_dir).withColumnRenamed("row_id", "c_custkey")
    return stats.fill(_t(spark, sf_dir, "orders").join(g, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("o_orderkey", "row_id"), ["o_orderstatus", "o_orderpriority", *GEO])


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    return stats.fill(c.withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn")), ["turn", "role"])


def supplied(spark: SparkSession) -> DataFrame:
    """A dependency matrix as an expert would give it."""
    sure = {("c_nationkey", "n_name"): 0.9, ("n_name", "c_nationkey"): 0.9, ("n_regionkey", "r_name"): 0.9, ("r_name", "n_regionkey"): 0.9, ("n_name", "r_name"): 0.8, ("n_name", "n_regionkey"): 0.8}
    rows = [(a, b, sure.get((a, b), -0.9)) for a in GEO for b in GEO if a != b]
    return spark.createDataFrame(rows, "lhs string, rhs string, score double")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """The dirty and the clean table written as a data set of CSV files and read again as a pair."""
    root = shared_folder(spark)
    for kind, table in (("dirty", dirty(spark, d)), ("clean", geo(spark, d))):
        table.orderBy("row_id").select(*GEO).write.option("header", True).csv(f"{root}/shop/{kind}.csv")
    tables.write_text(spark, f"{root}/shop/discrete_cols.json", json.dumps(GEO))
    wrong, right = tables.read_pair(spark, root, "shop")
    return wrong.select("row_id", F.col("r_name").alias("dirty_value")).join(right.select("row_id", F.col("r_name").alias("clean_value")), "row_id")


def _both(spark: SparkSession, d: str) -> DataFrame:
    return structure.aligned(stats.mu_plus_matrix(dirty(spark, d), GEO), supplied(spark))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _candidates(spark: SparkSession, d: str, target: str = "r_name") -> DataFrame:
    rows = dirty(spark, d).select("row_id", *SMALL)
    evidence = [c for c in SMALL if c != target]
    return rows.join(repair.score_candidates(rows, rows, NETS[target], SMALL), evidence).select("row_id", F.lit(target).alias("attr"), "val", "pos", "probability", "penalty", "score")


def _repaired(spark: SparkSession, d: str, targets: list[str]) -> DataFrame:
    return repair.repair(dirty(spark, d).select("row_id", *SMALL), NETS, SMALL, targets)[0]


def _margins(spark: SparkSession, d: str) -> DataFrame:
    return confidence.log_margin(confidence.best_two(_candidates(spark, d), ["row_id", "attr"]))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = dirty(spark, d).select("row_id", *SMALL)
    return confidence.confidence_scores(rows, stats.cooccurrence(rows, SMALL), EDGES, SMALL, _margins(spark, d).select("row_id", "attr", "margin"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in fences and with stray commas, made from orders' keys."""
    o = _t(spark, d, "orders")
    body = F.concat(F.lit('{"corrected": "'), F.col("o_orderkey").cast("string"), F.lit('", "confidence": "high",}'))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(body).alias("raw"))


def _shifted(spark: SparkSession, d: str, every: int) -> DataFrame:
    """``geo`` with one region in so many shifted to the next one."""
    r = _t(spark, d, "region").select(F.col("r_regionkey").alias("next_key"), F.col("r_name").alias("next_name"))
    rows = geo(spark, d).join(r, F.col("next_key") == (F.col("n_regionkey").cast("int") + 1) % 5)
    return rows.withColumn("r_name", F.when(F.col("row_id") % every == 3, F.col("next_name")).otherwise(F.col("r_name"))).select("row_id", *SMALL)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    variants = {str(every): _shifted(spark, d, every) for every in (10, 20, 40)}
    settings = cleaning.Settings(method="edges", edges=tuple(EDGES), use_search=False, use_weak_filter=False)
    swept = cleaning.sweep_error_ratios(spark, variants, SMALL, None, geo(spark, d).select("row_id", *SMALL), settings)
    return swept.select(F.col("variant").cast("int").alias("every"), "errors", "correct", F.round("f1", 6).alias("f1"))


def _kept(spark: SparkSession, d: str) -> Results:
    """The votes' metrics on three tables of more and fewer errors, as experiments of two data sets."""
    store = Results(spark, f"{shared_folder(spark)}/results")
    for every in (10, 20, 40):
        rows = _shifted(spark, d, every)
        metrics = evaluation.evaluate(rows, consistency.repair_consistency(rows, [EDGES[0]]), geo(spark, d).select("row_id", *SMALL), SMALL)
        store.save(f"ratio-{every}", "customers", metrics)
        store.save(f"ratio-{every}", "nothing", metrics.withColumn("f1", F.lit(0.0)))
    return store


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """A result table written as CSV and read again."""
    store = _kept(spark, d)
    path = f"{shared_folder(spark)}/export"
    store.export("ratio-20", path)
    return spark.read.option("header", True).schema(store.load("ratio-20").schema).csv(path).select("dataset", "errors", "attempts", "correct", F.round("f1", 6).alias("f1"))


WIDE = [*GEO, "n_first", "n_length", "r_first", "r_length", "s_first", "s_length", "balance", "sign", "third", "fifth"]
WIDE_EDGES = [("n_name", "r_name"), ("n_name", "n_regionkey"), ("n_name", "n_first"), ("n_name", "n_length"), ("r_name", "r_first"), ("c_mktsegment", "s_first"), ("s_first", "s_length"), ("balance", "sign"), ("n_name", "c_nationkey")]
WIDE_TARGETS = ["n_name", "r_name", "n_length", "s_first", "sign"]


def wide(spark: SparkSession, d: str) -> DataFrame:
    """``dirty`` with ten more columns made of its own and of the balance."""
    balance = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal"))
    made = {"n_first": F.left("n_name", F.lit(1)), "n_length": F.length("n_name"), "r_first": F.left("r_name", F.lit(1)), "r_length": F.length("r_name"), "s_first": F.left("c_mktsegment", F.lit(1)), "s_length": F.length("c_mktsegment"), "balance": F.floor(F.col("c_acctbal") / 1000), "sign": F.when((F.col("c_acctbal") < 0) != (F.col("row_id") % 30 == 4), "-").otherwise("+"), "third": F.col("row_id") % 3, "fifth": F.col("row_id") % 5}
    return stats.fill(dirty(spark, d).join(balance, "row_id").withColumns(made), WIDE)


def _repaired_wide(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair(wide(spark, d), network.local_networks(WIDE, WIDE_EDGES), WIDE, WIDE_TARGETS)[0].select("row_id", *WIDE_TARGETS)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_with_facts(dirty(spark, d).select("row_id", *SMALL), NETS, SMALL, ["r_name"])[2]


def _weak(spark: SparkSession, d: str) -> DataFrame:
    kept = network.filter_weak(NETS, structure.as_matrix(stats.mu_plus_matrix(dirty(spark, d), SMALL)))
    return spark.createDataFrame([(c, c in kept) for c in SMALL], "node string, kept boolean")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """What the offline provider says to every cell that the repair changed."""
    fixed, changed, facts = repair.repair_with_facts(dirty(spark, d).select("row_id", *SMALL), NETS, SMALL, ["r_name"])
    return cleaning.check_cells(fixed, changed, cleaning.relations(EDGES, NETS), SMALL, facts=facts)[1].drop("error")


def _counters(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.repair_counters(repair.repair(dirty(spark, d).select("row_id", *SMALL), NETS, SMALL, ["r_name"])[1], _checked(spark, d))


def _structure(spark: SparkSession, d: str) -> DataFrame:
    found = cleaning.find_structure(dirty(spark, d), supplied(spark), GEO, cleaning.Settings())
    rows = [("group", i, ",".join(g)) for i, g in enumerate(found.groups)] + [("edge", i, ",".join(e)) for i, e in enumerate(found.edges)]
    return spark.createDataFrame(rows, "kind string, place int, columns string")


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """Results of three tables as trials, the errors' ratio as their parameter."""
    return _kept(spark, d).all().where("dataset = 'customers'").select(F.regexp_extract("experiment", "[0-9]+", 0).cast("int").alias("place"), F.col("f1"))


#: A structure that does not depend on the data: a group to vote on, and a chain of columns for the networks.
KNOWN = structure.Structure(GEO, [["n_regionkey", "r_name"]], [("n_regionkey", "n_name"), ("n_name", "c_nationkey")])
KNOWN_TARGETS = ["c_nationkey", "n_name", "n_regionkey"]
#: Two groups of equivalent columns and nothing else.
PLACES = GEO[:4]
_NO_SEARCH = cleaning.Settings(use_search=False, use_weak_filter=False)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of the whole repair with the known structure and the offline provider."""
    found = cleaning.clean(dirty(spark, d), GEO, truth=geo(spark, d), settings=_NO_SEARCH, provider=cleaning.keep_all, found=KNOWN)
    return _rounded(found.metrics.select("errors", "attempts", "correct", "precision", "recall", "f1", "detection_rate"), "precision", "recall", "f1", "detection_rate")


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """The repaired table of an inference that was saved and loaded again."""
    cache = tables.TableCache(spark, f"{shared_folder(spark)}/cache")
    cleaning.save_state(cache, "customers", cleaning.infer(dirty(spark, d), GEO, settings=_NO_SEARCH, found=KNOWN))
    return cleaning.load_state(cache, "customers").repaired.select("row_id", *GEO)


def _ablated(spark: SparkSession, d: str) -> DataFrame:
    places = dirty(spark, d).select("row_id", *PLACES)
    parts = cleaning.ablation(places, PLACES, supplied(spark), geo(spark, d), cleaning.Settings(use_search=False))
    return _rounded(parts.select("part", "errors", "attempts", "correct", "f1", "f1_loss"), "f1", "f1_loss")


def _searched(spark: SparkSession, d: str) -> DataFrame:
    places = dirty(spark, d).select("row_id", *PLACES)
    found = cleaning.search_parameters(places, PLACES, supplied(spark), geo(spark, d), [0.1, 0.2], [0.1, 0.5], cleaning.Settings(use_search=False))
    return _rounded(found.drop("error"), "f1")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The dirty table arriving as a stream, repaired by counts of the stored one."""
    top = shared_folder(spark)
    train = stored(dirty(spark, d).select("row_id", *SMALL))
    train.write.parquet(f"{top}/arriving")
    arriving = spark.readStream.schema(train.schema).parquet(f"{top}/arriving")
    repair_stream(arriving, train, NETS, SMALL, f"{top}/repaired", f"{top}/state", targets=["n_name", "r_name"]).awaitTermination()
    return spark.read.parquet(f"{top}/repaired").select("row_id", *SMALL)


NEAR = ["tens", "hundreds", "sign", "c_mktsegment"]


def near(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their balance in tens, nearly a key and missing here and there, and what goes with it."""
    c = _t(spark, d, "customer").withColumn("row_id", F.col("c_custkey"))
    tens = F.floor(F.col("c_acctbal") / 10)
    made = {"tens": F.when(F.col("row_id") % 11 != 5, tens), "hundreds": F.floor(tens / 10), "sign": F.when(F.col("c_acctbal") < 0, "-").otherwise("+")}
    return stats.fill(c.withColumns(made), NEAR)


def _repaired_near(spark: SparkSession, d: str) -> DataFrame:
    rows = near(spark, d)
    return repair.repair(rows, network.local_networks(NEAR, [("hundreds", "tens")]), NEAR, ["tens"])[0].select("row_id", "tens")


def _several_lines(spark: SparkSession, d: str) -> DataFrame:
    """Values of several lines with quotes and commas, written as CSV and read again in small blocks."""
    path, blocks = f"{shared_folder(spark)}/lines", spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = F.concat("n_name", F.lit(',\n"'), "r_name", F.lit('"\n\n'), F.col("row_id").cast("string"))
    dirty(spark, d).select(text.alias("text"), F.col("row_id").cast("string").alias("id")).orderBy("row_id").write.option("header", True).option("escape", '"').csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        return stored(tables.read_csv(spark, path, ["id", "text"]).select("id", "text"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", blocks)


def _by_format(spark: SparkSession, d: str) -> DataFrame:
    """The dirty table as a data set's files, read by the data source in small ranges, two columns of it."""
    root = shared_folder(spark)
    dirty(spark, d).orderBy("row_id").select(*GEO).write.option("header", True).csv(f"{root}/shop/dirty.csv")
    tables.write_text(spark, f"{root}/shop/discrete_cols.json", json.dumps(GEO))
    return dataset_source.read_dataset(spark, root, "shop", columns=["n_name", "r_name"], size=1 << 16)


def _similar(spark: SparkSession, d: str) -> DataFrame:
    """The three rows that are most like each row whose nation is missing."""
    rows = dirty(spark, d)
    return context.similar_rows(rows, rows.where(F.col("n_name") == MARKER).select("row_id", F.lit("n_name").alias("attr")), GEO, 3)


#: What the regions and nations of the dirty table break.
CHECKED = [(["n_regionkey"], "r_name"), (["c_nationkey"], "n_name")]


def _cleaned_generated(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of the whole repair of four columns with no matrix but the data's own."""
    places = dirty(spark, d).select("row_id", *PLACES)
    found = cleaning.clean(places, PLACES, truth=geo(spark, d), settings=cleaning.Settings(use_search=False, generate=0.1))
    return _rounded(found.metrics.select("errors", "attempts", "correct", "f1"), "f1")


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    return discovery.suspect_rows(dirty(spark, d), CHECKED)


def _detected(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the suspected rows against those that differ from the clean table."""
    wrong = dirty(spark, d).join(geo(spark, d).select("row_id", *[F.col(c).alias(f"true_{c}") for c in GEO]), "row_id").where(" or ".join(f"{c} <> true_{c}" for c in GEO)).select("row_id", F.lit(1).alias("wrong"))
    both = wrong.join(_suspects(spark, d).select("row_id", F.lit(1).alias("taken")), "row_id", "full").agg(F.count("wrong").alias("errors"), F.count("taken").alias("suspected"), F.count_if(F.col("wrong") == F.col("taken")).alias("hits"))
    return both.withColumns({"precision": F.round(F.col("hits") / F.col("suspected"), 6), "recall": F.round(F.col("hits") / F.col("errors"), 6)})


def _families(spark: SparkSession, d: str) -> DataFrame:
    """The score of every family of three columns, from one contingency tree."""
    rows = dirty(spark, d).select(*SMALL)
    families = [(c, list(ps)) for c in SMALL for n in range(3) for ps in combinations([o for o in SMALL if o != c], n)]
    scores = network.ContingencyTree(rows, SMALL).scores(families, network.cardinalities(rows, SMALL))
    return _rounded(spark.createDataFrame([(c, ",".join(ps), s) for (c, ps), s in zip(families, scores)], "child string, parents string, score double"), "score", places=4)


def _failing(cells):
    """A provider that fails for every seventh row and confirms the others."""
    if int(cells["row_id"].iloc[0]) % 7 == 0:
        raise ValueError("no answer")
    return cleaning.keep_all(cells)


def _checked_with_failures(spark: SparkSession, d: str) -> DataFrame:
    fixed, changed, facts = repair.repair_with_facts(dirty(spark, d).select("row_id", *SMALL), NETS, SMALL, ["r_name"])
    return cleaning.check_cells(fixed, changed, cleaning.relations(EDGES, NETS), SMALL, _failing, cleaning.Asking(waits=(0.0,)), facts)[1].select("row_id", "attr", "original", "corrected", "success", "error")


def _ablated_with_checks(spark: SparkSession, d: str) -> DataFrame:
    places = dirty(spark, d).select("row_id", *PLACES)
    parts = cleaning.ablation(places, PLACES, supplied(spark), geo(spark, d), cleaning.Settings(use_search=False, check_ratio=1.0), cleaning.keep_all)
    return _rounded(parts.select("part", "errors", "attempts", "correct", "f1", "f1_loss"), "f1", "f1_loss")


def _expert(asked):
    """A provider that goes by the shown rows: yes where each value on the left has one on the right, surer the fewer values there are."""
    rows, lhs, rhs = json.loads(asked["sample"].iloc[0]), asked["lhs"].iloc[0], asked["rhs"].iloc[0]
    left, both = len({r[lhs] for r in rows}), len({(r[lhs], r[rhs]) for r in rows})
    answer = {"dependency": "Yes", "confidence": 1 - left / 20} if left == both else {"dependency": "no", "confidence": 1 - left / both}
    return asked["question"].map(lambda _: "```json\n" + json.dumps(answer).replace("}", ",}") + "\n```")


def _echo(cells):
    """A provider that gives its question back."""
    return cells["question"].map(lambda q: json.dumps({"corrected": None, "confidence": "low", "reasoning": q}))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    fixed, changed, facts = repair.repair_with_facts(dirty(spark, d).select("row_id", *SMALL), NETS, SMALL, ["r_name"])
    return cleaning.check_cells(fixed, changed, cleaning.relations(EDGES, NETS), SMALL, _echo, facts=facts)[1].select("row_id", F.col("reasoning").alias("question"))


def _budget(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(dirty(spark, d).select("row_id", *SMALL))
    cells, changed = rows.count() * len(SMALL), repair.repair(rows, NETS, SMALL, ["r_name"])[1].count()
    return spark.createDataFrame([(r, most, confidence.budget(cells, r, most, changed)) for r, most in ((0.01, 0), (0.5, 0), (0.01, 7))], "ratio double, most long, budget long")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What the catalogue says of two data sets, one of them with a variant that lacks rows and the other without a dirty table."""
    root = shared_folder(spark)
    whole, clean = dirty(spark, d), geo(spark, d)
    for path, table in (("shop/dirty", whole), ("shop/clean", clean), ("shop/variants/half/dirty", whole.where("row_id % 2 = 0")), ("shop/variants/half/clean", clean), ("bare/clean", clean)):
        table.select(*GEO).write.option("header", True).csv(f"{root}/{path}.csv")
    for name in ("shop", "bare"):
        tables.write_text(spark, f"{root}/{name}/discrete_cols.json", json.dumps(GEO))
    found = [tables.verify_dataset(spark, root, name, v) for name in tables.list_datasets(spark, root) for v in (None, *tables.list_variants(spark, root, name))]
    rows = [(r["dataset"], r["variant"], r.get("dirty_rows"), r.get("clean_rows"), r["valid"], "; ".join(r["errors"])) for r in found]
    return spark.createDataFrame(rows, "dataset string, variant string, dirty_rows long, clean_rows long, valid boolean, errors string")


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """The tables that a cache holds after one of its categories was cleared, with their rows."""
    cache = tables.TableCache(spark, f"{shared_folder(spark)}/cache")
    cache.save("counts", "values", stats.value_histogram(dirty(spark, d), GEO))
    cache.load("counts", "pairs", lambda: stats.pair_counts(dirty(spark, d), SMALL))
    cache.save("old", "values", geo(spark, d))
    cache.clear("old")
    return spark.createDataFrame([(c, k, cache.load(c, k).count()) for c, keys in cache.list().items() for k in keys], "category string, key string, rows long")


def _matrix_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/matrix.csv"
    tables.write_matrix(stats.mu_plus_matrix(dirty(spark, d), GEO), GEO, path)
    return tables.read_matrix(spark, path, GEO)


def _structure_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/structure.json"
    found = structure.supplied_edges(stats.mu_plus_matrix(dirty(spark, d), GEO))
    edges = [(r["parent"], r["child"]) for r in found.collect()]  # a row for each pair of columns at most
    tables.save_structure(spark, structure.Structure(GEO, [], edges), path)
    return spark.createDataFrame(tables.load_structure(spark, path).edges, "parent string, child string")


def _voted(spark: SparkSession, d: str) -> DataFrame:
    return consistency.repair_consistency(dirty(spark, d), [["n_regionkey", "r_name"]])


def _repaired_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/repaired.csv"
    save_repaired(_voted(spark, d), GEO, path)
    return tables.read_csv(spark, path, GEO)


def _evaluation_file(spark: SparkSession, d: str) -> DataFrame:
    path, three = f"{shared_folder(spark)}/evaluation", (dirty(spark, d), _voted(spark, d), geo(spark, d))
    save_evaluation(evaluation.evaluate(*three, GEO), evaluation.cell_diff(*three, GEO), path)
    return spark.read.schema("row_id long, attr string, missed boolean, wrong boolean").json(f"{path}/cells")


def _corrected_counts(spark: SparkSession, d: str) -> DataFrame:
    """The dirty table as a stream, then the regions' corrections: the merged counts."""
    top, fields = shared_folder(spark), f"row_id long, version long, gone boolean, {', '.join(f'{c} string' for c in SMALL)}"
    rows, right = dirty(spark, d).select("row_id", *SMALL), geo(spark, d).select("row_id", F.col("r_name").alias("right"))
    late = rows.join(right, "row_id").where("r_name <> right").withColumn("r_name", F.col("right")).drop("right")
    for version, part in enumerate((rows, late)):
        part.select("row_id", F.lit(version).cast("long").alias("version"), F.lit(False).alias("gone"), *SMALL).write.mode("append").parquet(f"{top}/changes")
        counts.count_stream(spark.readStream.schema(fields).parquet(f"{top}/changes"), SMALL, f"{top}/counts", f"{top}/state").awaitTermination()
    return counts.merged_counts(spark, f"{top}/counts")


def _events(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type"), (F.col("user_id") % 3).cast("string").alias("user"))


def _closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream: the counts of the weeks that the watermark, a day behind the last event, has closed."""
    top, path = shared_folder(spark), f"{d}/events.parquet"
    _t(spark, d, "events").write.parquet(f"{top}/events")
    stream = _events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{top}/events"))
    drift.pair_stream(stream, ["event_type", "user"], "ts", "7 days", "1 day", f"{top}/windows", f"{top}/state").awaitTermination()
    return spark.read.schema("start timestamp, a string, b string, va string, vb string, n long").parquet(f"{top}/windows").select(F.unix_timestamp("start").alias("start"), "va", "vb", "n")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    found = drift.drift(drift.windowed_pairs(_events(_t(spark, d, "events")), ["event_type", "user"], "ts", "7 days"))
    return _rounded(found.select(F.unix_timestamp("start").alias("start"), "lhs", "rhs", "score", "change"), "score", "change")


QUERIES = {
    "mu_plus_matrix": lambda s, d: _rounded(stats.mu_plus_matrix(dirty(s, d), GEO), "score"),
    "mu_plus_matrix_orders": lambda s, d: _rounded(stats.mu_plus_matrix(orders(s, d), ["o_orderstatus", "o_orderpriority", *GEO]), "score"),
    "scan_project_fill": lambda s, d: stats.fill(dirty(s, d), ["n_name", "r_name"]),
    "paired_scan": _paired,
    "cells_unpivot": lambda s, d: stats.cells(dirty(s, d), SMALL),
    "value_histogram": lambda s, d: stats.value_histogram(dirty(s, d), GEO),
    "domain_first_appearance": lambda s, d: stats.domain(dirty(s, d), "n_name"),
    "domain_size": lambda s, d: stats.domain_sizes(dirty(s, d), GEO),
    "pdep_self": lambda s, d: _rounded(stats.pdep_self(dirty(s, d), "r_name"), "pdep"),
    "pdep_single": lambda s, d: _rounded(stats.pdep(dirty(s, d), "n_name", "r_name"), "pdep"),
    "pdep_multi_lhs": lambda s, d: _rounded(stats.pdep(dirty(s, d), ["n_name", "c_mktsegment"], "r_name"), "pdep"),
    "mu": lambda s, d: _rounded(stats.mu(dirty(s, d), "n_name", "r_name"), "mu"),
    "mu_plus": lambda s, d: _rounded(stats.mu_plus(talks(s, d), "turn", "role"), "mu_plus"),
    "pair_counts": lambda s, d: stats.pair_counts(orders(s, d), ["o_orderstatus", "n_name", "r_name"]),
    "cooccurrence": lambda s, d: stats.cooccurrence(dirty(s, d), SMALL),
    "cooc_lookup": lambda s, d: stats.cooccurrence_lookup(stats.cooccurrence(dirty(s, d), SMALL), "r_name", "ASIA", "c_mktsegment", "BUILDING"),
    "value_total_occurrences": lambda s, d: stats.value_totals(stats.cooccurrence(dirty(s, d), SMALL)),
    "mode_per_group": lambda s, d: consistency.mode_per_group(dirty(s, d), "n_name", "r_name"),
    "consistency_vote": lambda s, d: consistency.votes(dirty(s, d), ["c_nationkey", "n_name", "r_name"], "n_name").select("row_id", "n_name", "inferred"),
    "consistency_repair": lambda s, d: consistency.repair_consistency(dirty(s, d), [["c_nationkey", "n_name"], ["n_regionkey", "r_name"]]),
    "matrix_align": lambda s, d: _rounded(_both(s, d), "afd"),
    "fd_positive_mask": lambda s, d: _rounded(structure.positive_scores(_both(s, d)), "score"),
    "fd_hybrid_score": lambda s, d: _rounded(structure.hybrid_scores(_both(s, d)), "score"),
    "fd_best_parent": lambda s, d: _rounded(structure.best_parents(structure.positive_scores(_both(s, d)), GEO), "score"),
    "row_distance": lambda s, d: _rounded(structure.row_distances(stats.mu_plus_matrix(dirty(s, d), GEO)), "distance"),
    "llm_only_edges": lambda s, d: structure.supplied_edges(stats.mu_plus_matrix(dirty(s, d), GEO)),
    "structure_construct": lambda s, d: _structure(s, d),
    "hill_climb_edges": lambda s, d: s.createDataFrame(network.hill_climb(stored(dirty(s, d).select("row_id", *SMALL)), SMALL, EDGES), "parent string, child string"),
    "weak_partition_filter": _weak,
    "bdeu_family_score": lambda s, d: _rounded(network.family_score(dirty(s, d), "r_name", ["n_name"], network.cardinalities(dirty(s, d), ["n_name", "r_name"])), "score", places=4),
    "cpd_bdeu": lambda s, d: _rounded(network.conditional(dirty(s, d), "r_name", ["n_name"], network.cardinalities(dirty(s, d), ["n_name", "r_name"])), "p"),
    "compensation": lambda s, d: _rounded(_candidates(s, d), "penalty").select("row_id", "val", "penalty"),
    "bn_probability": lambda s, d: _rounded(_candidates(s, d, "n_name"), "probability").select("row_id", "val", "probability"),
    "repair_single_column": lambda s, d: _repaired(s, d, ["r_name"]).select("row_id", "r_name"),
    "repair_sequential": lambda s, d: _repaired(s, d, ["n_name", "r_name"]),
    "repair_log": lambda s, d: repair.repair(dirty(s, d).select("row_id", *SMALL), NETS, SMALL, ["r_name"])[1],
    "query_context": lambda s, d: _facts(s, d).select("row_id", "context"),
    "max_second_max": lambda s, d: _rounded(confidence.best_two(_candidates(s, d), ["row_id", "attr"]), "first", "second").select("row_id", "first", "second"),
    "pro_map": lambda s, d: _rounded(confidence.min_max(_margins(s, d), "margin", ["attr"], 0.0), "margin").select("row_id", "margin"),
    "confidence_scores": lambda s, d: _rounded(_scores(s, d), "score"),
    "low_confidence_bottom_k": lambda s, d: confidence.least_confident(_rounded(_scores(s, d), "score"), SMALL, 50),
    "cell_diff": lambda s, d: evaluation.cell_diff(dirty(s, d), consistency.repair_consistency(dirty(s, d), [["n_regionkey", "r_name"]]), geo(s, d), GEO),
    "evaluation_metrics": lambda s, d: _rounded(evaluation.evaluate(dirty(s, d), consistency.repair_consistency(dirty(s, d), [["n_regionkey", "r_name"]]), geo(s, d), GEO), "precision", "recall", "f1", "detection_rate", "repair_accuracy"),
    "experiment_summary": lambda s, d: _rounded(_kept(s, d).summary("ratio-20"), "mean", "std"),
    "best_of_experiments": lambda s, d: _rounded(cleaning.best_of(_trials(s, d)), "f1"),
    "json_fix": lambda s, d: _answers(s, d).select("o_orderkey", fix_json(F.col("raw")).alias("fixed")),
    "model_short_name": lambda s, d: _t(s, d, "supplier").select("s_suppkey", short_name(F.concat(F.lit("host/group/"), F.col("s_name"))).alias("short")),
    "head_n": lambda s, d: stats.head_rows(geo(s, d), 100),
    "error_ratio_sweep": _sweep,
    "llm_stub_clean": _checked,
    "repair_wide": _repaired_wide,
    "repair_facts": lambda s, d: _rounded(_facts(s, d), "probability", "margin").drop("context"),
    "repair_counters": _counters,
    "table_hash": lambda s, d: stats.table_hash(dirty(s, d)),
    "results_by_f1": lambda s, d: _rounded(_kept(s, d).by_f1().select("experiment", "dataset", "f1"), "f1"),
    "results_recent": lambda s, d: _rounded(_kept(s, d).recent(2), "mean_f1"),
    "results_latest": lambda s, d: s.createDataFrame([(_kept(s, d).latest(),)], "experiment string"),
    "results_export": _exported,
    "pipeline_clean": lambda s, d: cleaning.clean(dirty(s, d), GEO, supplied(s), geo(s, d), provider=cleaning.keep_all).metrics,
    "pipeline_known_structure": _cleaned,
    "inference_state": _resumed,
    "ablation_impact": _ablated,
    "parameter_search": _searched,
    "stream_repair": _streamed,
    "repair_near_key": _repaired_near,
    "csv_line_ends": _several_lines,
    "dataset_source": _by_format,
    "similar_rows": _similar,
    "find_dependencies": lambda s, d: _rounded(discovery.find_dependencies(dirty(s, d), GEO, 2, 0.06).select(F.array_join("lhs", ",").alias("lhs"), "rhs", "error"), "error"),
    "generated_dependencies": lambda s, d: _rounded(discovery.generated_matrix(dirty(s, d), GEO), "score"),
    "clean_generated": _cleaned_generated,
    "dependency_violations": lambda s, d: discovery.violations(dirty(s, d), CHECKED),
    "suspect_rows": lambda s, d: _suspects(s, d).select("row_id"),
    "error_detection": _detected,
    "contingency_scores": _families,
    "checked_cells_with_failures": _checked_with_failures,
    "ablation_with_checks": _ablated_with_checks,
    "stream_counts": lambda s, d: counts.counted_pairs(_corrected_counts(s, d)),
    "stream_mu_plus": lambda s, d: _rounded(counts.mu_plus(_corrected_counts(s, d)), "score"),
    "stream_windows": _closed_windows,
    "window_drift": _drift,
    "asked_dependencies": lambda s, d: _rounded(questions.ask_dependencies(dirty(s, d), GEO, _expert).drop("error"), "score"),
    "cell_questions": _questions,
    "check_budget": _budget,
    "dataset_catalogue": _catalogue,
    "table_cache": _cached,
    "matrix_file": lambda s, d: _rounded(_matrix_file(s, d), "score"),
    "structure_file": _structure_file,
    "repaired_file": _repaired_file,
    "evaluation_file": _evaluation_file,
}

# SQL --------------------------------------------------------------------------------------------------------------------

_VIEWS = f"""WITH geo AS (SELECT c_custkey AS row_id, CAST(c_nationkey AS VARCHAR) AS c_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, r_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dirty AS (SELECT row_id, c_nationkey, CASE WHEN row_id % 25 = 7 THEN '{MARKER}' ELSE n_name END AS n_name, n_regionkey, CASE WHEN row_id % 20 = 3 THEN x.r_name ELSE geo.r_name END AS r_name, c_mktsegment
  FROM geo JOIN region AS x ON x.r_regionkey = (CAST(n_regionkey AS INT) + 1) % 5),
ord AS (SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, dirty.* EXCLUDE (row_id) FROM orders JOIN dirty ON o_custkey = row_id),
talks AS (SELECT conv_id * 1000 + turn AS row_id, CAST(turn AS VARCHAR) AS turn, role FROM conversations)
"""


def _dep(lhs: list[str], rhs: str, table: str) -> str:
    x = ", ".join(lhs)
    return f"(SELECT sum(sq / nx) / sum(nx) AS pdep, count(*) AS dx, sum(nx) AS n FROM (SELECT {x}, sum(n) AS nx, sum(CAST(n AS DOUBLE) * n) AS sq FROM (SELECT {x}, {rhs}, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY {x}))"


def _own(y: str, table: str) -> str:
    return f"(SELECT sum(CAST(n AS DOUBLE) * n) / pow(sum(n), 2) AS own FROM (SELECT count(*) AS n FROM {table} GROUP BY {y}))"


def _mu(lhs: list[str], rhs: str, table: str) -> str:
    return f"SELECT CASE WHEN n = dx OR own = 1 THEN 0.0 ELSE 1 - (1 - pdep) / (1 - own) * CAST(n - 1 AS DOUBLE) / (n - dx) END AS mu FROM {_dep(lhs, rhs, table)}, {_own(rhs, table)}"


def _matrix(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS lhs, '{b}' AS rhs, greatest(0.0, mu) AS score FROM ({_mu([a], b, table)})" for a in columns for b in columns if a != b)


def _pairs(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS va, {b} AS vb, count(*) AS n FROM {table} GROUP BY ALL" for i, a in enumerate(columns) for b in columns[i + 1 :])


def _cooc(columns: list[str], table: str) -> str:
    p = f"SELECT * FROM ({_pairs(columns, table)})"
    w = len(columns) ** 2
    return f"SELECT a AS attr, va AS val, b AS other, vb AS other_val, n * {w} AS w FROM ({p}) UNION ALL SELECT b, vb, a, va, n * {w} FROM ({p})"


def _mode(key: str, target: str, table: str) -> str:
    return f"SELECT k AS key, v AS mode, n AS weight FROM (SELECT {key} AS k, {target} AS v, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {target}) AS p FROM {table} WHERE {key} <> '{MARKER}' GROUP BY {key}, {target}) WHERE p = 1"


def _vote(group: list[str], column: str, table: str) -> str:
    cast = " UNION ALL ".join(f"SELECT row_id, mode AS v, weight AS w FROM {table} JOIN ({_mode(o, column, table)}) ON {o} = key" for o in group if o != column)
    sums = f"SELECT row_id, v, sum(w) AS w FROM ({cast}) GROUP BY row_id, v"
    return f"SELECT row_id, CASE WHEN count(*) FILTER (WHERE w = m) = 1 AND max(v) FILTER (WHERE w = m) <> '{MARKER}' THEN max(v) FILTER (WHERE w = m) END AS inferred FROM (SELECT *, max(w) OVER (PARTITION BY row_id) AS m FROM ({sums})) GROUP BY row_id"


def _group_repair(group: list[str], columns: list[str], table: str) -> str:
    joins = " ".join(f"LEFT JOIN ({_vote(group, c, table)}) AS v_{c} ON v_{c}.row_id = t.row_id" for c in group)
    return f"SELECT t.row_id, {', '.join(f'coalesce(v_{c}.inferred, t.{c}) AS {c}' if c in group else f't.{c}' for c in columns)} FROM {table} AS t {joins}"


def _repair_sql(rows: str, train: str, target: str, parents: list[str], children: list[str], columns: list[str]) -> str:
    """Candidates of every row: row_id, val, pos, probability, penalty."""
    others = [c for c in columns if c not in (target, *parents, *children)]
    card = lambda c: f"(SELECT count(DISTINCT {c}) FROM {train})"
    count = lambda by, name: f"(SELECT {', '.join(by)}, count(*) AS {name} FROM {train} GROUP BY ALL)"
    r, joins = card(target), []
    if parents:
        (p,) = parents
        joins += [f"LEFT JOIN {count([p, target], 'n_xu')} AS xu ON xu.{p} = t.{p} AND xu.{target} = d.val", f"LEFT JOIN {count([p], 'n_u')} AS u ON u.{p} = t.{p}"]
        prob = f"CASE WHEN t.{p} = '{MARKER}' THEN 1.0 ELSE (coalesce(n_xu, 0) + 5.0 / ({card(p)} * {r})) / (coalesce(n_u, 0) + 5.0 / {card(p)}) END"
    else:
        prob = f"(d.n + 5.0 / {r}) / ((SELECT count(*) FROM {train}) + 5.0)"
    for i, c in enumerate(children):
        joins.append(f"LEFT JOIN {count([target, c], f'n_{i}')} AS c{i} ON c{i}.{target} = d.val AND c{i}.{c} = t.{c}")
        prob += f" * CASE WHEN t.{c} = '{MARKER}' THEN 1.0 ELSE (coalesce(n_{i}, 0) + 5.0 / ({r} * {card(c)})) / (d.n + 5.0 / {r}) END"
    weight = "0.0"
    for i, c in enumerate(others):
        joins.append(f"LEFT JOIN {count([target, c], f'w_{i}')} AS o{i} ON o{i}.{target} = d.val AND o{i}.{c} = t.{c}")
        weight += f" + pow(coalesce(w_{i}, 0) * {float(len(columns) ** 2)}, 2)"
    inner = f"SELECT t.row_id, d.val, d.pos, {prob} AS probability, CASE WHEN d.val = '{MARKER}' THEN 0.0 ELSE sqrt({weight}) + 1 END AS c FROM {rows} AS t, (SELECT {target} AS val, min(row_id) AS pos, count(*) AS n FROM {train} GROUP BY 1) AS d {' '.join(joins)}"
    return f"SELECT row_id, val, pos, probability, coalesce(c / nullif(sum(c) OVER (PARTITION BY row_id), 0), 0) AS penalty FROM ({inner})"


def _best_sql(candidates: str) -> str:
    return f"SELECT row_id, val FROM (SELECT row_id, val, row_number() OVER (PARTITION BY row_id ORDER BY round(penalty * probability, 12) DESC, pos) AS p FROM ({candidates}) WHERE val <> '{MARKER}') WHERE p = 1"


_REGION = _repair_sql("dirty", "dirty", "r_name", ["n_name"], [], SMALL)
_NATION = _repair_sql("dirty", "dirty", "n_name", [], ["r_name"], SMALL)
_STEP = f", step AS (SELECT dirty.row_id, coalesce(b.val, n_name) AS n_name, r_name, c_mktsegment FROM dirty LEFT JOIN ({_best_sql(_NATION)}) AS b USING (row_id))"
_MATRIX = f"(SELECT lhs, rhs, score FROM ({_matrix(GEO, 'dirty')}))"
_SURE = " UNION ALL ".join(f"SELECT '{a}' AS lhs, '{b}' AS rhs, {0.9 if (a, b) in (('c_nationkey', 'n_name'), ('n_name', 'c_nationkey'), ('n_regionkey', 'r_name'), ('r_name', 'n_regionkey')) else 0.8 if a == 'n_name' and b in ('r_name', 'n_regionkey') else -0.9}::DOUBLE AS score" for a in GEO for b in GEO if a != b)
_BOTH = f"(SELECT lhs, rhs, coalesce(m.score, 0) AS afd, coalesce(s.score, 0) AS fd FROM {_MATRIX} AS m FULL JOIN ({_SURE}) AS s USING (lhs, rhs))"
_POSITIVE = f"(SELECT lhs, rhs, CASE WHEN afd <> 0 AND fd > 0 THEN afd ELSE 0.0 END AS score FROM {_BOTH})"
_TWO = f"(SELECT row_id, list_sort(list(probability), 'DESC') AS p FROM ({_REGION}) GROUP BY row_id)"
_FIRST_SECOND = f"(SELECT row_id, p[1] AS first, CASE WHEN coalesce(p[2], p[1]) = 0 THEN 1e-10 ELSE coalesce(p[2], p[1]) END AS second FROM {_TWO})"
_MARGIN = f"(SELECT row_id, CASE WHEN first / second > 0 THEN ln(first / second) ELSE 0 END AS margin FROM {_FIRST_SECOND})"
_SCALED = f"(SELECT row_id, CASE WHEN max(margin) OVER () > min(margin) OVER () THEN (margin - min(margin) OVER ()) / (max(margin) OVER () - min(margin) OVER ()) ELSE 0 END AS margin FROM {_MARGIN})"
_COOC_NR = "(SELECT row_id, CASE WHEN max(w) OVER () > min(w) OVER () THEN (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) ELSE w END AS w FROM (SELECT row_id, 9.0 * count(*) OVER (PARTITION BY n_name, r_name) AS w FROM dirty))"
_SCORES = f"(SELECT row_id, 'n_name' AS attr, w AS score FROM {_COOC_NR} UNION ALL SELECT row_id, 'r_name', (1 + margin) * w FROM {_COOC_NR} JOIN {_SCALED} USING (row_id) UNION ALL SELECT row_id, 'c_mktsegment', 0.5 FROM dirty)"
_FIXED = _group_repair(["n_regionkey", "r_name"], GEO, "dirty")
_DIFF = "(" + " UNION ALL ".join(f"SELECT d.row_id, '{c}' AS attr, d.{c} AS dirty, r.{c} AS repaired, t.{c} AS truth FROM dirty AS d JOIN fixed AS r USING (row_id) JOIN geo AS t USING (row_id)" for c in GEO) + ")"
_FLAGS = f"(SELECT *, dirty <> truth AS is_error, dirty <> repaired AS is_attempt, dirty <> truth AND dirty <> repaired AND repaired = truth AS is_correct FROM {_DIFF} WHERE dirty <> truth OR dirty <> repaired)"


def _shifted_sql(every: int) -> str:
    return f"SELECT geo.row_id, n_name, CASE WHEN geo.row_id % {every} = 3 THEN x.r_name ELSE geo.r_name END AS r_name, c_mktsegment FROM geo JOIN region AS x ON x.r_regionkey = (CAST(n_regionkey AS INT) + 1) % 5"


def _metrics_sql(rows: str, fixed: str, columns: list[str] = SMALL) -> str:
    """errors, attempts, correct, f1, precision, recall, detection_rate over the columns."""
    cells = " UNION ALL ".join(f"SELECT d.{c} AS d, r.{c} AS r, t.{c} AS t FROM ({rows}) AS d JOIN ({fixed}) AS r USING (row_id) JOIN geo AS t USING (row_id)" for c in columns)
    inner = f"SELECT count(*) FILTER (WHERE d <> t) AS errors, count(*) FILTER (WHERE d <> r) AS attempts, count(*) FILTER (WHERE d <> t AND d <> r AND r = t) AS correct FROM ({cells})"
    return f"SELECT *, CASE WHEN correct = 0 THEN 0 ELSE 2.0 * correct / (attempts + errors) END AS f1, coalesce(correct / nullif(attempts, 0), 0) AS precision, coalesce(correct / nullif(errors, 0), 0) AS recall, coalesce(attempts / nullif(errors, 0), 0) AS detection_rate FROM ({inner})"


def _sweep_sql(every: int) -> str:
    rows = f"({_shifted_sql(every)})"
    step = f"(SELECT d.row_id, coalesce(b.val, n_name) AS n_name, r_name, c_mktsegment FROM {rows} AS d LEFT JOIN ({_best_sql(_repair_sql(rows, rows, 'n_name', [], ['r_name'], SMALL))}) AS b USING (row_id))"
    fixed = f"SELECT d.row_id, n_name, coalesce(b.val, r_name) AS r_name, c_mktsegment FROM {step} AS d LEFT JOIN ({_best_sql(_repair_sql(step, rows, 'r_name', ['n_name'], [], SMALL))}) AS b USING (row_id)"
    return f"SELECT {every} AS every, errors, correct, round(f1, 6) AS f1 FROM ({_metrics_sql(rows, fixed)})"


_KEPT = ", " + ", ".join(f"sh{e} AS ({_shifted_sql(e)}), vo{e} AS ({_group_repair(list(EDGES[0]), SMALL, f'sh{e}')}), me{e} AS ({_metrics_sql(f'SELECT * FROM sh{e}', f'SELECT * FROM vo{e}')})" for e in (10, 20, 40)) + ", kept AS (" + " UNION ALL ".join(f"SELECT 'ratio-{e}' AS experiment, '{d}' AS dataset, errors, attempts, correct, {f} AS f1, precision, recall, detection_rate FROM me{e}" for e in (10, 20, 40) for d, f in (("customers", "f1"), ("nothing", "0.0"))) + ")"
_CHECKED = f"SELECT dirty.row_id, 'r_name' AS attr, b.val AS original, b.val AS corrected, 'low' AS confidence, 'offline' AS reasoning, false AS applied, true AS success FROM dirty JOIN ({_best_sql(_REGION)}) AS b USING (row_id) WHERE r_name <> b.val"
_FACTS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(penalty * probability, 12) DESC, pos) AS p FROM ({_REGION}) WHERE val <> '{MARKER}') WHERE p = 1)"


def _chain_sql(first: str, columns: list[str], edges: list[tuple[str, str]], targets: list[str]) -> tuple[list[str], str]:
    """CTEs that repair the targets of table ``first`` in turn, and the last one's name."""
    ctes, last = [], first
    for i, t in enumerate(targets):
        parents, children = ([a for a, b in edges if b == t], [b for a, b in edges if a == t])
        best = _best_sql(_repair_sql(last, first, t, parents, children, columns))
        ctes.append(f"{first}_{i} AS MATERIALIZED (SELECT d.* REPLACE (coalesce(b.val, d.{t}) AS {t}) FROM {last} AS d LEFT JOIN ({best}) AS b USING (row_id))")
        last = f"{first}_{i}"
    return ctes, last


def _wide_sql() -> str:
    made = "left(n_name, 1) AS n_first, CAST(length(n_name) AS VARCHAR) AS n_length, left(r_name, 1) AS r_first, CAST(length(r_name) AS VARCHAR) AS r_length, left(d.c_mktsegment, 1) AS s_first, CAST(length(d.c_mktsegment) AS VARCHAR) AS s_length, CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS balance, CASE WHEN (c_acctbal < 0) <> (row_id % 30 = 4) THEN '-' ELSE '+' END AS sign, CAST(row_id % 3 AS VARCHAR) AS third, CAST(row_id % 5 AS VARCHAR) AS fifth"
    ctes, last = _chain_sql("w0", WIDE, WIDE_EDGES, WIDE_TARGETS)
    return f", {', '.join([f"w0 AS MATERIALIZED (SELECT d.*, {made} FROM dirty AS d JOIN customer ON c_custkey = row_id)"] + ctes)} SELECT row_id, {', '.join(WIDE_TARGETS)} FROM {last}"


_VOTED, _LAST = _chain_sql("voted", GEO, KNOWN.edges, KNOWN_TARGETS)
_INFERRED = ", " + ", ".join([f"voted AS MATERIALIZED ({_FIXED})", *_VOTED])
_PLACES = f", one AS MATERIALIZED ({_group_repair(PLACES[:2], PLACES, 'dirty')}), two AS MATERIALIZED ({_group_repair(PLACES[2:], PLACES, 'one')}), every AS ({_metrics_sql('SELECT * FROM dirty', 'SELECT * FROM two', PLACES)}), nothing AS ({_metrics_sql('SELECT * FROM dirty', 'SELECT * FROM dirty', PLACES)})"


_NEAR = f", near AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 11 = 5 THEN '{MARKER}' ELSE CAST(CAST(floor(c_acctbal / 10) AS BIGINT) AS VARCHAR) END AS tens, CAST(CAST(floor(floor(c_acctbal / 10) / 10) AS BIGINT) AS VARCHAR) AS hundreds, CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END AS sign, c_mktsegment FROM customer)"
_SHARED = " + ".join(f"CAST(x.{c} = y.{c} AND x.{c} <> '{MARKER}' AS INTEGER)" for c in GEO if c != "n_name")


def _conflict_sql(place: int, lhs: str, rhs: str) -> str:
    """place, row_id, conflicts, major of the rows of broken classes."""
    sums = f"SELECT row_id, {lhs}, {rhs}, count(*) OVER (PARTITION BY {lhs}) - count(*) OVER (PARTITION BY {lhs}, {rhs}) AS conflicts, count(*) OVER (PARTITION BY {lhs}, {rhs}) AS own FROM dirty"
    return f"SELECT {place} AS place, row_id, conflicts, row_number() OVER (PARTITION BY {lhs} ORDER BY own DESC, {rhs}) AS rank, {rhs} = first_value({rhs}) OVER (PARTITION BY {lhs} ORDER BY own DESC, {rhs}) AS major FROM ({sums}) WHERE conflicts > 0"


_CONFLICTS = " UNION ALL ".join(_conflict_sql(i, lhs[0], rhs) for i, (lhs, rhs) in enumerate(CHECKED))
_SUSPECTS = f"SELECT DISTINCT row_id FROM ({_CONFLICTS}) WHERE NOT major"


def _errors_sql(most: int, error: float) -> str:
    """lhs, rhs, error of the minimal dependencies among the dirty table's columns."""
    cases = [(lhs, rhs) for n in range(most + 1) for lhs in combinations(GEO, n) for rhs in GEO if rhs not in lhs]
    one = lambda lhs, rhs: f"SELECT {list(lhs)!r}::VARCHAR[] AS l, '{rhs}' AS rhs, sum(lost) / (SELECT count(*) FROM dirty) AS error FROM (SELECT sum(n) - max(n) AS lost FROM (SELECT {', '.join([*lhs, '1 AS one'])}, count(*) AS n FROM dirty GROUP BY {', '.join([*lhs, rhs])}) GROUP BY {', '.join([*lhs, 'one'])})"
    return f", e AS ({' UNION ALL '.join(one(*c) for c in cases)}), v AS (SELECT * FROM e WHERE error <= {error}) SELECT array_to_string(l, ',') AS lhs, rhs, round(error, 6) AS error FROM v WHERE NOT EXISTS (SELECT 1 FROM v AS x WHERE x.rhs = v.rhs AND len(x.l) < len(v.l) AND list_has_all(v.l, x.l))"


def _score_sql(child: str, parents: list[str]) -> str:
    q = " * ".join([f"(SELECT count(DISTINCT {p}) FROM dirty)" for p in parents] or ["1"])
    r = f"(SELECT count(DISTINCT {child}) FROM dirty)"
    part = lambda by, alpha: f"(SELECT sum(lgamma(n + {alpha}) - lgamma({alpha})) FROM (SELECT {', '.join([*by, '1 AS one'])}, count(*) AS n FROM dirty GROUP BY {', '.join([*by, 'one'])}))"
    return f"SELECT '{child}' AS child, '{','.join(parents)}' AS parents, round({part([*parents, child], f'(50.0 / ({q} * {r}))')} - {part(parents, f'(50.0 / ({q}))')}, 4) AS score"


_RIGHT = ", right_rows AS (SELECT dirty.* REPLACE (geo.r_name AS r_name) FROM dirty JOIN geo USING (row_id))"
_WEEKS = ", ev AS (SELECT CAST(epoch(time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, CAST(user_id % 3 AS VARCHAR) AS \"user\" FROM events)"


def _weekly_sql(lhs: str, rhs: str) -> str:
    pdep = f"SELECT start, sum(sq / nx) / sum(nx) AS pdep, count(*) AS dx, sum(nx) AS n FROM (SELECT start, {lhs}, sum(n) AS nx, sum(CAST(n AS DOUBLE) * n) AS sq FROM (SELECT start, {lhs}, {rhs}, count(*) AS n FROM ev GROUP BY ALL) GROUP BY ALL) GROUP BY start"
    own = f"SELECT start, sum(CAST(n AS DOUBLE) * n) / pow(sum(n), 2) AS own FROM (SELECT start, {rhs}, count(*) AS n FROM ev GROUP BY ALL) GROUP BY start"
    return f"SELECT start, {lhs!r} AS lhs, {rhs!r} AS rhs, greatest(0.0, CASE WHEN n = dx OR own = 1 THEN 0.0 ELSE 1 - (1 - pdep) / (1 - own) * CAST(n - 1 AS DOUBLE) / (n - dx) END) AS score FROM ({pdep}) JOIN ({own}) USING (start)"


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_CONTEXT = f"SELECT dirty.row_id, 'r_name=' || val || CASE WHEN n_name = '{MARKER}' THEN ' on its own' ELSE ' given n_name=' || n_name END || ': ' || printf('%.1f%%', probability * 100) AS context FROM dirty JOIN {_FACTS} AS c USING (row_id)"


SQL = {
    k: _VIEWS + v
    for k, v in {
        "mu_plus_matrix": f"SELECT lhs, rhs, {_r('score')} FROM {_MATRIX}",
        "mu_plus_matrix_orders": f"SELECT lhs, rhs, {_r('score')} FROM ({_matrix(['o_orderstatus', 'o_orderpriority', *GEO], 'ord')})",
        "scan_project_fill": "SELECT row_id, n_name, r_name FROM dirty",
        "paired_scan": "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, d.r_name AS dirty_value, g.r_name AS clean_value FROM dirty AS d JOIN geo AS g USING (row_id)",
        "cells_unpivot": " UNION ALL ".join(f"SELECT row_id, '{c}' AS attr, {c} AS val FROM dirty" for c in SMALL),
        "value_histogram": " UNION ALL ".join(f"SELECT '{c}' AS attr, {c} AS val, count(*) AS n FROM dirty GROUP BY ALL" for c in GEO),
        "domain_first_appearance": "SELECT n_name AS val, min(row_id) AS pos, count(*) AS n FROM dirty GROUP BY 1",
        "domain_size": f"SELECT {', '.join(f'count(DISTINCT {c}) AS {c}' for c in GEO)} FROM dirty",
        "pdep_self": f"SELECT round(own, 6) AS pdep FROM {_own('r_name', 'dirty')}",
        "pdep_single": f"SELECT {_r('pdep')} FROM {_dep(['n_name'], 'r_name', 'dirty')}",
        "pdep_multi_lhs": f"SELECT {_r('pdep')} FROM {_dep(['n_name', 'c_mktsegment'], 'r_name', 'dirty')}",
        "mu": f"SELECT {_r('mu')} FROM ({_mu(['n_name'], 'r_name', 'dirty')})",
        "mu_plus": f"SELECT round(greatest(0.0, mu), 6) AS mu_plus FROM ({_mu(['turn'], 'role', 'talks')})",
        "pair_counts": _pairs(["o_orderstatus", "n_name", "r_name"], "ord"),
        "cooccurrence": _cooc(SMALL, "dirty"),
        "cooc_lookup": "SELECT 9 * count(*) AS w FROM dirty WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'",
        "value_total_occurrences": " UNION ALL ".join(f"SELECT '{c}' AS attr, {c} AS val, 18 * count(*) AS total FROM dirty GROUP BY ALL" for c in SMALL),
        "mode_per_group": _mode("n_name", "r_name", "dirty"),
        "consistency_vote": f"SELECT dirty.row_id, n_name, inferred FROM dirty LEFT JOIN ({_vote(['c_nationkey', 'n_name', 'r_name'], 'n_name', 'dirty')}) AS v USING (row_id)",
        "consistency_repair": f", first AS ({_group_repair(['c_nationkey', 'n_name'], GEO, 'dirty')}) {_group_repair(['n_regionkey', 'r_name'], GEO, 'first')}",
        "matrix_align": f"SELECT lhs, rhs, {_r('afd')}, fd FROM {_BOTH}",
        "fd_positive_mask": f"SELECT lhs, rhs, {_r('score')} FROM {_POSITIVE}",
        "fd_hybrid_score": f"SELECT lhs, rhs, round(CASE WHEN fd < 0 AND afd > 0.1 THEN afd * (1 + fd) ELSE afd END, 6) AS score FROM {_BOTH}",
        "fd_best_parent": f"SELECT rhs, lhs AS parent, {_r('score')} FROM (SELECT *, row_number() OVER (PARTITION BY rhs ORDER BY score DESC, list_position({GEO}, lhs)) AS p FROM {_POSITIVE}) WHERE p = 1",
        "row_distance": f"SELECT x.lhs AS a, y.lhs AS b, round(sqrt(sum(pow(x.score - y.score, 2))), 6) AS distance FROM {_MATRIX} AS x JOIN {_MATRIX} AS y ON x.rhs = y.rhs AND x.lhs <> y.lhs GROUP BY ALL",
        "llm_only_edges": f"SELECT lhs AS parent, rhs AS child FROM {_MATRIX} WHERE score > 0.5",
        "weak_partition_filter": f"SELECT 'n_name' AS node, greatest(0.0, mu) >= 0.25 AS kept FROM ({_mu(['r_name'], 'n_name', 'dirty')}) UNION ALL SELECT 'r_name', greatest(0.0, mu) >= 0.25 FROM ({_mu(['n_name'], 'r_name', 'dirty')}) UNION ALL SELECT 'c_mktsegment', true",
        "bdeu_family_score": ", q AS (SELECT 50.0 / count(DISTINCT n_name) AS aj, 50.0 / (count(DISTINCT n_name) * count(DISTINCT r_name)) AS ak FROM dirty) SELECT round((SELECT sum(lgamma(n + ak) - lgamma(ak)) FROM (SELECT count(*) AS n FROM dirty GROUP BY n_name, r_name), q) - (SELECT sum(lgamma(n + aj) - lgamma(aj)) FROM (SELECT count(*) AS n FROM dirty GROUP BY n_name), q), 4) AS score",
        "cpd_bdeu": "SELECT n_name, r_name, round((n + 5.0 / ((SELECT count(DISTINCT n_name) FROM dirty) * (SELECT count(DISTINCT r_name) FROM dirty))) / (sum(n) OVER (PARTITION BY n_name) + 5.0 / (SELECT count(DISTINCT n_name) FROM dirty)), 6) AS p FROM (SELECT n_name, r_name, count(*) AS n FROM dirty GROUP BY ALL)",
        "compensation": f"SELECT row_id, val, {_r('penalty')} FROM ({_REGION})",
        "bn_probability": f"SELECT row_id, val, {_r('probability')} FROM ({_NATION})",
        "repair_single_column": f"SELECT row_id, val AS r_name FROM ({_best_sql(_REGION)})",
        "repair_sequential": f"{_STEP} SELECT step.row_id, n_name, coalesce(b.val, r_name) AS r_name, c_mktsegment FROM step LEFT JOIN ({_best_sql(_repair_sql('step', 'dirty', 'r_name', ['n_name'], [], SMALL))}) AS b USING (row_id)",
        "repair_log": f"SELECT dirty.row_id, 'r_name' AS attr, r_name AS old, b.val AS new FROM dirty JOIN ({_best_sql(_REGION)}) AS b USING (row_id) WHERE r_name <> b.val",
        "query_context": _CONTEXT,
        "max_second_max": f"SELECT row_id, {_r('first', 'second')} FROM {_FIRST_SECOND}",
        "pro_map": f"SELECT row_id, {_r('margin')} FROM {_SCALED}",
        "confidence_scores": f"SELECT row_id, attr, {_r('score')} FROM {_SCORES}",
        "low_confidence_bottom_k": f"SELECT row_id, attr, {_r('score')} FROM {_SCORES} ORDER BY round(score, 6), row_id, list_position({SMALL}, attr) LIMIT 50",
        "cell_diff": f", fixed AS ({_FIXED}) SELECT * FROM {_FLAGS}",
        "evaluation_metrics": f", fixed AS ({_FIXED}), k AS (SELECT count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE is_attempt) AS attempts, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE is_error AND NOT is_attempt) AS missed, count(*) FILTER (WHERE is_attempt AND NOT is_correct) AS wrong FROM {_FLAGS}), m AS (SELECT *, coalesce(correct / nullif(attempts, 0), 0) AS precision, coalesce(correct / nullif(errors, 0), 0) AS recall, coalesce(attempts / nullif(errors, 0), 0) AS detection_rate FROM k) SELECT errors, attempts, correct, missed, wrong, {_r('precision', 'recall', 'detection_rate')}, round(precision, 6) AS repair_accuracy, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM m",
        "experiment_summary": _KEPT + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM kept WHERE experiment = 'ratio-20'" for m, c in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("detection_rate", "detection_rate"), ("repair_accuracy", "precision"))),
        "best_of_experiments": _KEPT + " SELECT CAST(substr(experiment, 7) AS INTEGER) AS place, round(f1, 6) AS f1 FROM kept WHERE dataset = 'customers' ORDER BY kept.f1 DESC, place LIMIT 1",
        "json_fix": "SELECT o_orderkey, '{\"corrected\": \"' || o_orderkey || '\", \"confidence\": \"high\"}' AS fixed FROM orders",
        "model_short_name": "SELECT s_suppkey, s_name AS short FROM supplier",
        "head_n": "SELECT * FROM geo WHERE row_id < 100",
        "llm_stub_clean": _CHECKED,
        "repair_wide": _wide_sql(),
        "repair_facts": f"SELECT row_id, 'r_name' AS attr, val, {_r('probability', 'margin')} FROM {_FACTS} JOIN {_MARGIN} USING (row_id)",
        "repair_counters": f", c AS ({_CHECKED}) SELECT count(*) AS changed, count(*) AS asked, 0::BIGINT AS applied, 0::BIGINT AS high, 0::BIGINT AS medium FROM c",
        "table_hash": f", h AS (SELECT CAST('0x' || substr(md5(concat_ws(chr(1), row_id, {', '.join(GEO)})), 1, 15) AS BIGINT) AS h FROM dirty) SELECT substr(md5(concat_ws('-', bit_xor(h), CAST(sum(h % 2147483648) AS BIGINT), count(*))), 1, 12) AS hash FROM h",
        "results_by_f1": _KEPT + " SELECT experiment, dataset, round(f1, 6) AS f1 FROM kept",
        "results_recent": _KEPT + " SELECT experiment, count(*) AS datasets, round(avg(f1), 6) AS mean_f1 FROM kept GROUP BY experiment ORDER BY experiment DESC LIMIT 2",
        "results_latest": "SELECT 'ratio-40' AS experiment",
        "results_export": _KEPT + " SELECT dataset, errors, attempts, correct, round(f1, 6) AS f1 FROM kept WHERE experiment = 'ratio-20'",
        "pipeline_known_structure": f"{_INFERRED} SELECT errors, attempts, correct, {_r('precision', 'recall', 'f1', 'detection_rate')} FROM ({_metrics_sql('SELECT * FROM dirty', f'SELECT * FROM {_LAST}', GEO)})",
        "inference_state": f"{_INFERRED} SELECT row_id, {', '.join(GEO)} FROM {_LAST}",
        "ablation_impact": _PLACES + " " + " UNION ALL ".join(f"SELECT '{p}' AS part, m.errors, m.attempts, m.correct, round(m.f1, 6) AS f1, round(e.f1 - m.f1, 6) AS f1_loss FROM {m} AS m, every AS e" for p, m in (("all", "every"), ("supplied", "nothing"), ("groups", "nothing"), ("compensation", "every"), ("weak filter", "every"))),
        "parameter_search": _PLACES + " SELECT CAST(place AS INTEGER) AS place, alpha, beta, round(f1, 6) AS f1 FROM every, (VALUES (0, 0.1::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.5), (2, 0.2, 0.1), (3, 0.2, 0.5)) AS v(place, alpha, beta)",
        "stream_repair": _STEP + f" SELECT step.row_id, n_name, coalesce(b.val, r_name) AS r_name, c_mktsegment FROM step LEFT JOIN ({_best_sql(_repair_sql('step', 'dirty', 'r_name', ['n_name'], [], SMALL))}) AS b USING (row_id)",
        "repair_near_key": _NEAR + f" SELECT row_id, val AS tens FROM ({_best_sql(_repair_sql('near', 'near', 'tens', ['hundreds'], [], NEAR))})",
        "csv_line_ends": "SELECT CAST(row_id AS VARCHAR) AS id, n_name || ',' || chr(10) || '\"' || r_name || '\"' || chr(10) || chr(10) || row_id AS text FROM dirty",
        "dataset_source": "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, n_name, r_name FROM dirty",
        "similar_rows": f"SELECT x.row_id, 'n_name' AS attr, CAST(row_number() OVER (PARTITION BY x.row_id ORDER BY {_SHARED} DESC, y.row_id) AS INTEGER) AS rank, y.row_id AS other_id, {_SHARED} AS shared FROM dirty AS x JOIN dirty AS y ON x.row_id <> y.row_id WHERE x.n_name = '{MARKER}' AND {_SHARED} > 0 QUALIFY rank <= 3",
        "find_dependencies": _errors_sql(2, 0.06),
        "generated_dependencies": "SELECT lhs, rhs, round(CASE WHEN unique_lhs THEN 0 WHEN error <= 0.1 THEN 1 - error / 0.2 ELSE -error END, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS lhs, '{b}' AS rhs, (SELECT count(DISTINCT {a}) = count(*) FROM dirty) AS unique_lhs, (SELECT 1 - sum(m) / sum(n) FROM (SELECT max(n) AS m, sum(n) AS n FROM (SELECT {a}, {b}, count(*) AS n FROM dirty GROUP BY ALL) GROUP BY {a})) AS error" for a in GEO for b in GEO if a != b) + ")",
        "clean_generated": _PLACES + " SELECT errors, attempts, correct, round(f1, 6) AS f1 FROM every",
        "dependency_violations": f"SELECT place, row_id, conflicts FROM ({_CONFLICTS})",
        "suspect_rows": _SUSPECTS,
        "error_detection": f", w AS (SELECT row_id FROM dirty EXCEPT SELECT row_id FROM (SELECT * FROM dirty INTERSECT SELECT * FROM geo)), t AS ({_SUSPECTS}), k AS (SELECT (SELECT count(*) FROM w) AS errors, (SELECT count(*) FROM t) AS suspected, (SELECT count(*) FROM w JOIN t USING (row_id)) AS hits) SELECT *, round(hits / suspected, 6) AS precision, round(hits / errors, 6) AS recall FROM k",
        "contingency_scores": "SELECT * FROM (" + " UNION ALL ".join(_score_sql(c, list(ps)) for c in SMALL for n in range(3) for ps in combinations([o for o in SMALL if o != c], n)) + ")",
        "checked_cells_with_failures": f"SELECT row_id, attr, original, corrected, row_id % 7 <> 0 AS success, CASE WHEN row_id % 7 = 0 THEN 'ValueError: no answer' END AS error FROM ({_CHECKED})",
        "ablation_with_checks": _PLACES + " " + " UNION ALL ".join(f"SELECT '{p}' AS part, m.errors, m.attempts, m.correct, round(m.f1, 6) AS f1, round(e.f1 - m.f1, 6) AS f1_loss FROM {m} AS m, every AS e" for p, m in (("all", "every"), ("supplied", "nothing"), ("groups", "nothing"), ("compensation", "every"), ("weak filter", "every"), ("checks", "every"))),
        "stream_counts": _RIGHT + " " + _pairs(SMALL, "right_rows"),
        "stream_mu_plus": _RIGHT + f" SELECT lhs, rhs, round(score, 6) AS score FROM ({_matrix(SMALL, 'right_rows')})",
        "stream_windows": _WEEKS + ' SELECT start, event_type AS va, "user" AS vb, count(*) AS n FROM ev WHERE start + 7 * 86400 <= (SELECT epoch(max(ts)) FROM events) - 86400 GROUP BY ALL',
        "window_drift": _WEEKS + f" SELECT start, lhs, rhs, round(score, 6) AS score, round(score - lag(score) OVER (PARTITION BY lhs, rhs ORDER BY start), 6) AS change FROM ({_weekly_sql('event_type', 'user')} UNION ALL {_weekly_sql('user', 'event_type')})".replace(" user", ' "user"').replace('(PARTITION BY lhs', '(PARTITION BY lhs'),
        "asked_dependencies": ", shown AS (SELECT * FROM dirty ORDER BY md5('1234:' || row_id), row_id LIMIT 10) SELECT lhs, rhs, round(CASE WHEN l = b THEN 1 - l / 20 ELSE l / b - 1 END, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS lhs, '{b}' AS rhs, count(DISTINCT {a}) AS l, count(DISTINCT ({a}, {b})) AS b FROM shown" for a in GEO for b in GEO if a != b) + ")",
        "cell_questions": f"SELECT row_id, 'Column r_name holds ''' || b.val || ''' where n_name=' || n_name || '. Inferred: ' || context || '. Is it right? Answer in JSON with corrected, confidence (high, medium or low) and reasoning.' AS question FROM dirty JOIN ({_best_sql(_REGION)}) AS b USING (row_id) JOIN ({_CONTEXT}) USING (row_id) WHERE r_name <> b.val",
        "check_budget": f", c AS ({_CHECKED}) SELECT v.ratio, v.most, least((SELECT count(*) FROM c), CASE WHEN v.most > 0 THEN v.most ELSE CAST(floor((SELECT count(*) * 3 FROM dirty) * v.ratio) AS BIGINT) END) AS budget FROM (VALUES (0.01::DOUBLE, 0::BIGINT), (0.5, 0), (0.01, 7)) AS v(ratio, most)",
        "dataset_catalogue": "SELECT 'bare' AS dataset, NULL AS variant, NULL::BIGINT AS dirty_rows, count(*) AS clean_rows, false AS valid, 'no dirty file; row counts differ' AS errors FROM geo UNION ALL SELECT 'shop', NULL, count(*), count(*), true, '' FROM geo UNION ALL SELECT 'shop', 'half', count(*) FILTER (WHERE row_id % 2 = 0), count(*), false, 'row counts differ' FROM geo",
        "table_cache": f"SELECT 'counts' AS category, 'values' AS key, CAST(sum(n) AS BIGINT) AS rows FROM ({' UNION ALL '.join(f'SELECT count(DISTINCT {c}) AS n FROM dirty' for c in GEO)}) UNION ALL SELECT 'counts', 'pairs', count(*) FROM ({_pairs(SMALL, 'dirty')})",
        "matrix_file": f"SELECT lhs, rhs, {_r('score')} FROM {_MATRIX}",
        "structure_file": f"SELECT lhs AS parent, rhs AS child FROM {_MATRIX} WHERE score > 0.5",
        "repaired_file": f"SELECT * REPLACE (row_number() OVER (ORDER BY row_id) - 1 AS row_id) FROM ({_FIXED})",
        "evaluation_file": f", fixed AS ({_FIXED}) SELECT row_id, attr, is_error AND NOT is_attempt AS missed, is_attempt AND NOT is_correct AS wrong FROM {_FLAGS}",
        "error_ratio_sweep": " UNION ALL ".join(_sweep_sql(k) for k in (10, 20, 40)),
    }.items()
}
