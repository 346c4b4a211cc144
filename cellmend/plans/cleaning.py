"""The whole repair: dependencies, structure, votes, network repair, check of unsure cells, evaluation; and experiments over it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions.text import parse_answer
from cellmend.operators import confidence, consistency, context, discovery, evaluation, network, repair, stats, structure
from cellmend.operators.structure import Matrix, Structure
from cellmend.plans.questions import Asking, Provider, ask_dependencies, each
from cellmend.sources.scratch import stored, temporary
from cellmend.sources.tables import TableCache

METHODS = ("hybrid", "hybrid_no_groups", "search_only", "supplied_only", "edges")


@dataclass(frozen=True)
class Settings:
    """``method``: hybrid, hybrid_no_groups (no votes), search_only, supplied_only or edges (those given). ``generate``: where no matrix is
    supplied, make one from the data, taking pairs of columns of so small an error as dependencies (0: don't)."""

    method: str = "hybrid"
    alpha: float = 0.1
    beta: float = 0.1
    gamma: float = 0.25
    score_size: float = network.SCORE_SIZE
    cpd_size: float = network.CPD_SIZE
    use_compensation: bool = True
    use_weak_filter: bool = True
    use_search: bool = True
    check_ratio: float = 0.01
    check_most: int = 0
    first_rows: int = 0
    context_rows: bool = True
    generate: float = 0.0
    marker: str = stats.MARKER
    edges: tuple[tuple[str, str], ...] = ()


@dataclass
class Inferred:
    """What the networks' repair knows: the table, the changed cells and the facts of all evaluated ones (see ``repair``)."""

    structure: Structure
    edges: list[tuple[str, str]]
    relations: dict[str, list[str]]
    repaired: DataFrame
    changed: DataFrame
    facts: DataFrame


@dataclass
class Result:
    structure: Structure
    edges: list[tuple[str, str]]
    repaired: DataFrame
    checked: DataFrame | None = None
    metrics: DataFrame | None = None
    counters: DataFrame | None = None


def keep_all(cells: pd.DataFrame) -> pd.Series:
    """The offline provider: every value is confirmed."""
    return cells["value"].map(lambda v: '```json\n{"corrected": ' + json.dumps(v) + ', "confidence": "low", "reasoning": "offline",}\n```')


def relations(edges: list[tuple[str, str]], networks: dict[str, network.Local]) -> dict[str, list[str]]:
    """For each column those it is related to: the other ends of its edges in their order, then its parents and children in its network."""
    out: dict[str, list[str]] = {}
    pairs = [p for a, b in edges for p in ((a, b), (b, a))] + [(n, c) for n, x in networks.items() for c in x.parents + x.children]
    for a, b in pairs:
        out.setdefault(a, [])
        if b not in out[a]:
            out[a].append(b)
    return out | {n: [] for n in networks if n not in out}


def check_cells(repaired: DataFrame, chosen: DataFrame, related: dict[str, list[str]], columns: list[str], provider: Provider = keep_all, asking: Asking = Asking(), facts: DataFrame | None = None, context: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ask the provider about the chosen (row_id, attr) cells; answers of high or medium confidence are written.

    The provider sees row_id, attr, value, related, inference and question. A question holds the cell's value, the row's values of related
    columns (of all columns where none are related), from ``facts`` how likely the inference found it, and from
    ``context(row_id, attr, rows)`` other rows of the table. All questions read the table as it came. Cells that the table lacks are left
    out. Each cell is asked on its own: one that fails to the end keeps its value with low confidence, and its error. An answer is in the
    ledger as soon as it is there, so a task that runs again asks only what is missing. The second table has a row for each question.
    """
    known = chosen.where(F.col("attr").isin(columns)).select("row_id", "attr").distinct()
    listed = lambda names: F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in names])
    near = F.create_map(*[x for c in columns for x in (F.lit(c), listed([o for o in related.get(c, []) if o in columns] or columns))])
    value = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])
    asked = repaired.join(known.hint("merge"), "row_id").select("row_id", "attr", value[F.col("attr")].alias("value"), near[F.col("attr")].alias("related"))
    told = facts.select("row_id", "attr", "context") if facts is not None else known.limit(0).withColumn("context", F.lit(""))
    asked = asked.join(told.hint("merge"), ["row_id", "attr"], "left").withColumn("inference", F.coalesce("context", F.lit(""))).drop("context")
    if context is not None:
        asked = asked.join(context.select("row_id", "attr", "rows").hint("merge"), ["row_id", "attr"], "left")
    rows = F.col("rows") if context is not None else F.lit(None).cast("string")
    more = lambda head, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(head), text)).otherwise(F.lit(""))
    question = F.concat(F.lit("Column "), "attr", F.lit(" holds '"), "value", F.lit("' where "), "related", more(". Inferred: ", F.col("inference")), more(". Other rows, which may be wrong as well: ", rows), F.lit(". Is it right? Answer in JSON with corrected, confidence (high, medium or low) and reasoning."))
    asked = asked.withColumn("question", question).drop("rows")
    ledger = asking.answers(repaired)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, found in each(batches, provider, asking, ledger, lambda c: (int(c["row_id"]), c["attr"], c["question"])):
            yield pd.DataFrame({"row_id": batch["row_id"], "attr": batch["attr"], "original": batch["value"], "raw": [f[0] for f in found], "error": [f[1] for f in found]})

    asked = asked.repartition(asking.tasks, "row_id", "attr")
    # stored: the table and the log read one set of answers
    answers = stored(asked.mapInPandas(ask, "row_id long, attr string, original string, raw string, error string")).withColumn("a", parse_answer(F.col("raw")))
    fine = F.col("error").isNull() & F.col("a").isNotNull()
    confident = F.lower(F.coalesce(F.col("a.confidence"), F.lit("low")))
    log = answers.select("row_id", "attr", "original", F.coalesce(F.col("a.corrected"), F.col("original")).alias("corrected"), confident.alias("confidence"), F.col("a.reasoning").alias("reasoning"), (fine & confident.isin("high", "medium") & F.col("a.corrected").isNotNull()).alias("applied"), fine.alias("success"), "error")
    wide = log.where("applied").groupBy("row_id").pivot("attr", columns).agg(F.first("corrected"))
    wide = wide.select("row_id", *[F.col(f"`{c}`").alias(f"new_{c}") for c in columns])
    return repaired.join(wide.hint("merge"), "row_id", "left").select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in repaired.columns]), log


def find_structure(dirty: DataFrame, supplied: DataFrame | None, columns: list[str], s: Settings) -> Structure:
    """By the settings' method. The two matrices, a row for each pair of columns, come to the driver."""
    if s.method == "edges":
        return Structure(columns, [], list(s.edges))
    if supplied is None and s.generate > 0:
        supplied = discovery.generated_matrix(dirty, columns, s.generate)
    if s.method == "search_only" or supplied is None:
        return Structure(columns)
    if s.method == "supplied_only":
        return Structure(columns, [], [tuple(r) for r in structure.supplied_edges(supplied).orderBy("parent", "child").collect()])
    found = structure.construct(structure.as_matrix(stats.mu_plus_matrix(dirty, columns)), structure.as_matrix(supplied), columns, s.alpha, s.beta)
    return replace(found, groups=[]) if s.method == "hybrid_no_groups" else found


def infer(dirty: DataFrame, columns: list[str], supplied: DataFrame | None = None, settings: Settings = Settings(), found: Structure | None = None) -> Inferred:
    """Votes and network repair. ``found``: a structure to use instead of finding one. Columns of a group are voted on and, but for each
    group's first, left alone by the network. ``first_rows`` limits the network's repair to the rows below that id."""
    s = settings
    found = found or find_structure(dirty, supplied, columns, s)
    voted = stored(consistency.repair_consistency(dirty, found.groups, s.marker))
    edges = network.hill_climb(voted, columns, found.edges, s.score_size) if s.use_search and s.method != "supplied_only" else list(found.edges)
    networks = network.local_networks(columns, edges)
    if s.use_weak_filter:
        networks = network.filter_weak(networks, structure.as_matrix(stats.mu_plus_matrix(voted, columns)), s.gamma)
    skip = set(consistency.repaired_by_groups(found.groups))
    targets = [c for c in columns if c in networks and c not in skip]
    rows = stats.head_rows(voted, s.first_rows) if s.first_rows > 0 else voted
    repaired, changed, facts = repair.repair_with_facts(rows, networks, columns, targets, voted, s.use_compensation, s.cpd_size, s.marker)
    return Inferred(found, edges, relations(found.edges, networks), repaired, stored(changed), facts)


def check(state: Inferred, columns: list[str], settings: Settings, provider: Provider, asking: Asking = Asking()) -> tuple[DataFrame, DataFrame]:
    """``check_cells`` on the least confident of the changed cells, as many as the budget allows, with similar, near and random rows."""
    scores = confidence.confidence_scores(state.repaired, stats.cooccurrence(state.repaired, columns), state.structure.edges, columns, state.facts.select("row_id", "attr", "margin"))
    scores = scores.join(state.changed.select("row_id", "attr").hint("merge"), ["row_id", "attr"], "left_semi")
    k = confidence.budget(state.repaired.count() * len(columns), settings.check_ratio, settings.check_most, state.changed.count())
    chosen = stored(confidence.least_confident(scores, columns, k).select("row_id", "attr"))
    rows = context.context_rows(state.repaired, chosen, columns, state.relations) if settings.context_rows else None
    return check_cells(state.repaired, chosen, state.relations, columns, provider, asking, state.facts, rows)


def repair_counters(changed: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row: cells that inference changed, and of the checked ones how many were asked, applied, and sure to a high or medium degree."""
    counts = changed.agg(F.count("*").alias("changed"))
    if log is None:
        return counts.select("changed", *[F.lit(0).cast("long").alias(c) for c in ("asked", "applied", "high", "medium")])
    sure = lambda level: F.count_if(F.col("confidence") == level).alias(level)
    return counts.join(F.broadcast(log.agg(F.count("*").alias("asked"), F.count_if("applied").alias("applied"), sure("high"), sure("medium"))))  # one row each


def clean(dirty: DataFrame, columns: list[str], supplied: DataFrame | None = None, truth: DataFrame | None = None, settings: Settings = Settings(), provider: Provider | None = None, found: Structure | None = None, asking: Asking = Asking(), expert: Provider | None = None) -> Result:
    """Repair ``dirty`` (row_id and string columns without nulls, see ``stats.fill``): ``infer``, with a ``provider`` ``check``, and with
    ``truth`` the metrics. Where no matrix is supplied and none is to be generated, an ``expert`` is asked for one (see
    ``ask_dependencies``)."""
    if supplied is None and found is None and expert is not None and settings.generate == 0 and settings.method not in ("edges", "search_only"):
        supplied = ask_dependencies(dirty, columns, expert, asking=asking).drop("error")
    state = infer(dirty, columns, supplied, settings, found)
    out = Result(state.structure, state.edges, state.repaired)
    if provider is not None:
        out.repaired, out.checked = check(state, columns, settings, provider, asking)
    out.counters = repair_counters(state.changed, out.checked)
    if truth is not None:
        out.metrics = evaluation.evaluate(dirty, out.repaired, truth, columns)
    return out


def save_state(cache: TableCache, key: str, state: Inferred) -> None:
    """Keep an inference as tables, so that its cells can be checked later without it; the table that is saved last makes it count."""
    known = json.dumps({"nodes": state.structure.nodes, "groups": state.structure.groups, "fixed": state.structure.edges, "edges": state.edges, "relations": state.relations})
    for name, table in (("changed", state.changed), ("facts", state.facts), ("repaired", state.repaired), ("structure", cache.spark.createDataFrame([(known,)], "known string"))):
        cache.save("inference", f"{key}-{name}", table)


def load_state(cache: TableCache, key: str) -> Inferred | None:
    """What ``save_state`` kept under the key, or None."""
    structures = cache.load("inference", f"{key}-structure")
    if structures is None:
        return None
    d = json.loads(structures.first()["known"])
    pairs = lambda edges: [tuple(e) for e in edges]
    tables = (cache.load("inference", f"{key}-{name}") for name in ("repaired", "changed", "facts"))
    return Inferred(Structure(d["nodes"], d["groups"], pairs(d["fixed"])), pairs(d["edges"]), d["relations"], *tables)


def _measured(dirty: DataFrame, columns: list[str], supplied: DataFrame) -> tuple[Matrix, Matrix]:
    """The two matrices that all runs on one table share."""
    return structure.as_matrix(stats.mu_plus_matrix(dirty, columns)), structure.as_matrix(supplied)


def _structure_of(matrices: tuple[Matrix, Matrix], columns: list[str], s: Settings) -> Structure | None:
    if s.method not in ("hybrid", "hybrid_no_groups"):
        return None
    found = structure.construct(*matrices, columns, s.alpha, s.beta)
    return replace(found, groups=[]) if s.method == "hybrid_no_groups" else found


def _metrics(*args, **more) -> dict:
    """The metrics of one ``clean``, none of whose tables stay."""
    with temporary():
        return clean(*args, **more).metrics.first().asDict()


def ablation(dirty: DataFrame, columns: list[str], supplied: DataFrame, truth: DataFrame, base: Settings = Settings(), provider: Provider | None = None, asking: Asking = Asking()) -> DataFrame:
    """``(part, metric..., f1_loss)``: the metrics with everything, and without each part, against the former. With a ``provider`` cells are
    checked in every case but "checks"."""
    cases = {"all": base, "supplied": replace(base, method="search_only"), "groups": replace(base, method="hybrid_no_groups"), "compensation": replace(base, use_compensation=False), "weak filter": replace(base, use_weak_filter=False)}
    cases |= {"checks": base} if provider else {}
    dirty = stored(dirty)
    matrices = _measured(dirty, columns, supplied)
    rows = [{"part": k, **_metrics(dirty, columns, supplied, truth, s, None if k == "checks" else provider, _structure_of(matrices, columns, s), asking)} for k, s in cases.items()]
    return dirty.sparkSession.createDataFrame([r | {"f1_loss": rows[0]["f1"] - r["f1"]} for r in rows])


def search_parameters(dirty: DataFrame, columns: list[str], supplied: DataFrame, truth: DataFrame, alphas: list[float], betas: list[float], base: Settings = Settings(), provider: Provider | None = None, asking: Asking = Asking()) -> DataFrame:
    """``(place, alpha, beta, f1, error)`` of each pair; one that fails scores 0. Pairs that give one structure are run once. With a
    ``provider`` each run checks cells."""
    dirty, rows, seen = stored(dirty), [], {}
    matrices = _measured(dirty, columns, supplied)
    for i, (a, b) in enumerate(product(alphas, betas)):
        try:
            s = replace(base, alpha=a, beta=b)
            found = _structure_of(matrices, columns, s)
            key = repr(found)
            if key not in seen:
                seen[key] = float(_metrics(dirty, columns, supplied, truth, s, provider, found, asking)["f1"])
            rows.append((i, a, b, seen[key], None))
        except Exception as e:  # noqa: BLE001 - one setting's failure is its result
            rows.append((i, a, b, 0.0, str(e)[:200]))
    return dirty.sparkSession.createDataFrame(rows, "place int, alpha double, beta double, f1 double, error string")


def best_of(results: DataFrame) -> DataFrame:
    """The highest f1, the first of equals."""
    return results.orderBy(F.desc("f1"), "place").limit(1)


def sweep_error_ratios(spark: SparkSession, variants: dict[str, DataFrame], columns: list[str], supplied: DataFrame | None, truth: DataFrame, base: Settings = Settings(), provider: Provider | None = None, asking: Asking = Asking()) -> DataFrame:
    """``(variant, metrics...)`` of several dirty versions of one table; with a ``provider`` cells are checked."""
    return spark.createDataFrame([{"variant": k, **_metrics(d, columns, supplied, truth, base, provider, asking=asking)} for k, d in variants.items()])
