"""Mixing sources to target weights by iterative proportional fitting (operator 2); DataFrame functions only.

Documents are counted into cells of source, language and topic. The cells' token masses are raked in turn to the target share of each
source, language and topic until all three fit, which gives each cell a rate: fitted mass over own tokens. A document is kept with its
cell's rate over the largest rate, so the expected tokens of what is kept have the target shares. The draw is a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.llm.common import carried
from cellmend.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Exponents by which shares are flattened into targets (1: as they are, 0: equal shares).
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Patterns that make a text's topic, the first that is found; "prose" if none is.
TOPICS = {"legal": "(?i)(licen[sc]e|rights reserved|copyright)", "contact": r"[a-z0-9]@[a-z0-9]|https?://", "code": r"[{};]|==|\(\)"}
OTHER, NONE = "prose", "(none)"
#: Sweeps end when no margin is off by more than this, in relation.
TOLERANCE = 1e-10
SWEEPS = 60
#: Sweeps in one job.
TOGETHER = 4
#: Cells up to which their table is broadcast to the documents; beyond, they meet in a shuffle.
BROADCAST_CELLS = 50_000


def topic_of(text: Column, topics: dict[str, str] = TOPICS) -> Column:
    out = F.lit(OTHER)
    for name, pattern in reversed(topics.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(id_col: Column) -> Column:
    """A number from 0 to 1 (exclusive) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def fit_rates(cells: DataFrame, targets: dict[str, float] | dict[str, dict[str, float]]) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with tokens over 0 and their ``rate`` and ``probability``, and ``margin_error``: by how much, in
    relation, the worst margin was off before the last sweep (about 0 unless the targets contradict each other or have no room).

    A dimension's target is an exponent for its own token shares, or a share for each value (values without one keep nothing).
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.where("tokens > 0").withColumns({"rate": F.lit(1.0), "probability": F.lit(1.0), "margin_error": F.lit(0.0)})
    fitted = cells.where("tokens > 0").withColumn("mass", F.col("tokens") / F.lit(float(total)))
    for d in DIMENSIONS:
        goal = targets[d]
        own = fitted.groupBy(d).agg(F.sum("mass").alias("share"))
        if isinstance(goal, dict):
            sized = own.withColumn("goal", F.coalesce(F.create_map(*[F.lit(x) for pair in goal.items() for x in pair])[F.col(d)] if goal else F.lit(None).cast("double"), F.lit(0.0)))
        else:
            sized = own.withColumn("goal", F.pow("share", F.lit(float(goal))))
        scale = sized.agg(F.sum("goal").alias("all"))  # one row
        fitted = fitted.join(sized.join(F.broadcast(scale)).select(d, F.try_divide("goal", "all").alias(f"goal_{d}")), d)
    fitted = stored(fitted)
    for i in range(SWEEPS // TOGETHER):
        for _ in range(TOGETHER):
            off = F.lit(0.0)  # that of the job's last sweep remains
            for d in DIMENSIONS:
                margin = F.sum("mass").over(Window.partitionBy(d))  # cells are few: one for each source, language and topic
                fitted = fitted.withColumn("margin", margin)
                off = F.greatest(off, F.when(F.col(f"goal_{d}") > 0, F.abs(F.col("margin") / F.col(f"goal_{d}") - 1)).otherwise(F.lit(0.0)))
                fitted = fitted.withColumn("off", off).withColumn("mass", F.coalesce(F.try_divide(F.col("mass") * F.col(f"goal_{d}"), F.col("margin")), F.lit(0.0)))
                off = F.col("off")
        fitted = stored(fitted.drop("margin"))
        error = fitted.agg(F.max("off")).first()[0] or 0.0
        fitted = fitted.drop("off")
        if error <= TOLERANCE:
            break
    rates = fitted.withColumn("rate", F.col("mass") * F.lit(float(total)) / F.col("tokens"))
    largest = rates.agg(F.max("rate")).first()[0]
    return rates.select(*DIMENSIONS, "tokens", "rate", F.coalesce(F.try_divide("rate", F.lit(float(largest))), F.lit(0.0)).alias("probability"), F.lit(error).alias("margin_error"))


def mix(docs: DataFrame, targets: dict = FLATTEN, topics: dict[str, str] | str = TOPICS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keep..., mix_source, mix_lang, mix_topic, n_tokens, rate, probability, kept, margin_error)`` for every row.

    ``topics``: patterns by name, or the column that holds the topic. The texts are read once: what is kept of them is stored with its cell.
    Tokens are runs of characters other than ASCII white space. Null sources and languages are one more value, "(none)". Texts without
    tokens weigh nothing: rate and probability 0, not kept. Repeated rows share one draw. If the targets contradict each other the
    rates of the last sweep hold, and ``margin_error`` says how far they are off. An empty table gives an empty result. Columns other than
    those named take no part; ``keep`` may not name the result's own.
    """
    keep = carried(keep, ("mix_source", "mix_lang", "mix_topic", "n_tokens", "rate", "probability", "kept", "margin_error"))
    topic = F.coalesce(F.col(topics).cast("string"), F.lit(NONE)) if isinstance(topics, str) else topic_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")), topics)
    base = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), topic.alias("topic"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    base = stored(base)
    cells = stored(base.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    rates = stored(fit_rates(cells, targets).drop("tokens"))
    error = rates.agg(F.max("margin_error")).first()[0] or 0.0
    rates = rates.drop("margin_error")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_CELLS else rates
    out = base.join(rates, list(DIMENSIONS), "left").withColumn("probability", F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(F.lit(0.0))).withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("rate")).otherwise(F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(d).alias(f"mix_{d}") for d in DIMENSIONS], "n_tokens", "rate", "probability", (uniform(F.col("id")) < F.col("probability")).alias("kept"), F.lit(error).alias("margin_error"))


def mixing_sql(table: str = "documents", targets: dict[str, float] = FLATTEN, topics: dict[str, str] = TOPICS, sweeps: int = 40) -> str:
    """DuckDB SQL for ``mix`` with exponents as targets: doc_id, n_tokens, probability (9 places), kept."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in topics.items()) + f" ELSE '{OTHER}' END"
    ctes = [
        f"docs AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM {table}))",
        f"base AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(text, '{WORD}')) AS n_tokens FROM docs)",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM base GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "goals AS (SELECT *, tokens / sum(tokens) OVER () AS mass, " + ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), {targets[d]}) / count(*) OVER (PARTITION BY {d}) AS raw_{d}" for d in DIMENSIONS) + " FROM cells)",
        "s0 AS (SELECT *, " + ", ".join(f"raw_{d} * count(*) OVER (PARTITION BY {d}) / sum(raw_{d}) OVER () AS goal_{d}" for d in DIMENSIONS) + " FROM goals)",
    ]
    n = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            ctes.append(f"s{n + 1} AS (SELECT * REPLACE (mass * goal_{d} / sum(mass) OVER (PARTITION BY {d}) AS mass) FROM s{n})")
            n += 1
    ctes.append(f"rates AS (SELECT source, lang, topic, (mass / tokens) / max(mass / tokens) OVER () AS p FROM s{n})")
    draw = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0"
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, round(CASE WHEN n_tokens > 0 THEN p ELSE 0 END, 9) AS probability, {draw} < CASE WHEN n_tokens > 0 THEN p ELSE 0 END AS kept FROM base LEFT JOIN rates USING (source, lang, topic)"
