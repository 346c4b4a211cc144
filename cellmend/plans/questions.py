"""Questions to a provider: each asked on its own, with waits and a ledger of answers; and the dependencies between columns by its answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.functions.text import fix_json
from cellmend.sources.ledger import Ledger, answered, key_of
from cellmend.sources.scratch import shared_folder, stored

#: Answers questions, a frame of one row each time (see who asks for its columns), with the provider's raw text.
Provider = Callable[[pd.DataFrame], pd.Series]
#: What an answer about a dependency holds, by the kind of question.
KINDS = {"yes_no": "dependency string, confidence double", "strength": "score double"}
#: Rows that a question about a dependency shows, and the seed of their draw.
SHOWN, SEED = 10, 1234


@dataclass(frozen=True)
class Asking:
    """How a provider is asked: by ``tasks`` tasks of ``workers`` questions at a time; one that fails is asked again after each of the
    ``waits`` (seconds). ``ledger``: a shared folder of answers to use and to add to; without one a new one for the job."""

    tasks: int = 8
    workers: int = 4
    waits: tuple[float, ...] = (1.0, 2.0, 4.0)
    ledger: str | None = None

    def answers(self, of: DataFrame) -> Ledger:
        return Ledger(self.ledger or f"{shared_folder(of.sparkSession)}/answers")


def each(batches: Iterator[pd.DataFrame], provider: Provider, asking: Asking, ledger: Ledger, key: Callable[[pd.Series], tuple]) -> Iterator[tuple[pd.DataFrame, list[tuple[str | None, str | None]]]]:
    """Each batch with its rows' answers and errors. ``key`` of a row says which question it is."""
    with ThreadPoolExecutor(asking.workers) as pool:
        for batch in batches:
            rows = [batch.iloc[i : i + 1].reset_index(drop=True) for i in range(len(batch))]
            yield batch, list(pool.map(lambda r: answered(ledger, key_of(*key(r.iloc[0])), lambda: str(provider(r).iloc[0]), asking.waits), rows))


def shown_rows(table: DataFrame, columns: list[str], n: int = SHOWN, seed: int = SEED) -> DataFrame:
    """``(columns...)`` of n rows, those of the smallest MD5 of seed and id: the same whatever the table's layout."""
    by = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")).cast("binary"))
    return table.orderBy(by, "row_id").limit(n).select(*columns)


def ask_dependencies(table: DataFrame, columns: list[str], provider: Provider, kind: str = "yes_no", asking: Asking = Asking(), n: int = SHOWN, seed: int = SEED, name: str = "a table") -> DataFrame:
    """``(lhs, rhs, score, error)`` for every ordered pair of columns, a dependency matrix from a provider's answers.

    The provider sees ``lhs``, ``rhs``, ``sample`` (``n`` rows as JSON) and ``question``. ``yes_no``: it says whether lhs determines rhs and
    how sure it is from 0 to 1, and the score is that, below 0 for a no. ``strength``: it gives the score from -1 to 1 itself. Numbers beyond
    these ends count as the ends. A pair that gets no answer, or one that cannot be read, says nothing: its score is 0, and ``error`` tells
    why. Each pair is asked on its own (see ``Asking``). Pairs grow with the columns, and only the shown rows reach the driver.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    rows = [r.asDict() for r in shown_rows(table, columns, n, seed).collect()]  # n rows
    wish = {"yes_no": "dependency (yes or no) and confidence (0 to 1)", "strength": "score (-1: surely not, to 1: surely)"}[kind]
    sample = json.dumps(rows, ensure_ascii=False, default=str)
    spark, ledger = table.sparkSession, asking.answers(table)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = (b.assign(sample=sample, question=[f"In {name}, does a row's {l} determine its {r}? Some rows, which may be wrong: {sample}. Answer in JSON with {wish}." for l, r in zip(b["lhs"], b["rhs"])]) for b in batches)
        for batch, found in each(full, provider, asking, ledger, lambda r: (kind, r["lhs"], r["rhs"], r["question"])):
            yield pd.DataFrame({"lhs": batch["lhs"], "rhs": batch["rhs"], "raw": [f[0] for f in found], "error": [f[1] for f in found]})

    pairs = spark.createDataFrame([(a, b) for a in columns for b in columns if a != b], "lhs string, rhs string").repartition(asking.tasks, "lhs", "rhs")
    answers = stored(pairs.mapInPandas(ask, "lhs string, rhs string, raw string, error string"))  # stored: nothing is asked twice
    a = F.from_json(fix_json(F.col("raw")), KINDS[kind])
    within = lambda x, least: F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(least), F.least(F.lit(1.0), x)))
    if kind == "strength":
        score = within(a["score"], -1.0)
    else:
        sure, said = within(a["confidence"], 0.0), F.lower(F.btrim(a["dependency"]))
        score = F.when(said == "yes", sure).when(said == "no", -sure)
    unread = F.when(F.col("error").isNull() & score.isNull(), F.lit("unreadable answer"))
    return answers.select("lhs", "rhs", F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce("error", unread).alias("error"))
