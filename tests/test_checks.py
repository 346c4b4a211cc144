"""Questions about cells: the ledger of answers, single failures, waits, killed tasks, and the rows that a question shows."""

import json
import random
import time
from collections import Counter

import pytest

from cellmend.operators import context
from cellmend.operators.stats import MARKER
from cellmend.plans import cleaning, questions
from cellmend.sources.ledger import Ledger, answered
from cellmend.sources.results import Results
from cellmend.sources.scratch import Scratch


def logged(path, answer, fails=(), kills=()):
    """A provider that notes each call; it raises for some rows and ends the task at others, once."""

    def provider(cells):
        row = int(cells["row_id"].iloc[0])
        with open(f"{path}/calls", "a") as f:
            f.write(f"{row}\n")
        if row in fails:
            raise ValueError("no")
        if row in kills:
            raise SystemExit(3)
        return cells["value"].map(lambda v: json.dumps({"corrected": answer, "confidence": "high"}))

    return provider


def calls(path):
    return Counter(int(x) for x in open(f"{path}/calls").read().split())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, f"a{i % 3}", f"b{i % 4}") for i in range(40)], "row_id long, A string, B string").cache()


def test_one_failing_cell_costs_itself_only(spark, table, tmp_path):
    chosen = table.selectExpr("row_id", "'B' as attr")
    asking = cleaning.Asking(tasks=2, workers=3, waits=(0.05, 0.1))
    began = time.time()
    fixed, log = cleaning.check_cells(table, chosen, {}, ["A", "B"], logged(tmp_path, "z", fails={7, 8}), asking)
    got = {r["row_id"]: r for r in log.collect()}
    assert time.time() - began >= 0.15
    assert [i for i, r in got.items() if not r["success"]] and {i for i, r in got.items() if not r["success"]} == {7, 8}
    assert got[7]["error"] == "ValueError: no" and got[7]["corrected"] == "b3" and got[7]["confidence"] == "low"
    assert {r["row_id"]: r["B"] for r in fixed.collect()} == {i: "z" if i not in (7, 8) else f"b{i % 4}" for i in range(40)}
    assert calls(tmp_path) == {i: 3 if i in (7, 8) else 1 for i in range(40)}


def test_a_killed_task_does_not_ask_again(spark, table, tmp_path):
    chosen = table.selectExpr("row_id", "'B' as attr")
    asking = cleaning.Asking(tasks=1, workers=1, waits=(), ledger=f"{tmp_path}/answers")
    with pytest.raises(Exception, match="3|SystemExit|crashed|exited"):
        cleaning.check_cells(table, chosen, {}, ["A", "B"], logged(tmp_path, "z", kills={20}), asking)[1].count()
    before = calls(tmp_path)
    assert before[20] >= 1 and len(before) > 1
    log = cleaning.check_cells(table, chosen, {}, ["A", "B"], logged(tmp_path, "z"), asking)[1]
    assert log.where("success").count() == 40
    assert calls(tmp_path) == Counter({i: 1 for i in range(40)}) + Counter({20: before[20]})


def test_the_ledger_keeps_answers(tmp_path):
    ledger = Ledger(f"file:{tmp_path}/l")
    assert ledger.get("ab12") is None
    assert answered(ledger, "ab12", lambda: "yes", ()) == ("yes", None)
    assert answered(ledger, "ab12", lambda: 1 / 0, ()) == ("yes", None)
    tried = []
    assert answered(ledger, "cd34", lambda: tried.append(1) or 1 / 0, (0.0, 0.0)) == (None, "ZeroDivisionError: division by zero") and len(tried) == 3


def plain_similar(rows, asked, k):
    """rows: row_id to values."""
    out = []
    for i, c in asked:
        if i not in rows:
            continue
        scores = [(-sum(x == y != MARKER for j, (x, y) in enumerate(zip(rows[i], v)) if j != c), o) for o, v in rows.items() if o != i]
        out += [(i, c, n + 1, o, -s) for n, (s, o) in enumerate(sorted(s for s in scores if s[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3])
def test_similar_rows_equal_all_pairs(spark, k):
    rng = random.Random(9 + k)
    columns = ["A", "B", "C", "D", "E"]
    rows = {i: tuple(MARKER if rng.random() < 0.1 else f"{c}{min(rng.randrange(n), rng.randrange(n))}" for c, n in zip(columns, (40, 2, 8, 60, 3))) for i in range(150)}
    df = spark.createDataFrame([(i, *v) for i, v in rows.items()], ["row_id", *columns])
    asked = [(i, rng.randrange(5)) for i in range(0, 150, 7)] + [(999, 1), (0, 2), (0, 2)]
    cells = spark.createDataFrame([(i, columns[c]) for i, c in asked] + [(3, "none")], "row_id long, attr string")
    got = sorted((r["row_id"], columns.index(r["attr"]), r["rank"], r["other_id"], r["shared"]) for r in context.similar_rows(df, cells, columns, k).collect())
    assert got == plain_similar(rows, {*asked}, k)


def test_similar_rows_ask_once_for_equal_rows(spark, monkeypatch):
    columns, sizes = ["A", "B", "C"], {}
    rows = {i: (f"a{i % 2}", f"b{i % 3}", MARKER if i % 5 == 4 else "c") for i in range(300)}
    asked = {(i, 1) for i in range(0, 300, 2)}
    put = Scratch.put

    def counted(self, name, df):
        out = put(self, name, df)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    df = spark.createDataFrame([(i, *v) for i, v in rows.items()], ["row_id", *columns])
    cells = spark.createDataFrame([(i, columns[c]) for i, c in asked], "row_id long, attr string")
    got = sorted((r["row_id"], columns.index(r["attr"]), r["rank"], r["other_id"], r["shared"]) for r in context.similar_rows(df, cells, columns, 3).collect())
    assert got == plain_similar(rows, asked, 3)
    assert sizes["open"] <= 6 and sizes["best"] <= 6 * 4  # 150 cells of rows of 6 kinds


def test_questions_show_other_rows(spark, table):
    asked = spark.createDataFrame([(5, "B")], "row_id long, attr string")
    shown = context.context_rows(table, asked, ["A", "B"], {"B": ["A"]}, similar=2, nearby=1, random=1).first()["rows"]
    assert shown.startswith("similar: B=b2; A=a2 | similar: B=b0; A=a2 | near: B=b0; A=a1 | near: B=b2; A=a0 | random: B=b")

    def provider(cells):
        return cells["question"].map(lambda q: json.dumps({"corrected": q, "confidence": "low"}))

    rows = context.context_rows(table, asked, ["A", "B"])
    log = cleaning.check_cells(table, asked, {}, ["A", "B"], provider, context=rows)[1].first()
    assert "Other rows, which may be wrong as well: similar: A=a2; B=b2 | " in log["corrected"]
    assert context.context_rows(table, asked.limit(0), ["A", "B"]).count() == 0


def test_experiments_can_be_deleted(spark, tmp_path):
    store = Results(spark, str(tmp_path / "results"))
    metrics = spark.createDataFrame([(0.5, 0.25, 0.3)], "precision double, recall double, f1 double")
    for name in ("e1", "e2"):
        store.save(name, "d", metrics)
    assert not store.delete("none") and not store.delete("e2") and store.latest() == "e2"
    assert store.delete("e1") and store.load("e1") is None and store.load("e2").count() == 1
    assert store.delete("e2", force=True) and store.all() is None and store.latest() is None


def says(path, answers):
    """A provider of fixed answers by pair of columns, which notes each call; an exception is raised."""

    def provider(asked):
        pair = (asked["lhs"].iloc[0], asked["rhs"].iloc[0])
        with open(f"{path}/pairs", "a") as f:
            f.write(f"{pair[0]}{pair[1]}\n")
        if isinstance(answers.get(pair), Exception):
            raise answers[pair]
        return asked["question"].map(lambda _: answers.get(pair, "I cannot tell"))

    return provider


def test_dependencies_by_answers(spark, table, tmp_path):
    wide = table.selectExpr("row_id", "A", "B", "concat('c', row_id) as C")
    answers = {
        ("A", "B"): '```json\n{"dependency": " YES ", "confidence": 0.8,}\n```',
        ("A", "C"): '{"dependency": "no", "confidence": 7}',
        ("B", "A"): '{"dependency": "maybe", "confidence": 0.5}',
        ("B", "C"): ValueError("no line"),
        ("C", "A"): '{"dependency": "yes"}',
    }
    asking = questions.Asking(tasks=2, workers=2, waits=(0.0,), ledger=f"{tmp_path}/answers")
    for _ in range(2):  # the second time only what has no answer is asked
        got = {(r["lhs"], r["rhs"]): (r["score"], r["error"]) for r in questions.ask_dependencies(wide, ["A", "B", "C"], says(tmp_path, answers), asking=asking).collect()}
        assert got == {("A", "B"): (0.8, None), ("A", "C"): (-1.0, None), ("B", "A"): (0.0, "unreadable answer"), ("B", "C"): (0.0, "ValueError: no line"), ("C", "A"): (0.0, "unreadable answer"), ("C", "B"): (0.0, "unreadable answer")}
    assert Counter(open(f"{tmp_path}/pairs").read().split()) == {"AB": 1, "AC": 1, "BA": 1, "BC": 4, "CA": 1, "CB": 1}


def test_strengths_by_answers(spark, table, tmp_path):
    for texts, scores in ((('{"score": 0.25}', '{"score": -3}'), (0.25, -1.0)), (('{"score": null}', '{"confidence": 1}'), (0.0, 0.0))):
        answers = dict(zip((("A", "B"), ("B", "A")), texts))
        got = questions.ask_dependencies(table, ["A", "B"], says(tmp_path, answers), kind="strength", asking=questions.Asking(waits=())).collect()
        assert {(r["lhs"], r["rhs"]): r["score"] for r in got} == dict(zip(answers, scores))
        assert all((r["error"] is None) == (r["score"] != 0) for r in got)
    with pytest.raises(ValueError, match="none of"):
        questions.ask_dependencies(table, ["A", "B"], says(tmp_path, answers), kind="rank")


def test_shown_rows_do_not_depend_on_the_layout(spark, table, tmp_path):
    shown = [tuple(r) for r in questions.shown_rows(table, ["A", "B"]).collect()]
    assert shown == [tuple(r) for r in questions.shown_rows(table.repartition(7).orderBy("B"), ["A", "B"]).collect()] and len(shown) == 10
    assert shown != [tuple(r) for r in questions.shown_rows(table, ["A", "B"], seed=5).collect()]
    for few, n in ((table.limit(3), 3), (table.limit(0), 0)):
        seen = questions.ask_dependencies(few, ["A", "B"], lambda a: a["sample"].map(lambda s: json.dumps({"score": len(json.loads(s)) / 10})), "strength", questions.Asking(waits=()))
        assert {r["score"] for r in seen.collect()} == {n / 10}


def test_a_repair_by_an_experts_matrix(spark, tmp_path):
    rows = [(i, f"a{i % 4}", f"b{i % 4}" if i != 21 else "b0", f"c{i % 3}") for i in range(60)]
    dirty = spark.createDataFrame(rows, "row_id long, A string, B string, C string")
    columns = ["A", "B", "C"]
    sure = {(a, b): json.dumps({"dependency": "yes" if {a, b} == {"A", "B"} else "no", "confidence": 0.9}) for a in columns for b in columns if a != b}
    settings = cleaning.Settings(use_search=False, beta=0.0)
    by_expert = cleaning.clean(dirty, columns, settings=settings, expert=says(tmp_path, sure), asking=questions.Asking(waits=()))
    supplied = spark.createDataFrame([(a, b, 0.9 if {a, b} == {"A", "B"} else -0.9) for a, b in sure], "lhs string, rhs string, score double")
    by_hand = cleaning.clean(dirty, columns, supplied, settings=settings)
    assert by_expert.structure == by_hand.structure and (by_expert.structure.groups or by_expert.structure.edges)
    fixed = {r["row_id"]: r["B"] for r in by_expert.repaired.collect()}
    assert fixed == {r["row_id"]: r["B"] for r in by_hand.repaired.collect()} and fixed[21] == "b1"
