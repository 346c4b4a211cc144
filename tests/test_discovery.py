"""Dependencies found in data, their violations and the rows to suspect, against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from cellmend.operators import discovery
from cellmend.plans import cleaning
from cellmend.sources.scratch import Scratch


def plain(rows, columns, most, error):
    at = {c: i for i, c in enumerate(columns)}

    def lost(lhs, rhs):
        classes = defaultdict(Counter)
        for r in rows:
            classes[tuple(r[at[c]] for c in lhs)][r[at[rhs]]] += 1
        return sum(sum(c.values()) - max(c.values()) for c in classes.values())

    found = []
    for n in range(most + 1 if rows else 0):
        for lhs in combinations(columns, n):
            for rhs in columns:
                if rhs not in lhs and not any(r == rhs and {*x} <= {*lhs} for x, r, _ in found):
                    if lost(lhs, rhs) <= int(error * len(rows) + 1e-9):
                        found.append((lhs, rhs, round(lost(lhs, rhs) / len(rows), 9)))
    return sorted(found)


def found(spark, rows, columns, most, error):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"{c} string" for c in columns))
    scratch = Scratch(spark)
    got = sorted((tuple(r["lhs"]), r["rhs"], round(r["error"], 9)) for r in discovery.find_dependencies(df, columns, most, error, scratch).collect())
    assert scratch.paths == {}
    return got


@pytest.mark.parametrize("seed, error, most", [(1, 0.0, 3), (2, 0.05, 3), (3, 0.2, 2), (4, 0.0, 1)])
def test_dependencies_equal_all_subsets(spark, seed, error, most):
    rng, columns = random.Random(seed), ["A", "B", "C", "D", "E", "F"]
    rows = []
    for i in range(90):
        a, b, c = rng.randrange(4), rng.randrange(3), rng.randrange(9)
        d = f"{a}{b}" if rng.random() > 0.03 * seed else "x"
        rows.append((f"a{a}", f"b{b}" if i % 13 else None, f"c{c}", d, f"e{(a + b + c) % 5}", "same" if seed % 2 else f"f{c // 3}"))
    assert found(spark, rows, columns, most, error) == plain(rows, columns, most, error)


def test_keys_single_rows_and_nothing(spark):
    rows = [(f"k{i}", str(i % 2)) for i in range(6)]
    assert found(spark, rows, ["K", "V"], 2, 0.0) == [(("K",), "V", 0.0)]
    assert found(spark, rows[:1], ["K", "V"], 2, 0.0) == [((), "K", 0.0), ((), "V", 0.0)]
    assert found(spark, [], ["K", "V"], 2, 0.0) == []


def test_suspects_are_the_planted_rows(spark):
    rng, columns = random.Random(5), ["A", "B", "C", "D"]
    rows, wrong = [], set()
    for i in range(300):
        a = rng.randrange(20)
        r = [f"a{a}", f"b{a % 7}", f"c{a % 3}", f"d{rng.randrange(2)}"]
        if i % 29 == 4:
            wrong.add(i)
            r[1 + (i // 29) % 2] = f"{'bc'[(i // 29) % 2]}x{i % 2}"
        rows.append((i, *r))
    df = spark.createDataFrame(rows, ["row_id", *columns])
    dependencies = [(["A"], "B"), (["A"], "C")]
    suspects = {r["row_id"]: r["round"] for r in discovery.suspect_rows(df, dependencies).collect()}
    assert {*suspects} == wrong
    kept = df.where(~df.row_id.isin(list(suspects)))
    assert discovery.violations(kept, dependencies).count() == 0
    classes = defaultdict(Counter)
    for i, a, b, *_ in rows:
        classes[a][b] += 1
    want = {(0, i, sum(classes[a].values()) - classes[a][b]) for i, a, b, *_ in rows if len(classes[a]) > 1}
    assert {tuple(r) for r in discovery.violations(df, dependencies[:1]).collect()} == want
    assert discovery.suspect_rows(kept, dependencies).count() == 0


def test_a_tie_leaves_one_value(spark):
    df = spark.createDataFrame([(0, "x", "p"), (1, "x", "q")], "row_id long, A string, B string")
    assert [tuple(r) for r in discovery.suspect_rows(df, [(["A"], "B")]).collect()] == [(1, 0)]


def test_a_matrix_from_the_data_gives_a_structure(spark):
    rows = [(i, f"k{i % 6}", f"v{i % 6}" if i % 31 else "v9", f"g{i % 2}", f"u{i}") for i in range(120)]
    df = spark.createDataFrame(rows, ["row_id", "K", "V", "G", "U"])
    columns = ["K", "V", "G", "U"]
    score = {(r["lhs"], r["rhs"]): r["score"] for r in discovery.generated_matrix(df, columns, 0.1).collect()}
    wrong = sum(i % 31 == 0 for i in range(120)) / 120
    assert score["K", "V"] == pytest.approx(1 - wrong / 0.2) and score["K", "G"] == 1.0 and score["G", "K"] == pytest.approx(-2 / 3)
    assert {score["U", c] for c in columns[:3]} == {0.0} and len(score) == 12
    found = cleaning.find_structure(df, None, columns, cleaning.Settings(generate=0.1))
    assert any({*g} == {"K", "V"} for g in found.groups) or ("K", "V") in found.edges or ("V", "K") in found.edges
    assert cleaning.find_structure(df, None, columns, cleaning.Settings()).edges == []
