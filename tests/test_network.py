"""Structure search with a tabu list, and counts of families from stored sets."""

import random


from cellmend.operators import network
from cellmend.operators.network import ContingencyTree


def table(spark, seed, n, columns):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = rng.randrange(3)
        rows.append((i, *[f"{c}{base if rng.random() < 0.6 else rng.randrange(3)}" for c in columns]))
    return spark.createDataFrame(rows, ["row_id", *columns])


def test_families_from_the_tree_equal_those_from_rows(spark):
    columns = [f"c{i}" for i in range(6)]
    df = table(spark, 1, 200, columns).cache()
    card = network.cardinalities(df, columns)
    tree = ContingencyTree(df, columns)
    asked = [[("c0", ["c1", "c2"]), ("c1", ["c0"]), ("c2", ["c1", "c0"]), ("c5", [])], [("c1", []), ("c0", ["c2"]), ("c3", ["c4", "c5"]), ("c2", ["c0"])]]
    for families in asked:
        want = {r["place"]: r["score"] for r in network.family_scores(df, families, card).collect()}
        got = tree.scores(families, card)
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want) and len(got) == len(want) == len(families)
    assert tree.origin(frozenset(["c0"])) in (frozenset(["c0", "c1"]), frozenset(["c0", "c2"])) and tree.origin(frozenset(["c3", "c1"])) == frozenset(columns)


def test_a_climb_reads_the_rows_once(spark):
    columns = [f"c{i}" for i in range(15)]
    seen = spark.sparkContext.accumulator(0)
    df = table(spark, 2, 60, columns)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = df.mapInArrow(note, df.schema)
    trace = []
    edges = network.hill_climb(counted, columns, rounds=3, trace=trace)
    assert len(edges) == len(trace) == 3 and [t[2] for t in trace] == sorted(t[2] for t in trace)
    assert seen.value <= 2 * 60  # the root, and the columns' numbers of values


def test_search_leaves_a_plateau(spark):
    # C is the parity of A and B: no single edge gains, both together do
    rows = [(i, str(i & 1), str(i >> 1 & 1), str((i & 1) ^ (i >> 1 & 1))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, A string, B string, C string").cache()
    assert network.hill_climb(df, ["A", "B", "C"]) == []
    trace = []
    found = network.hill_climb(df, ["A", "B", "C"], patience=3, trace=trace)
    assert len(found) >= 2 and len({b for _, b in found}) == 1 and len(trace) > len(found)
    card = network.cardinalities(df, ["A", "B", "C"])
    score = lambda edges: sum(network.family_score(df, c, [a for a, b in edges if b == c], card).first()[0] for c in "ABC")
    assert score(found) > score([]) + 50
    best = max(t[2] for t in trace)
    assert abs(score(found) - score([]) - best) < 1e-3


def test_moves_are_not_undone(spark):
    df = table(spark, 3, 80, ["A", "B", "C"])
    trace = []
    network.hill_climb(df, ["A", "B", "C"], patience=6, trace=trace)
    kinds = [(k, e) for e, k, _ in trace]
    undo = {"add": "remove", "remove": "add"}
    assert len(kinds) >= 6 and all((undo.get(k), e) not in kinds[i + 1 :] for i, (k, e) in enumerate(kinds) if k in undo)
