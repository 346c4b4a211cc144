"""Operator 5 against brute force on random, repetitive and odd texts."""

import random
import re

import numpy as np
import pyarrow as pa

from cellmend.llm import substring_dedup
from cellmend.llm.common import Words


def brute(rows, window):
    """rows: distinct (doc_id, text)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def texts(rng, n):
    pool = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(pool, k=rng.randrange(15, 90))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(rng.choice([pool, pool[:2], pool[:1]]), k=rng.randrange(0, 60))) for _ in range(rng.randrange(0, 4))]
        parts += rng.choices(passages, k=rng.randrange(0, 3))
        rng.shuffle(parts)
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    made = texts(rng, 150)
    made += made[:5] + [" ".join(t.split()[3:]) for t in made[5:25]] + ["a " * 300, "a " * 40, "a b " * 100]
    rows = list(enumerate(made))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for window in (20, 5):
        assert collected(substring_dedup.remove_repeats(df, window)) == sorted(brute(rows, window), key=str)


def test_equals_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert collected(substring_dedup.remove_repeats(df)) == sorted(brute(rows, 20), key=str)


def test_small_slices_agree(spark, monkeypatch):
    rng = random.Random(12)
    rows = list(enumerate(texts(rng, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring_dedup, "SLICE", 300)
    batches = [pa.RecordBatch.from_pydict({"doc": [i], "sub": [0], "text": [t]}) for i, t in rows]
    assert sum(b.num_rows for b in substring_dedup._find_occurrences(20)(batches)) > 0
    assert collected(substring_dedup.remove_repeats(df)) == sorted(brute(rows, 20), key=str)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(13)
    for _ in range(40):
        alphabet = [f"s{i}" for i in range(rng.choice([1, 2, 3, 6, 50]))]
        made = [" ".join(rng.choices(alphabet, k=rng.randrange(0, 120))) for _ in range(5)]
        words = Words(pa.array(made))
        found = substring_dedup.occurrences(words, 20)
        anchors = {}
        for name, row, a, b in zip(found["name"], found["row"], found["a"], found["b"]):
            tokens = made[row].split()
            for s in range(a, b + 1):
                assert anchors.setdefault(tuple(tokens[s : s + 20]), name) == name
        assert sum(found["b"] - found["a"] + 1) == sum(max(0, n - 19) for n in np.diff(words.first))


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(3, long, 1), (3, long, 2), (None, "x " + long, 3), (4, None, 4), (5, "", 5), (6, " \n", 6), (7, "one", 7), (2, long.replace("v30", "é"), 8), (2, "other words", 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string, doc long")
    got = collected(substring_dedup.remove_repeats(df))
    plain = brute([(None, rows[2][1]), (2, rows[7][1]), (2, rows[8][1]), (3, long), (4, None), (5, ""), (6, " \n"), (7, "one")], 20)
    assert got == sorted([*plain, next(r for r in plain if r[0] == 3)], key=str)
    assert substring_dedup.remove_repeats(df).schema["doc_id"].dataType.simpleString() == "int"
    assert substring_dedup.remove_repeats(df.where("doc_id > 99")).count() == 0


def test_repeated_rows_keep_their_words(spark):
    long, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "vu")
    rows = [(3, long), (3, long), (3, long), (None, other), (None, other), (5, "y " + long)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert collected(substring_dedup.remove_repeats(df)) == sorted([(3, 60, 0, long)] * 3 + [(None, 60, 0, other)] * 2 + [(5, 61, 60, "y")], key=str)
    clash = spark.createDataFrame([*rows, (3, other), (3, other)], "doc_id long, text string")
    assert collected(substring_dedup.remove_repeats(clash)) == sorted([(3, 60, 0, long)] * 3 + [(3, 60, 60, "")] * 2 + [(None, 60, 0, other)] * 2 + [(5, 61, 60, "y")], key=str)
