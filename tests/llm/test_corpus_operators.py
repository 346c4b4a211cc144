"""Operators 2, 6, 7, 8 and 9 and the pipeline against brute force, held-out texts and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellmend.llm import components, fingerprints, lm_scoring, minhash_dedup, mixing, quality, sentencepiece_codec, substring_dedup, topk_search
from cellmend.llm.common import Words
from cellmend.llm.queries import PIECE_MODEL

DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three four five"), (None, "one two three four five"), (None, None), (7, "x " * 3000), (8, "same a b c d e f"), (8, "same a b c d e f"), (9, "日本 é 🙂 a b c")]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def linked_components(rows):
    """Component of each (id, text) by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(x), root(d)) for d, x in sets}


def near_rows(rng):
    base = [" ".join(f"t{rng.randrange(900)}" for _ in range(rng.choice([4, 5, 6, 8, 12, 40, 150]))) for _ in range(25)]
    out = []
    for text in base:
        for _ in range(rng.choice([1, 2, 8])):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
            out.append(rng.choice([" ", "\t"]).join(words if rng.random() < 0.8 else [w.upper() for w in words]))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows(random.Random(21))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == linked_components(rows)


def test_near_duplicates_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    assert got == linked_components(rows)


def test_near_duplicates_on_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id int, text string, band long")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 1, 4, True): 1, (5, 1, 4, False): 1, (6, 1, 6, True): 1, (None, 1, 6, False): 1, (None, 0, None, True): 1, (7, 1, 7, True): 1, (8, 3, 8, True): 2, (9, 2, 9, True): 1})
    assert minhash_dedup.near_duplicates(df.where("doc_id > 99")).count() == 0


def patterned(n, flip):
    """A word of two letters in the order that defeats polynomial hashes modulo a power of two."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_long_patterned_words_are_told_apart(spark):
    tail = " ".join(f"v{i}" for i in range(19))
    for words in ([patterned(2048, f) for f in (0, 1)], [patterned(4096, f) for f in (0, 1)]):
        df = spark.createDataFrame([(1, words[0]), (2, words[1]), (3, f"{words[0]} {tail}"), (4, f"{words[1]} {tail}")], "doc_id long, text string")
        assert all(r["kept"] for r in minhash_dedup.near_duplicates(df.where("doc_id < 3")).collect())
        assert {r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == {0}
        prints = {r["fingerprint"] for r in fingerprints.fingerprint_documents(df).collect()}
        assert len(prints) == 4
    sequences = [" ".join(f"w{c}" for c in patterned(20, f)) for f in (0, 1)]
    df = spark.createDataFrame(list(enumerate(sequences)), "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == {0}


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, b + " more"), (8, a + " more"), (9, c), (9, c), (None, c), (None, "solo text here"), (None, "solo text here"), (3, ""), (3, ""), (9, c.upper())]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect())
        assert got == Counter({(5, 36, 5, True): 3, (7, 37, 5, False): 1, (8, 37, 5, False): 1, (9, 36, 9, True): 3, (None, 36, 9, False): 1, (None, 1, None, True): 2, (3, 0, 3, True): 2})
        full = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
        kept = Counter((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.one_of_each(spark, full, DIR).collect())
        assert kept == Counter({(5, a): 1, (5, b): 1, (9, c): 1, (None, "solo text here"): 1, (3, ""): 2})


@pytest.mark.parametrize("n", [5, 7, 12, 60, 3000])
def test_near_duplicates_find_pairs_at_the_threshold(spark, n):
    """Pairs whose similarity is just 0.75 or more, of short and long texts, are all found."""
    rng, rows, want = random.Random(n), [], 0
    for k in range(60 if n < 1000 else 12):
        words = [f"k{k}w{rng.randrange(10**6)}" for _ in range(n + 4)]
        cut = n // 4  # the shorter text has n - cut of n shingles
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n + 4 - cut]))]
        want += 4 * (n - cut) >= 3 * n
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.where("not kept").count() == want > 0


def test_pairs_away_from_their_hub(spark):
    """Of members that their hub does not link, all linked pairs of different components meet, at the threshold too, and texts of one template do not."""
    rng = random.Random(31)
    fresh = lambda n: [rng.getrandbits(64) for _ in range(n)]
    template = fresh(160)
    sets = [set(template[:140] + fresh(60))]  # the hub
    for n in (1, 3, 7, 28, 70, 140, 203):
        base = fresh(n)
        sets += [set(base), set(base[: -(-3 * n // 4)]), set(base[n // 7 :] + fresh(n // 7)), set(base[n // 7 + 1 :] + fresh(n // 7 + 1))]
        base = rng.sample(template, min(n, 100)) + base
        sets += [set(base), set(base[: -(-3 * len(base) // 4)]), set(base[len(base) // 7 :] + fresh(len(base) // 7))]
    for _ in range(30):  # likely not linked with the hub, some with each other
        base = rng.choice(sets[1:])
        sets.append({x for x in base if rng.random() < 0.93} | {*fresh(len(base) // 20)} or {1})
    alone = len(sets)
    sets += [set(template[:110] + fresh(50)) for _ in range(30)]
    packed = [np.sort(np.array([*x], np.uint64)).tobytes() for x in sets]
    pairs = spark.createDataFrame([(0, i, packed[0], packed[i]) for i in range(1, len(sets))], "a long, b long, items_a binary, items_b binary")
    scratch = minhash_dedup.Scratch(spark)
    tried = scratch.put("tried", minhash_dedup._compared(pairs.repartition(3), "long"))
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    hub = {0} | {r["b"] for r in tried.where("linked").collect()}
    assert {j for i, j in linked if i == 0} | {0} == hub
    parts = components.connected_components(tried.where("linked").select("a", "b"), scratch)
    hashes, first = minhash_dedup._flat(pa.array(packed, pa.binary()))
    maps = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(minhash_dedup.bit_maps(hashes, first))], "node long, bits array<long>")
    got = [(r["a"], r["b"]) for r in minhash_dedup._open_pairs(tried, parts, maps, scratch).collect()]
    assert len(got) == len({*got}) and not any(i in hub and j in hub for i, j in got)
    want = {(i, j) for i, j in linked if i > 0 and not (i in hub and j in hub)}
    assert len(want) > 30 and want <= {*got}
    assert not any(i >= alone for i, j in got)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for shared in (300, 900):
        pool = np.unique(rng.integers(0, 1 << 64, 2500, dtype=np.uint64, endpoint=False))
        rng.shuffle(pool)
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
        regs = minhash_dedup.registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        assert abs(minhash_dedup.estimate(regs[:1], regs[1:], 1000, 1000)[0] - shared / (2000 - shared)) < 0.1


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (5, 6), (5, 6)]
    parent = {x: x for pair in links for x in pair if x is not None}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    touched = {x for a, b in links if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: parent[x] for x in touched}


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 5)
    monkeypatch.setattr(topk_search, "ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(120)]
    rows += [(120, None), (121, [0.5, None, 0.1, 0.1]), (122, [float("nan")] * 4), (123, [float("inf")] * 4), (None, [0.5] * 4), (125, [1.0, 2.0]), (130, [0.5, 0.5]), (126, []), (127, rows[3][1]), (127, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 10 == 0).collect())
    fine = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in {i: x for i, x in fine if i % 10 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in fine if i != q and len(x) == len(y))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(df.where("vec_id < 0"), F.lit(True)).count() == 0


def check_top_k(spark, rows):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if all(np.isfinite(256 * x) for x in v)}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q]
        best = sorted(s for s in scores if -(2**63) < -s[0] < 2**63)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_large_components(spark):
    check_top_k(spark, [(0, [1e5, -3.0]), (50, [3e5, 1.0]), (1, [1.0, 2.0]), (2, [1e6, 5.5]), (3, [1e6, 5.25]), (4, [1e12, 0.0]), (5, [1e200, 0.0]), (6, [-1e6, 1.0]), (7, [1e308, 1.0])])


def test_top_k_where_a_length_passes_longs_and_scores_do_not(spark):
    check_top_k(spark, [(0, [1.0, 0.0]), (1, [1e8, 0.0]), (2, [1e9, 1e300]), (3, [0.0, 1e300]), (4, [-1e14, 2.0]), (5, [1e8, 0.00390625]), (50, [0.0, 1e290]), (6, [7.0, 0.0])])
    edge = [(2.0**62, 2.0**63, s) for s in (1, -1)]
    rows = [(0, [1 / 256, 0.0]), (50, [1.0, 1.0]), (100, [-1 / 256, 1 / 256])]
    rows += [(1 + 4 * i + j, [s * (x + d * 1024) / 256, 0.0]) for i, (low, high, s) in enumerate(edge) for j, (x, d) in enumerate(((low, -1), (low, 1), (high, -1), (high, 0)))]
    check_top_k(spark, rows)


def test_products_are_exact():
    rng = np.random.default_rng(9)
    a, b = (rng.integers(-(1 << 29), 1 << 29, (4, 3)) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert topk_search.products(a.astype(float), b.astype(float), False).tolist() == want


def plain_edit(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        yield d, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2]


def test_fingerprints_edit_the_next_text(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", 2000)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    for df in (docs, spark.createDataFrame(ODD, "doc_id int, text string"), docs.limit(1), docs.limit(0)):
        rows = [tuple(r) for r in df.collect()]
        got = Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in fingerprints.fingerprint_documents(df).collect())
        assert got == Counter(plain_edit(rows))


def test_fingerprints_of_a_frequent_id(spark):
    rng = np.random.default_rng(4)
    rows = [(5 if i % 2 else None if i % 3 else i, f"{rng.integers(1000)} word {'é' * int(rng.integers(3))} " * 3 if i % 7 else "alike") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = Counter(r["bucket"] for r in fingerprints.with_next(docs).where("guard = 0").collect())
        got = Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in fingerprints.fingerprint_documents(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sum(dealt.values()) == 900 and max(dealt.values()) < 200 and len(dealt) >= 10  # the id has 450 rows, 64 of them alike
    assert got == Counter(plain_edit(rows))


def test_fingerprints_estimate(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) < 3000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = fingerprints.fingerprint_documents(docs).collect()
    prints, errors = {}, []
    for r in rows:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        words = [WORD.findall(t) for t in (texts[r["doc_id"]], r["edited"])]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in words]
        errors.append(abs(r["near_edited"] - (len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if sets[0] | sets[1] else 1)))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    a, b = (fingerprints.from_text(r["fingerprint"]) for r in rows[:2])
    assert fingerprints.to_text(a) == rows[0]["fingerprint"]
    merged = fingerprints.merge_fingerprints(spark.createDataFrame([(1, r["fingerprint"]) for r in rows[:20]] + [(2, None)], "g int, fingerprint string"), ["g"]).collect()
    every = sorted({v for r in rows[:20] for v in fingerprints.from_text(r["fingerprint"]).tolist()})[:128]
    assert {r["g"]: r["fingerprint"] for r in merged} == {1: fingerprints.to_text(np.array(every, np.uint64)), 2: ""}
    big, part = fingerprints.sketches([" ".join(f"w{i}" for i in range(5004)), " ".join(f"w{i}" for i in range(1254))])
    assert abs(fingerprints.distinct_count(big) / 5000 - 1) < 0.3 and fingerprints.containment(part, big) > 0.6 and abs(fingerprints.resemblance(part, big) - 0.25) < 0.15


def test_fingerprints_are_the_least_hashes(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) < 4000").limit(60).cache()
    ordered = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    words = {d: WORD.findall(t) for d, t in ordered}
    sets = {d: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""} for d, w in words.items()}
    every = sorted({s for v in sets.values() for s in v})
    hash_of = dict(zip(every, (int(x[0]) for x in fingerprints.sketches(every))))  # each shingle on its own
    assert len({*hash_of.values()}) == len(every)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    for (d, _), (n, _) in zip(ordered, ordered[1:] + ordered[:1]):
        r = found[d]
        assert fingerprints.from_text(r["fingerprint"]).tolist() == sorted(hash_of[s] for s in sets[d])[:128]
        both = sorted({hash_of[s] for s in sets[d] | sets[n]})[:128]
        common = {hash_of[s] for s in sets[d] & sets[n]}
        want = sum(h in common for h in both) / len(both) if both else 1.0
        assert abs(r["near_next"] - want) < 1e-9
        if len(sets[d]) < 128:
            assert r["n_distinct"] == len(sets[d])
        if len(sets[d] | sets[n]) < 128:
            assert abs(r["within_next"] - (len(sets[d] & sets[n]) / len(sets[d]) if sets[d] else 1.0)) < 1e-9


def test_place_among_cuts(spark):
    for cuts in ([], [5], [-3, 0, 2, 9, 40], list(range(0, 700, 7))):
        got = spark.range(-10, 720).select("id", fingerprints.place_among(cuts, F.col("id")).alias("n")).collect()
        assert all(r["n"] == sum(c <= r["id"] for c in cuts) for r in got)


def test_mixing_reaches_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    goal = {"source": {f"src{i}": (2.0 if i < 3 else 1.0) for i in range(20)}, "lang": 0.5, "topic": 0.8}
    rows = mixing.mix(docs, goal).collect()
    mass = {d: Counter() for d in ("source", "lang", "topic")}
    for r in rows:
        for d in mass:
            mass[d][r[f"mix_{d}"]] += r["n_tokens"] * r["probability"]
    total = sum(mass["source"].values())
    assert all(abs(v / total - goal["source"][s] / 23) < 1e-6 for s, v in mass["source"].items())
    plain = Counter()
    for r in rows:
        plain[r["mix_lang"]] += r["n_tokens"]
    flat = {k: v**0.5 for k, v in plain.items()}
    assert all(abs(v / total - flat[k] / sum(flat.values())) < 1e-6 for k, v in mass["lang"].items())
    kept, expected = sum(r["n_tokens"] for r in rows if r["kept"]), sum(r["n_tokens"] * r["probability"] for r in rows)
    spread = sum(r["n_tokens"] ** 2 * r["probability"] * (1 - r["probability"]) for r in rows) ** 0.5
    assert abs(kept - expected) < 4 * spread


def test_mixing_says_when_targets_contradict(spark):
    rows = [(i, "a b c", f"s{i % 2}", f"l{i % 2}", "t") for i in range(20)]  # the source determines the language
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    for share, fits in ((0.5, True), (0.9, False)):
        out = mixing.mix(df, {"source": {"s0": 0.5, "s1": 0.5}, "lang": {"l0": share, "l1": 1 - share}, "topic": 1.0}, topics="subject").collect()
        assert {r["mix_topic"] for r in out} == {"t"} and (out[0]["margin_error"] < 1e-9) == fits


def test_mixing_on_odd_rows(spark):
    df = spark.createDataFrame([(d, t, None if i % 3 else "s", "en" if i % 2 else None, "x") for i, (d, t) in enumerate(ODD)], "doc_id int, text string, source string, lang string, rate string")
    rows = mixing.mix(df, keep=("text",)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["probability"] <= 1 for r in rows)
    assert not any(r["kept"] for r in rows if not WORD.search(r["text"] or ""))
    assert mixing.mix(df.limit(0)).count() == 0


def plain_log_probabilities(m, text):
    """The model's formula, a word at a time."""
    hashes = Words(pa.array([text])).hashes.tolist()
    known = {w: i for i, w in enumerate(m.words.tolist())}
    ids = [int(m.id_of[known[h]]) if h in known else m.other for h in hashes]
    out = []
    for t, i in enumerate(ids):
        h = sum(m.tables[k][ids[t + place] if 0 <= t + place < len(ids) else m.other + 1].astype(float) for k, place in enumerate(m.places))
        scores = h @ m.out.astype(float) + m.bias
        value = scores[m.class_of[i]] - np.log(np.exp(scores).sum())
        end = hashes[t] >> (64 - (len(m.end_share).bit_length() - 1)) if len(m.end_share) > 1 else 0
        code = i if i != m.other else m.other + 1 + end
        for at in range(m.path_first[code], m.path_first[code + 1]):
            node = m.path[at]
            value -= np.log(1 + np.exp(-m.side[at] * (h @ m.nodes[node] + m.turn[node])))
        if i == m.other:
            value += m.end_share[end] + (m.log_n[known[hashes[t]]] if hashes[t] in known else 0)
        out.append(value)
    return out


def test_lm_is_a_distribution_and_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    model = lm_scoring.train_lm(docs, lm_scoring.LmParams(vocabulary=300, counted=2000, classes=12, share=1))
    for c in range(len(model.bias)):
        assert c == len(model.bias) - 1 or abs(np.exp(model.log_share[:-1])[model.class_of[:-1] == c].sum() - 1) < 1e-9
    rng = random.Random(8)
    texts = [r["text"] for r in docs.limit(40).collect()]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    a, b = (model.log_probabilities(Words(pa.array(x))).mean() for x in (texts, shuffled))
    assert a > b
    ids = model.ids(Words(pa.array(texts)).hashes)
    found = model.find(Words(pa.array(texts)).hashes)
    base = np.log(np.bincount(model.class_of[ids], minlength=len(model.bias)).clip(1) / len(ids))
    own = np.where(ids == model.other, np.append(model.log_n, 0.0)[found], 0.0)
    rest = np.where(ids == model.other, -np.log((np.exp(-model.end_share) - 1).sum() + 1), 0.0)
    unigram = (base[model.class_of[ids]] + model.log_share[ids] + rest + own).mean()
    assert a > unigram + 0.1  # even against the texts' own class shares
    for text in texts[:8]:
        assert np.allclose(model.log_probabilities(Words(pa.array([text]))), plain_log_probabilities(model, text), atol=1e-3)


def test_lm_scores_equal_the_plain_formula(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 600").limit(200).cache()
    model = lm_scoring.train_lm(docs, lm_scoring.LmParams(vocabulary=100, counted=150, classes=8))
    counts = Counter(h for r in docs.collect() for h in Words(pa.array([r["text"] or ""])).hashes.tolist())
    known = set(model.words.tolist())
    assert 100 < len(known) <= 150 and min(counts[w] for w in known) >= max(n for w, n in counts.items() if w not in known)
    got = {r["doc_id"]: r for r in lm_scoring.score_lm(docs, model).collect()}
    for r in docs.collect():
        hashes = Words(pa.array([r["text"]])).hashes.tolist()
        want = sum(plain_log_probabilities(model, r["text"])) + sum(np.log(counts[h]) for h in hashes if h not in known)
        assert abs(got[r["doc_id"]]["log_prob"] - want) < 1e-3 * (1 + len(hashes)) and got[r["doc_id"]]["n_tokens"] == len(hashes)


def test_lm_on_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in ODD], "doc_id int, text string, log_prob double")
    rows = lm_scoring.score_lm(df, lm_scoring.train_lm(df)).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r["log_prob"]) and (r["n_tokens"] > 0 or r["log_prob"] == 0) for r in rows)
    none = df.limit(0)
    assert lm_scoring.score_lm(none, lm_scoring.train_lm(none)).count() == 0
    assert {r["log_prob"] for r in lm_scoring.score_lm(df.where("doc_id < 4"), lm_scoring.train_lm(none)).collect()} == {0.0}


@pytest.mark.parametrize("counted", [1, 2, 3, 100])
def test_lm_counts_tell_words_outside_the_vocabulary_apart(spark, counted):
    texts = ["often " * 8, "often " * 8, "rare", *["top"] * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_scoring.train_lm(df, lm_scoring.LmParams(vocabulary=1, counted=counted, codes=0))
    asked = spark.createDataFrame([(1, "x often y"), (2, "x rare y"), (3, "x unseen y"), (3, "x unseen y")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score_lm(asked, model).collect()}
    assert abs(got[1] - got[2] - np.log(16)) < 1e-6 and got[2] == got[3] and lm_scoring.score_lm(asked, model).count() == 4


def test_lm_predicts_words_of_one_class_from_both_sides(spark):
    texts = ["a b c " * 30 if i % 2 else "a d e " * 30 for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = lm_scoring.train_lm(df, lm_scoring.LmParams(classes=2, epochs=10, share=1, codes=0))
    assert len(model.bias) == 2
    good, bad = (np.exp(model.log_probabilities(Words(pa.array([t])))[4]) for t in ("a b c a b c a b c", "a b c a d c a b c"))
    assert good > 0.9 and bad < 0.05
    middle = [np.exp(model.log_probabilities(Words(pa.array([f"a b c a {w} c a b c"])))[4]) for w in ("a", "b", "c", "d", "e", "unseen")]
    assert abs(sum(middle) - 1) < 1e-5


def test_lm_trains_on_every_document(spark):
    texts = ["a b c " * 5] * 1500 + ["d e f " * 5] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    p = lm_scoring.LmParams(epochs=1, share=2)
    before = np.random.default_rng(p.seed).standard_normal((len(p.places), 8, p.dim)).astype(np.float32) * np.float32(0.1)
    moved = np.abs(lm_scoring.train_lm(df, p).tables - before).max(axis=2) > 1e-6
    assert moved[:, :6].all()
    # each position is drawn at the same rate, once for each row that has it
    model = lm_scoring.train_lm(df, p)
    shared = type("Shared", (), {"value": model})
    rows = [pa.RecordBatch.from_pydict({"text": [t], "row": [i]}) for i, t in enumerate(texts)]
    drawn = [np.frombuffer(x, model.kind).reshape(-1, 6) for b in lm_scoring._draw(shared, p, 3)(rows) for x in b.column(3).to_pylist()]
    assert abs(sum(map(len, drawn)) / (15 * len(texts)) - 0.5) < 0.02 and len({int(i) for d in drawn for i in d[:, 1]}) == 6


def test_lm_trains_on_every_position(spark):
    n, p = 400, lm_scoring.LmParams()
    df = spark.createDataFrame([(i, f"w{i} w{i} w{i}") for i in range(n)], "doc_id long, text string").repartition(3)
    before = np.random.default_rng(p.seed).standard_normal((len(p.places), n + 2, p.dim)).astype(np.float32) * np.float32(0.1)
    # the vectors of a word at two places left and right are seen from one position only
    assert (np.abs(lm_scoring.train_lm(df, p).tables - before).max(axis=2) > 1e-6)[:, :n].all()


def test_lm_deals_every_position_with_what_is_seen_from_it(spark):
    rng = random.Random(23)
    edge = lm_scoring.PIECE
    texts = [" ".join(f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(n)) for n in (0, 1, 2, 3, 7, edge - 1, edge, edge + 1, edge + 2, 3 * edge + 5)]
    p = lm_scoring.LmParams(vocabulary=30, classes=5)
    model = lm_scoring.train_lm(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p)
    want = Counter()
    for text in texts:
        hashes = Words(pa.array([text])).hashes
        ids = model.ids(hashes)
        codes = model.code_of(hashes, ids)
        around = [[int(ids[t + k]) if 0 <= t + k < len(ids) else model.other + 1 for k in p.places] for t in range(len(ids))]
        want.update((int(c), int(i), *seen) for c, i, seen in zip(codes, ids, around))
    shared = type("Shared", (), {"value": model})
    made = [b for b in lm_scoring._draw(shared, p, 3)([pa.RecordBatch.from_pydict({"text": texts, "row": list(range(len(texts)))})])]
    rows = np.concatenate([np.frombuffer(x, model.kind).reshape(-1, 6) for b in made for x in b.column("rows").to_pylist()])
    keys = np.concatenate([np.frombuffer(x, np.uint64) for b in made for x in b.column("keys").to_pylist()])
    assert Counter(map(tuple, rows.tolist())) == want and len(np.unique(keys)) == want.total()
    # each vector counts with its uses
    uses = lm_scoring.fit_shard(model, rows, p, np.float32(0.1))[1]
    seen = [np.bincount(x, minlength=model.tables.shape[1]) for x in rows[:, 2:].T]
    nodes = np.bincount(model.turns(rows[:, 0].astype(int))[1], minlength=len(model.nodes))
    assert (uses == np.concatenate([*seen, np.full(len(model.bias), len(rows)), nodes])).all()


def test_lm_deals_copies_of_a_row_over_all_shards(spark):
    df = spark.createDataFrame([(None, "a b c d e")] * 5000 + [(i, f"a w{i}") for i in range(2000)], "doc_id long, text string")
    p = lm_scoring.LmParams(vocabulary=5)
    base = df.select("text", F.xxhash64("doc_id", "text").alias("row"))
    model = lm_scoring.train_lm(df, p)
    shared = type("Shared", (), {"value": lm_scoring.replace(model, counts=None)})()
    cuts = []
    for cut in (base.coalesce(1), base.repartition(5)):
        pieces = lm_scoring.deal(cut.mapInArrow(lm_scoring._cut(shared, p), "spot long, lead long, own long, codes binary"), 2, 8).toArrow()
        cuts.append(sorted(map(str, pieces.to_pylist())))
    assert cuts[0] == cuts[1]
    size = Counter()
    for r in pieces.to_pylist():
        size[r["shard"], r["round"]] += r["copies"] * r["own"]
    assert size.total() == 5000 * 5 + 2000 * 2 and len(size) == 16 and max(size.values()) < 3 * size.total() / 16
    keys, rows = lm_scoring.positions(model, p, 0, pieces.combine_chunks().to_batches()[0])
    assert len(np.unique(keys)) == len(rows) == size.total()


def test_lm_scores_do_not_depend_on_the_cut(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").cache()
    p = lm_scoring.LmParams(vocabulary=500, counted=3000, classes=12, shard=3000, rounds=2, share=2)
    got = []
    for df in (docs.coalesce(1), docs.repartition(7, "text")):
        got.append({r["doc_id"]: (r["mean_log_prob"], r["n_tokens"]) for r in lm_scoring.score_lm(df, lm_scoring.train_lm(df, p)).collect()})
    assert got[0].keys() == got[1].keys() and max(abs(got[0][d][0] - got[1][d][0]) for d in got[0]) < 1e-3


def test_lm_predicts_words_outside_the_vocabulary_from_both_sides(spark):
    rng = random.Random(14)
    sides = [[f"{c}{i}" for i in range(200)] for c in "xy"]
    texts = [" ".join(f"{'ab'[k]} {rng.choice(sides[k])} {'cd'[k]}" for _ in range(30)) for k in (rng.randrange(2) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_scoring.train_lm(df, lm_scoring.LmParams(vocabulary=4, classes=3, share=1, epochs=4, codes=10))
    words = Words(pa.array(texts))
    outside = model.ids(words.hashes) == model.other
    assert outside.sum() == len(words) // 3
    own = Counter(words.hashes[outside].tolist())
    plain = np.mean([np.log(own[h] / outside.sum()) for h in words.hashes[outside].tolist()])
    assert model.log_probabilities(words)[outside].mean() > plain + 0.3


def test_lm_descends_along_the_gradient():
    rng = np.random.default_rng(15)
    ways, sides, odds = lm_scoring._hash_tree(np.arange(1, 9), 0)
    path, first = np.array([n for w in ways for n in w]), np.concatenate([[0, 0, 0], np.cumsum([len(w) for w in ways])])
    model = lm_scoring.LmModel(np.empty(0, np.uint64), np.empty(0, int), np.empty(0), np.array([0, 1]), np.zeros(2), rng.normal(size=(2, 3, 4)), rng.normal(size=(4, 2)), rng.normal(size=2), rng.normal(size=(7, 4)), np.array(odds), first, path, np.array([x for s in sides for x in s], float), np.zeros(8), (-1, 1))
    codes, ids, seen = np.array([4]), np.array([1]), [np.array([0]), np.array([2])]

    def loss(m):
        h = m.hidden(seen)
        scores = h @ m.out + m.bias
        row, node, side = m.turns(codes)
        return -(scores[0, m.class_of[ids[0]]] - np.log(np.exp(scores[0]).sum()) - np.log1p(np.exp(-side * ((h[row] * m.nodes[node]).sum(axis=1) + m.turn[node]))).sum())

    for name, scale in (("out", 1.0), ("bias", 1.0), ("nodes", 0.125), ("turn", 0.125), ("tables", 0.125)):
        moved = {k: np.array(getattr(model, k), float) for k in ("tables", "out", "bias", "nodes", "turn")}
        after = lm_scoring.replace(model, **{k: v.copy() for k, v in moved.items()})
        lm_scoring.descend(after, codes, ids, seen, np.float64(1e-6))
        step = (getattr(after, name) - moved[name]) / -1e-6
        for at in zip(*(rng.integers(0, n, 12) for n in moved[name].shape)):
            ends = []
            for sign in (1, -1):
                shifted = moved[name].copy()
                shifted[at] += sign * 1e-5
                ends.append(loss(lm_scoring.replace(model, **{name: shifted})))
            assert abs(step[at] - scale * (ends[0] - ends[1]) / 2e-5) < 1e-4


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clash = docs.withColumn("score", F.lit(1)).withColumn("kept", F.lit(False))
    good = corpus_pipeline.good_quality(spark, clash, DIR)
    model = quality.train_quality(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.score_quality(docs, model).collect() if r["score"] >= 0.3}
    good = good.cache()
    kept = corpus_pipeline.one_of_each(spark, good, DIR).cache()
    groups = linked_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in groups.items() if c == d}
    clean = corpus_pipeline.without_personal_data(spark, kept, DIR).cache()
    assert clean.count() == kept.count() and clean.columns == list(corpus_pipeline.COLUMNS)
    assert not clean.where("text rlike '[a-z0-9]@[a-z0-9-]+[.][a-z]'").count()
    sample = corpus_pipeline.mixed(spark, clean, DIR).cache()
    assert 0 < sample.count() <= clean.count() and sample.columns == list(corpus_pipeline.COLUMNS)
    c = sentencepiece_codec.PieceCodec(PIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    for r in corpus_pipeline.token_ids(spark, sample, DIR).collect():
        assert r["ids"] == c.encode(texts[r["doc_id"]]) + [2] and r["n_tokens"] == len(r["ids"])
    assert corpus_pipeline.run(spark, DIR).count() == len(texts)


@pytest.mark.parametrize("row", [(1, None, None, None, None), (None, "a b", "en", None, 3)])
def test_pipeline_on_odd_rows(spark, row):
    df = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, DIR).count() <= 1
        assert stage(spark, df.limit(0), DIR).count() == 0


def test_words_hash_is_stable():
    assert hashlib.sha256(Words(pa.array(["a b", "é"])).hashes.tobytes()).hexdigest() == hashlib.sha256(Words(pa.array(["a b", "é"])).hashes.tobytes()).hexdigest()


def test_members_of_a_hub_meet_once(spark):
    from cellmend.llm.minhash_dedup import LONGS, _meetings
    from cellmend.sources.scratch import Scratch

    rows = [(1, b, 100, 74, [*range(20), 100 + b]) for b in range(2, 8)]  # all lack the hub's and have 20 first shingles in common
    tried = spark.createDataFrame(rows, "a long, b long, n long, shared long, keys array<long>")
    parts = spark.createDataFrame([], "node long, component long")
    maps = spark.createDataFrame([(b, [-1] * LONGS) for b in range(2, 8)], "node long, bits array<long>")
    met = sorted(map(tuple, _meetings(tried, parts, maps, Scratch(spark)).select("a", "b").distinct().collect()))
    assert met == [(a, b) for a in range(2, 8) for b in range(a + 1, 8)]
    assert _meetings(tried, parts, maps, Scratch(spark)).count() <= 2 * len(met)  # either may be the larger one
