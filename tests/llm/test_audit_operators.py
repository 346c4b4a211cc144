"""Source divergence, centroid clustering and licence scans against plain Python on small and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellmend.llm import clustering, divergence, licenses
from cellmend.llm.clustering import ClusterParams, Round, squared
from cellmend.llm.divergence import DivergenceParams
from cellmend.llm.licenses import LicenseParams, Template

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(docs, p):
    docs = [tuple(x or "" for x in d) for d in docs]  # text, lang, source
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER)) for t, _, _ in docs]
    held, group = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), ts in zip(docs, terms):
        held[lang].update(set(ts))
        group[lang, source].update(ts)
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= p.documents]
        whole = sum((group[k] for k in group if k[0] == lang), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + p.smooth) // (sum(c[x] for x in kept) + p.smooth * len(kept)) for t in kept}
        own = {k[1]: shares(c) for k, c in group.items() if k[0] == lang}
        q = shares(whole)
        for s, mine in own.items():
            pairs = [(o, sum(abs(mine[t] - other[t]) for t in kept)) for o, other in own.items() if o != s]
            above = [(t, mine[t] - q[t]) for t in kept if group[lang, s][t] and mine[t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", above, p.top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(rows[:most])]
    return sorted(out)


def make_texts(seed, rows, sources):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma-ray", "Ünïcode", "x1y", "日本", "İ", "de", "la", "zu"]
    out = []
    for _ in range(rows):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(sources)
        weights = [1 + (hash_of(f"{source}{w}") % 7) for w in words]
        out.append((rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choices(words, weights, k=rng.randrange(12))), lang, source))
    return out + out[:7] + [("no kept terms here", "solo", "only"), (None, "solo", "second"), ("!!", "lone", "one")]


def hash_of(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("params", [DivergenceParams(documents=3, top=4), DivergenceParams(documents=3, top=2, chunk=2, block=2, stripe=2)])
def test_divergence_equals_plain_python(spark, params):
    rows = make_texts(1, 150, [f"s{i}" for i in range(9)] + [None])
    docs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, chunk string").repartition(5)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, params).collect())
    assert got == plain_divergence(rows, params)


def test_divergence_of_nothing_and_of_one_long_text(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert divergence.source_divergence(spark.createDataFrame([], schema)).collect() == []
    rows = [(f"w{i} common " * 4000, "en", s) for i, s in enumerate("abab")]
    rows = [(re.sub(r"\d", lambda m: "xyzt"[int(m[0])], t), lang, s) for t, lang, s in rows]
    params = DivergenceParams(documents=2)
    got = sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame([(0, *r) for r in rows], schema), params).collect())
    assert got == plain_divergence(rows, params)


def test_shares_are_exact_beyond_doubles(spark):
    cases = [(10**15 - 1, 10**15 + 7), (123456789012345, 8 * 10**15), (5, 5), (0, 3)]
    df = spark.createDataFrame(cases, "n long, total long")
    from pyspark.sql import functions as F

    want = [1 + 10**9 * n // t for n, t in cases]
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"))).collect()] == want
    assert divergence._shares(*(np.array(c, np.int64) for c in zip(*cases))).tolist() == want


def plain_k_means(rows, p):
    """rows of (id, vector); a (id, cluster, distance) list, the centroids."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(p.scale * x) if math.isfinite(p.scale * x) else p.scale * int(x) for x in v]) for i, v in kept]
    name = lambda i: hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest()
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, name(kept[j][0]), kept[j][1]))
    centroids = [ints[j][1] for j in order[: p.clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c))
    for _ in range(p.rounds):
        groups = defaultdict(list)
        for _, v in ints:
            groups[nearest(v)].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if groups[c] else centroids[c] for c in range(len(centroids))]
    return [(i, nearest(v), apart(v, centroids[nearest(v)])) for i, v in ints], centroids


def check_k_means(spark, rows, p, kind="double"):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, x double").repartition(3)
    got = clustering.k_means(df, p).collect()
    want, centroids = plain_k_means(rows, p)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    fits = lambda d: d if d < 2**63 else None
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=order) == sorted(((i, c, fits(d)) for i, c, d in sorted(want, key=key)), key=order)
    per = Counter()
    for _, c, d in want:
        per[c] += d
    for r in got:
        if all(d < 2**63 for _, _, d in want) and sum(per.values()) < 2**63:
            assert (r["cluster_inertia"], r["inertia"]) == (per[r["cluster"]], sum(per.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    return got


def test_clustering_equals_plain_python(spark):
    rng = random.Random(2)
    p = ClusterParams(clusters=5, rounds=6, dim=4)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.4) for _ in range(4)]) for i in range(300)]
    rows += [(i, [rng.randrange(-2, 3) / 1024 for _ in range(4)]) for i in range(300, 400)]  # ties
    rows += rows[:20] + [(7, [9.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4)]
    odd = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, math.nan, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [])]
    check_k_means(spark, rows + odd, p)


def test_clustering_of_few_equal_and_no_vectors(spark):
    p = ClusterParams(clusters=8, rounds=3, dim=2)
    check_k_means(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])], p)
    check_k_means(spark, [(i, [1.0, 1.0]) for i in range(20)], p)
    assert clustering.k_means(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    check_k_means(spark, [(i, [float(i % 7), float(i // 9)]) for i in range(60)], p, "float")


@pytest.mark.parametrize("large", [3e4, 1e6, 2.0**52, 1e30, 1.7e308])
def test_clustering_of_large_components(spark, large):
    rng = random.Random(3)
    p = ClusterParams(clusters=3, rounds=4, dim=3)
    rows = [(i, [rng.choice([-1, 1, 0.5]) * large * rng.random() for _ in range(3)]) for i in range(40)] + [(100 + i, [rng.random() for _ in range(3)]) for i in range(20)]
    check_k_means(spark, rows, p)


def test_bounds_save_scans_and_never_change_a_result():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 1, (2000, 8)) * 300 + rng.integers(0, 4, (2000, 1)) * 900).astype(np.int64)
    centroids, before = x[:6].tolist(), None
    state = (np.full(2000, -1), np.full(2000, math.inf), np.full(2000, -math.inf))
    scanned = []
    for _ in range(12):
        r = Round(centroids, before)
        lower = state[2].copy()
        state = r.assign(x, *(s.copy() for s in state))
        scanned.append(int((state[2] > lower).sum()))
        d = squared(x, centroids)
        assert (state[0] == d.argmin(axis=1)).all()
        exact = np.sqrt(d.astype(float))
        assert (state[1] >= exact[np.arange(2000), state[0]]).all()
        exact[np.arange(2000), state[0]] = math.inf
        assert (state[2] <= exact.min(axis=1)).all()
        before, centroids = centroids, [(x[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum())).tolist() if (state[0] == c).any() else centroids[c] for c in range(6)]
    assert scanned[-1] < 400


def plain_scan(texts, p):
    words = [re.findall(licenses.WORD, (t or "").translate(UPPER)) for t in texts]
    known = {w for t in p.templates for w in t.words.split()}
    weight = {w: round(math.log((len(texts) + 1) / (sum(w in ws for ws in map(set, words)) + 1)) + 1, 6) for w in known}
    out = []
    for ws in words:
        places = []
        for t in p.templates:
            tw = t.words.split()
            anchors = sorted(((-weight[w], i) for i, w in enumerate(tw) if t.base or w not in tw[:i]))
            anchors = [i for _, i in (anchors if t.base else anchors[: p.anchors])]
            for start in range(len(ws)):
                at = lambda i: ws[start + i] if start + i < len(ws) else None
                if not any(at(i) == tw[i] for i in anchors[: 1 if t.base else p.proposing]):
                    continue
                share = round(sum(weight[tw[i]] for i in anchors if at(i) == tw[i]) / sum(weight[tw[i]] for i in anchors), 9)
                must = [t.words] if t.base else t.phrases
                fine = all(any(tw[j : j + len(m.split())] == m.split() and ws[start + j : start + j + len(m.split())] == m.split() for j in range(len(tw))) for m in must)
                if share >= (1 if t.base else p.share) and fine:
                    places.append((start, t.label, t.base, share))
        out.append((len(ws), sorted(places)))
    return out


LICENSED = [
    "Released under the MIT License.", "mit  licence; MIT, license", "MIT License MIT License apache license", None, "", "...",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "licensed under the apache license version 3 0", "the GNU General-Public License general public license",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "licensed beneath cc by nc 4 0", "Permission is hereby granted, free of charge, to any person obtaining a copy of the software",
    "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met", "license mit general public", "İMIT license", "mit license mit license",
]


def test_licenses_equal_plain_python(spark):
    rng = random.Random(5)
    vocab = licenses.vocabulary(licenses.BASE + licenses.PASSAGES)
    texts = LICENSED + LICENSED[:3] + [" ".join(rng.choices(vocab + ["Other", "words"], k=rng.randrange(60))) for _ in range(60)] + [" ".join([rng.choice(LICENSED[:3]), t.words.upper(), "end"]) for t in licenses.PASSAGES]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "w", "p") for i, t in enumerate(texts)], "doc_id long, text string, words string, places string")
    got = licenses.scan_licenses(docs).collect()
    want = plain_scan(texts, LicenseParams())
    plain = lambda places: [(p["start"], p["label"], p["base"], round(p["score"], 9)) for p in places]
    assert sorted((r["n_words"], repr(plain(r["places"]))) for r in got) == sorted((n, repr(p)) for n, p in want)
    digest = licenses.license_digest(licenses.scan_licenses(docs)).collect()
    assert len(digest) == len(texts) and all(0 <= r["score"] <= 1 and {*filter(None, r["base_labels"].split(","))} <= {*filter(None, r["labels"].split(","))} for r in digest)
    first = next(r for r in digest if r["doc_id"] == 2)
    assert (first["n_base"], first["first_word"], first["last_word"], first["base_labels"], first["labels"]) == (3, 0, 4, "apache,mit", "apache,mit")
    assert next(r for r in digest if r["doc_id"] == 9)["labels"] == "cc-by-nc"


def test_licenses_of_odd_tables_and_long_texts(spark):
    assert licenses.license_digest(licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    long = "mit license " * 60000 + "license " * 60000
    r = licenses.license_digest(licenses.scan_licenses(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"))).collect()
    assert [tuple(x)[:5] for x in r] == [(1, 180000, 60000, 0, 119998)] * 2


def test_a_base_phrase_of_repeated_words(spark):
    params = LicenseParams(templates=(Template("twice", "very very free", base=True),))
    texts = ["very very very free very very free", "very free", "very very"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), params).orderBy("doc_id").collect()
    assert [[p["start"] for p in r["places"]] for r in got] == [[1, 4], [], []]


def test_licenses_stay_on_the_jvm(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.license_digest(licenses.scan_licenses(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
