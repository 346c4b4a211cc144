"""Licence scans by a positional index of rare words (operator 13); DataFrame functions only.

Templates are passages of licences, cut where names and years vary. One pass over the documents counts how many hold each word of the
templates; a template's anchors are its words of the highest inverse document frequency, with their places. The index gives for a word
the templates and places that it anchors.

A second pass looks up the words of a text that propose (each template's rarest few): a word at place i that a template has at place p
proposes that the template starts at i - p. The other anchors' postings are intersected with that start by their relative places, and what
enough of the anchors' weight agrees with is verified: the template's mandatory phrases must stand at their places, word for word. All
of it is one expression on each row, linear in the words: nothing is exploded or shuffled but the words' counts, so a text's length and
repeated passages matter to its own row only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of lower-cased texts.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A passage of words (lower case, single spaces) that tells of a licence, and the phrases of it that must stand as they are.

    ``base``: all of it must stand, and its places are counted.
    """

    label: str
    words: str
    phrases: tuple[str, ...] = ()
    base: bool = False


#: The phrases that tell of a licence by themselves, and passages of the licences' own texts.
BASE = (Template("mit", "mit license", base=True), Template("apache", "apache license", base=True), Template("gpl", "general public license", base=True))
PASSAGES = (
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge to any person obtaining a copy",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ("general public license as published by",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


@dataclass(frozen=True)
class LicenseParams:
    """``anchors``: of a passage, its rarest words (all of a base phrase); ``proposing``: of these, how many propose places; ``share``: of
    the anchors' weight that must agree."""

    templates: tuple[Template, ...] = BASE + PASSAGES
    anchors: int = 8
    proposing: int = 3
    share: float = 0.75


def lowered(column: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), _UPPER, _LOWER)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words.split()})


def word_weights(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, float]:
    """The inverse document frequency of each word: ln((documents + 1) / (documents that hold it + 1)) + 1, to six places."""
    held = F.array_distinct(F.filter(F.regexp_extract_all(lowered(text_col), F.lit(WORD), F.lit(0)), lambda w: w.isin(words)))
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}  # a row for each word of the templates, and one for all documents
    return {w: round(math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1, 6) for w in words}


@dataclass(frozen=True)
class _Indexed:
    """A template with its anchors ``(place, word, weight)``, rarest first."""

    template: Template
    anchors: tuple[tuple[int, str, float], ...]


def index(weights: dict[str, float], params: LicenseParams) -> list[_Indexed]:
    """Each template's anchors: its words of the highest weight, of equals the first, each word once (a base phrase's: all of its places)."""
    out = []
    for t in params.templates:
        words = t.words.split()
        places = range(len(words)) if t.base else [i for i, w in enumerate(words) if w not in words[:i]]
        anchors = sorted(((i, words[i], weights[words[i]]) for i in places), key=lambda a: (-a[2], a[0]))
        out.append(_Indexed(t, tuple(anchors if t.base else anchors[: params.anchors])))
    return out


def _proposals(words: Column, found: list[_Indexed], params: LicenseParams) -> Column:
    """The starts that the words propose, as ``start * templates + template``, each once."""
    postings: dict[str, list[int]] = {}
    for number, t in enumerate(found):
        for place, word, _ in t.anchors[: 1 if t.template.base else params.proposing]:
            postings.setdefault(word, []).append(number - place * len(found))
    keys = sorted(postings)
    table = F.create_map(*[x for w in keys for x in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in postings[w]]))])
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(keys), F.struct(i.cast("long").alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    starts = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["w"]), lambda v: h["i"] * len(found) + v)))
    return F.array_distinct(F.filter(starts, lambda s: s >= 0))


def _agreement(words: Column, proposal: Column, found: list[_Indexed], params: LicenseParams) -> Column:
    """The share of the anchors' weight that stands where the proposal has it; 0 if that is too little or a mandatory phrase is not there."""
    start, out = F.floor(proposal / len(found)).cast("int"), F.lit(0.0)
    number = (proposal % len(found)).cast("int")

    def stands(place: int, word: str) -> Column:
        return F.coalesce(F.get(words, start + place) == word, F.lit(False))

    for i, t in enumerate(found):
        whole = sum(a[2] for a in t.anchors)
        agreed = reduce(lambda a, b: a + b, [F.when(stands(p, w), F.lit(x)).otherwise(F.lit(0.0)) for p, w, x in t.anchors]) / whole
        passage, needed = t.template.words.split(), 1.0 if t.template.base else params.share
        verified = F.lit(True)
        for phrase in (t.template.words,) if t.template.base else t.template.phrases:
            at = next(j for j in range(len(passage)) if passage[j : j + len(phrase.split())] == phrase.split())
            verified = reduce(lambda a, b: a & b, [stands(at + j, w) for j, w in enumerate(phrase.split())], verified)
        out = F.when(number == i, F.when((F.round(agreed, 9) >= needed) & verified, F.round(agreed, 9)).otherwise(F.lit(0.0))).otherwise(out)
    return out


def scan_licenses(docs: DataFrame, params: LicenseParams = LicenseParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, places)``: the words of each text, and ``(start, label, base, score)`` of each licence passage found, by start.

    A null text is empty and has no places; repeated rows and rows without an id each have their own; other columns take no part; an empty
    table gives an empty result. Words' counts are over all documents; a passage's score is the agreed share of its anchors' weight.
    """
    found = index(word_weights(docs, vocabulary(params.templates), text_col), params)
    labels, bases = F.array(*[F.lit(t.template.label) for t in found]), F.array(*[F.lit(t.template.base) for t in found])
    words = docs.select(F.col(id_col), F.regexp_extract_all(lowered(text_col), F.lit(WORD), F.lit(0)).alias("words"))
    proposed = words.select(id_col, "words", _proposals(F.col("words"), found, params).alias("proposed"))

    def place(p: Column) -> Column:
        n = (p % len(found)).cast("int")
        return F.struct(F.floor(p / len(found)).alias("start"), F.get(labels, n).alias("label"), F.get(bases, n).alias("base"), _agreement(F.col("words"), p, found, params).alias("score"))

    places = F.array_sort(F.filter(F.transform("proposed", place), lambda x: x["score"] > 0))
    return proposed.select(id_col, F.size("words").cast("long").alias("n_words"), places.alias("places"))


def license_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of the scan's rows; the score is the best place's, or 0."""
    base, places = F.col("base"), F.col("places")
    listed = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    with_base = scanned.withColumn("base", F.filter("places", lambda x: x["base"]))
    ends = [F.get(base, at)["start"] for at in (F.lit(0), F.size(base) - 1)]
    score = F.coalesce(F.array_max(F.transform(places, lambda x: x["score"])), F.lit(0.0))
    return with_base.select(id_col, "n_words", F.size("base").cast("long").alias("n_base"), ends[0].alias("first_word"), ends[1].alias("last_word"), listed(base).alias("base_labels"), listed(places).alias("labels"), score.alias("score"))


def licenses_sql(params: LicenseParams = LicenseParams()) -> str:
    """The digest of the whole scan on a view ``documents``."""
    q = lambda s: "'" + s + "'"
    templates = [(i, t, t.words.split()) for i, t in enumerate(params.templates)]
    posted = ", ".join(f"({i}, {q(w)}, {p})" for i, t, ws in templates for p, w in enumerate(ws) if t.base or w not in ws[:p])
    about = ", ".join(f"({i}, {q(t.label)}, {t.base})" for i, t, _ in templates)
    must = []
    for i, t, ws in templates:
        for phrase in (t.words,) if t.base else t.phrases:
            part = phrase.split()
            at = next(j for j in range(len(ws)) if ws[j : j + len(part)] == part)
            must += [f"({i}, {at + j}, {q(w)})" for j, w in enumerate(part)]
    words = ", ".join(q(w) for w in vocabulary(params.templates))
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        w AS MATERIALIZED (SELECT row, i, word FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d) WHERE word IN ({words})),
        posted(t, word, p) AS (VALUES {posted}), about(t, label, base) AS (VALUES {about}), must(t, p, word) AS (VALUES {", ".join(must)}),
        df AS (SELECT word, count(DISTINCT row) AS n FROM w GROUP BY word),
        ranked AS (SELECT t, p, word, x, base, row_number() OVER (PARTITION BY t ORDER BY x DESC, p) AS place FROM (SELECT t, p, posted.word, base, round(ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1, 6) AS x FROM posted JOIN about USING (t) LEFT JOIN df USING (word))),
        anchors AS MATERIALIZED (SELECT *, place <= CASE WHEN base THEN 1 ELSE {params.proposing} END AS proposes FROM ranked WHERE base OR place <= {params.anchors}),
        starts AS (SELECT DISTINCT row, t, i - p AS start FROM w JOIN anchors USING (word) WHERE proposes AND i >= p),
        agreed AS (SELECT s.row, s.t, s.start, round(sum(a.x) / any_value(total), 9) AS score FROM starts AS s JOIN (SELECT *, sum(x) OVER (PARTITION BY t) AS total FROM anchors) AS a USING (t) JOIN w ON w.row = s.row AND w.i = s.start + a.p AND w.word = a.word GROUP BY ALL),
        held AS (SELECT s.row, s.t, s.start FROM starts AS s JOIN (SELECT *, count(*) OVER (PARTITION BY t) AS needed FROM must) AS m USING (t) JOIN w ON w.row = s.row AND w.i = s.start + m.p AND w.word = m.word GROUP BY ALL HAVING count(*) = any_value(needed)),
        found AS (SELECT row, start, label, base, score FROM agreed JOIN held USING (row, t, start) JOIN about USING (t) WHERE score >= CASE WHEN base THEN 1.0 ELSE {params.share} END)
        SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(words)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base, CAST(min(start) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(start) FILTER (WHERE base) AS BIGINT) AS last_word,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
        FROM d LEFT JOIN found USING (row) GROUP BY row"""
