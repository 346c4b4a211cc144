"""Operators 1, 3, 4 and 10 against the libraries, brute force, held-out labels and odd rows."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cellmend.llm import pii, quality, sentencepiece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\t\n", "  two  spaces  ", "a▁b", "日本語 テキスト🙂", "é" * 40 + " " * 30, "\x00\x01", "x" * 5000, "a b " * 4000, "same", "same"]


def rows(spark, texts):
    data = [(i, t, "clash", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, id string, score double")


@pytest.fixture(scope="module")
def corpus():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()


def test_codec_equals_library(corpus):
    c, lib = sentencepiece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in corpus[:300] + [t for t in ODD if t]:
        ids, spans = c.encode_with_spans(text)
        assert ids == lib.encode(text) == c.encode(text)
        assert c.decode(ids + [2]) == lib.decode(ids + [2])
        assert all(0 <= a <= b <= len(text.encode()) for a, b in spans)
        assert sorted(spans) == spans
        # the spans of the distinct characters cover the source without gaps
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(text.encode()))


def test_decode_of_any_ids_equals_library():
    c, lib, rng = sentencepiece_codec.PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(1, 12))]
        ids = [i for i in ids if i < 131 or i >= 259]  # whole one-byte characters and pieces
        assert c.decode(ids) == lib.decode(ids)


def test_character_map_takes_the_longest_prefix():
    # a double-array of one key, "ab" -> "Z", and "a" -> "Y"
    units = [0] * 2048
    base = 256

    def unit(offset, label, leaf):
        return (offset << 10) | label | (0x100 if leaf else 0)

    units[0] = unit(base, 0, False)
    a = base ^ ord("a")
    units[a] = unit(512 ^ a, ord("a"), True)
    units[512] = 2
    b = 512 ^ ord("b")
    units[b] = unit(1024 ^ b, ord("b"), True)
    units[1024] = 0
    blob = b"".join(u.to_bytes(4, "little") for u in units)
    m = sentencepiece_codec.CharacterMap(len(blob).to_bytes(4, "little") + blob + b"Z\0Y\0")
    assert m.longest(b"abc", 0) == (2, b"Z")
    assert m.longest(b"ac", 0) == (1, b"Y")
    assert m.longest(b"c", 0) is None
    c = sentencepiece_codec.PieceCodec(MODEL)
    c.map = m
    assert c.normalise("cabéa") == ("▁cZéY", [(0, 0), (0, 1), (1, 3), (3, 5), (5, 6)])


def test_codec_on_odd_rows(spark):
    df = rows(spark, ODD)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_documents(df, MODEL, with_spans=True).collect()}
    assert got[0]["ids"] == got[1]["ids"] == [2] and got[0]["begins"] == [0]
    assert got[len(ODD) - 1]["ids"] == got[len(ODD) - 2]["ids"]
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(df, MODEL), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD)}
    assert sentencepiece_codec.encode_documents(df.where("doc_id < 0"), MODEL).count() == 0


def greedy(word, pieces, longest):
    n, at = 0, 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                n, at = n + 1, end
                break
        else:
            return 0
    return n


def test_token_counts_equal_greedy_matching(spark, corpus):
    pieces = set(token_counts.vocabulary(MODEL))
    longest, words = max(map(len, pieces)), re.compile(r"[^\x20\x09-\x0D]+")
    texts = corpus[:60] + ODD
    for r in token_counts.token_counts(rows(spark, texts), MODEL).collect():
        counts = [greedy("▁" + w, pieces, longest) for w in words.findall(texts[r["doc_id"]] or "")]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(max(1, c) for c in counts), counts.count(0))


def test_automaton_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choices("ab", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))}
        a = token_counts.LongestMatch(sorted(pieces))
        for _ in range(40):
            word = "".join(rng.choices("abc" if rng.random() < 0.1 else "ab", k=rng.randrange(1, 15)))
            assert a.count(word) == greedy(word, pieces, 6), (pieces, word)


def plain_features(text, p):
    for word in text.encode().split():
        padded = b"<" + word + b">"
        yield zlib.crc32(padded) % p.buckets
        for n in p.grams:
            for i in range(len(padded) - n + 1):
                yield zlib.crc32(padded[i : i + n]) % p.buckets


def test_quality_equals_the_plain_average_and_softmax(spark):
    rng, p = random.Random(6), quality.QualityParams(buckets=64, dim=3, epochs=2)
    texts = [" ".join(rng.choices(["good", "bad", "fine", "x" * 300, "é"], k=rng.randrange(1, 9))) for _ in range(12)]
    counts = [Counter(plain_features(t, p)) for t in texts]
    data = [(np.array(sorted(c), np.int32), np.array([c[b] / sum(c.values()) for b in sorted(c)], np.float32), i % 2) for i, c in enumerate(counts)]
    got = [(a.tolist(), b.tolist()) for a, b in quality._document_features((t.encode() for t in texts), p)]
    assert got == [(a.tolist(), b.tolist()) for a, b, _ in data]
    model = quality.fit(data, {0: 6, 1: 6}, p)
    # the same steps on a table of lists
    draw = np.random.default_rng(p.seed)
    table, out = draw.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(float), np.zeros((p.dim, 2))
    step = 0
    for _ in range(p.epochs):
        for i in draw.permutation(len(data)):
            b, w, y = data[i]
            rate = p.rate * (1 - step / 24)
            step += 1
            h = sum(x * table[k] for k, x in zip(b, w))
            e = np.exp(h @ out - max(h @ out))
            wrong = e / e.sum() - np.eye(2)[y]
            back = out @ wrong
            out = out - rate * np.outer(h, wrong)
            for k, x in zip(b, w):
                table[k] -= rate * x * min(len(b), 100) * back
    assert np.allclose(model.margin, table @ (out[:, 1] - out[:, 0]), atol=1e-4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score_quality(df, model).collect():
        c = counts[r["doc_id"]]
        logit = model.bias + sum(float(model.margin[b]) * n for b, n in c.items()) / sum(c.values())
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_kept_columns_may_not_clash(spark):
    df = rows(spark, ["a"]).withColumn("spans", F.lit(1))
    model = quality.train_quality(df, spark.createDataFrame([], "doc_id long, quality int"))
    for run in (lambda: quality.score_quality(df, model, keep=("score",)), lambda: pii.detect_pii(df, keep=("spans",))):
        with pytest.raises(ValueError, match="of its own"):
            run()
    assert quality.score_quality(df, model, keep=("id", "id")).columns == ["doc_id", "id", "score"]


def test_empty_tables(spark):
    df = rows(spark, ["a"]).limit(0)
    assert token_counts.token_counts(df, MODEL).count() == 0 and pii.detect_pii(df, redacted=True).count() == 0
    assert sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(df, MODEL), MODEL).count() == 0


def test_decoding_cuts_by_ids(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "DECODE_IDS", 7)
    texts = ["one two three four five six", "", None, "seven", "eight " * 40, "nine"]
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(rows(spark, texts), MODEL), MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(texts)}


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    scored = quality.score_quality(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)
    assert right >= 0.97 * len(scored) > 30


def test_quality_on_odd_rows(spark):
    df = rows(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(df, quality.train_quality(df, none)).collect()} == {0.5}
    some = spark.createDataFrame([(9, 0), (9, 0), (10, 1), (None, 1), (11, None)], "doc_id long, quality int")
    scored = quality.score_quality(df, quality.train_quality(df, some)).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score_quality(df.where("doc_id < 0"), quality.train_quality(df, some)).count() == 0


def test_quality_of_an_id_with_many_texts(spark):
    docs = spark.createDataFrame([(9, f"good text {i % 40}") for i in range(400)] + [(10, "bad text"), (11, "good text 39")], "doc_id long, text string")
    labels = spark.createDataFrame([(9, 1), (10, 0), (11, 1), (12, 0)], "doc_id long, quality int")
    models = [quality.train_quality(d, labels) for d in (docs, docs.repartition(7).orderBy(F.desc("text")))]
    assert (models[0].margin == models[1].margin).all() and models[0].bias == models[1].bias
    assert (models[0].margin != 0).any()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_base_spans_equal_the_plain_patterns(corpus):
    rng = random.Random(5)
    made = ["".join(rng.choices(["1", "2", "4", "25", "255", "256", "0", ".", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é"], k=30)) for _ in range(4000)]
    made += ["4111 1111 1111 1111", "+44 (0)20 7946 0958.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "٣٣٣٣ ١٢٣٤"]
    for text in corpus + made:
        assert [s[:3] for s in pii.find_spans(text) if s[0] in BASE] == plain(text), text


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert any(s[0] == "iban" for s in pii.find_spans("pay to GB82 WEST 1234 5698 7654 32 now"))
    assert not any(s[0] == "iban" for s in pii.find_spans("pay to GB82 WEST 1234 5698 7654 31 now"))
    for text in ("GB82 WEST 1234 5698 7654 32 BIC DEUTDEFF", "GB82 WEST 1234 5698 7654 32 GB82 WEST 1234 5698 7654 32"):
        found = [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"]
        assert found == ["GB82 WEST 1234 5698 7654 32"] * text.count("WEST")
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert any(s[0] == "secret" for s in pii.find_spans(f'token = "{secret}"')) and not any(s[0] == "secret" for s in pii.find_spans(f"commit {secret} of"))
    told = f"api key={secret}!"
    assert pii.redact(told, pii.find_spans(told)) == "api key=[SECRET]!"
    assert any(s[0] == "ssn" for s in pii.find_spans("her ssn 078-05-1120 was"))
    assert not any(s[0] == "ssn" for s in pii.find_spans("part 078-05-1120 was"))


def test_pii_on_odd_rows(spark):
    got = {r["doc_id"]: r for r in pii.detect_pii(rows(spark, ODD + ["mail é a@b.co, +1 (555) 010-9999"]), redacted=True).collect()}
    assert got[0]["spans"] == [] and got[0]["redacted"] is None and got[1]["redacted"] == ""
    assert got[len(ODD)]["redacted"] == "mail é [EMAIL], [PHONE]"
    assert pii.find_spans("9" * 200_000 + " " + "a" * 200_000) == []


def test_spans_take_time_in_proportion():
    part = "account GB82WEST12345698765432 of ssn 123-45-6789 x@y.zz password key a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8 "
    spans = pii.find_spans(part)
    text = part * (100_000 // len(spans) + 1)
    began = time.process_time()
    many = pii.find_spans(text)
    assert len(many) >= 100_000 and time.process_time() - began < 8
    assert [(k, a - len(part), b - len(part)) for k, a, b, _ in many[len(spans) : 2 * len(spans)]] == [(k, a, b) for k, a, b, _ in spans]
    added = sorted((a, b) for k, a, b, _ in many if k not in pii.BASE_KINDS)
    assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))
