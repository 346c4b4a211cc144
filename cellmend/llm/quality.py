"""Document quality by supervised subword embeddings (operator 4).

Words and their character n-grams are hashed into a table of learned vectors; a document is the average of its features'
vectors and a softmax over two outputs gives the score. The model is trained by stochastic gradient descent in numpy on a
sample of labelled documents of bounded size. Scoring reads every whole text: since the output is linear in the average,
each word adds one number, which a bounded memo keeps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import carried, crc_fold, slices, text_of

_MEMO = 250_000


@dataclass(frozen=True)
class QualityParams:
    """``per_class`` bounds the training sample: so many labelled documents of each class at most."""

    buckets: int = 1 << 15
    dim: int = 12
    grams: tuple[int, ...] = (3, 4)
    per_class: int = 1000
    epochs: int = 6
    rate: float = 0.5
    seed: int = 17
    folds: int = 5


@dataclass(frozen=True)
class QualityModel:
    """``margin`` by bucket: the difference of the two outputs that a feature adds; ``bias`` holds the classes' shares."""

    margin: np.ndarray
    bias: float
    params: QualityParams


def features(word: bytes, p: QualityParams) -> list[int]:
    """Buckets of the word itself and of its character n-grams (over UTF-8 bytes, with marks at both ends)."""
    mask, padded = p.buckets - 1, b"<" + word + b">"
    return [zlib.crc32(padded) & mask] + [zlib.crc32(padded[i : i + n]) & mask for n in p.grams for i in range(len(padded) - n + 1)]


def _document_features(texts: Iterator[bytes], p: QualityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and each one's share of all features."""
    memo: dict[bytes, np.ndarray] = {}
    for text in texts:
        rows = []
        for word in text.split():
            row = memo.get(word)
            if row is None:
                if len(memo) > _MEMO // 4:
                    memo.clear()
                row = memo[word] = np.array(features(word, p), np.int32)
            rows.append(row)
        ids = np.concatenate(rows) if rows else np.empty(0, np.int32)
        counts = np.bincount(ids, minlength=1)
        distinct = np.flatnonzero(counts).astype(np.int32)
        yield distinct, (counts[distinct] / max(len(ids), 1)).astype(np.float32)


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from labelled rows outside fold 0.

    Rows without a label or an id are not learnt from; of several labels for an id the largest holds, of several texts one.
    Without any labelled row the model scores everything 0.5. The sample is the ``per_class`` ids of smallest hash in each class.
    """
    p = params
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold("id", p.folds) != 0))
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id", F.lit(p.seed)), F.col("id")]
    sample = [own.where(F.col("label") == k).orderBy(*order).limit(p.per_class) for k in (0, 1)]
    chosen = sample[0].unionByName(sample[1])  # at most 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(_document_features(batch.column(2).cast(pa.binary()).to_pylist(), p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())], names=["id", "label", "buckets", "shares"])

    kind = own.schema["id"].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    found = texts.mapInArrow(run, f"id {kind}, label int, buckets binary, shares binary")
    one = found.groupBy("id").agg(F.max(F.struct("buckets", "shares", "label")).alias("row"))  # of an id's texts one leaves the executors
    rows = sorted(one.select("id", "row.*").toArrow().to_pylist(), key=lambda r: r["id"])
    data = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in rows]
    return fit(data, shares, p)


def fit(data: list[tuple[np.ndarray, np.ndarray, int]], shares: dict[int, int], p: QualityParams) -> QualityModel:
    """Stochastic gradient descent over documents given as (buckets, shares, label)."""
    if len({label for *_, label in data}) < 2:
        return QualityModel(np.zeros(p.buckets, np.float32), 0.0, p)
    rng = np.random.default_rng(p.seed)
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out = np.zeros((p.dim, 2), np.float32)
    of_class = {k: sum(label == k for *_, label in data) for k in (0, 1)}
    steps, total = 0, p.epochs * len(data)
    for _ in range(p.epochs):
        for i in rng.permutation(len(data)):
            buckets, weight, label = data[i]
            rate = p.rate * (1 - steps / total) * len(data) / (2 * of_class[label])
            steps += 1
            hidden = weight @ table[buckets]
            scores = hidden @ out
            e = np.exp(scores - scores.max())
            wrong = e / e.sum()
            wrong[label] -= 1
            back = out @ wrong
            out -= rate * np.outer(hidden, wrong)
            # the average's gradient, scaled up by the number of features so that long and short texts learn alike
            table[buckets] -= rate * np.outer(weight * min(len(buckets), 100), back)
    known = shares.get(0, 0) + shares.get(1, 0)
    prior = math.log(max(shares.get(1, 0), 1) / max(shares.get(0, 0), 1)) if known else 0.0
    return QualityModel((table @ (out[:, 1] - out[:, 0])).astype(np.float32), prior, p)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keep..., score)``: the probability of label 1 for every whole text.

    Null, empty and blank texts have the classes' shares alone as their score; repeated rows give repeated results; an empty table gives
    an empty result. Columns other than those named take no part; ``keep`` may not name ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * 4 bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        margin = m.margin.astype(np.float64).tolist()
        memo: dict[bytes, complex] = {}

        def learn(word: bytes) -> complex:
            found = features(word, m.params)
            value = complex(sum([margin[f] for f in found]), len(found))
            if len(word) <= 64:
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[word] = value
            return value

        for batch in slices(batches):
            logits = np.full(batch.num_rows, m.bias)
            for i, text in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                total = sum([memo.get(w) or learn(w) for w in text.split()], 0j)  # real: margins, imaginary: features
                if total.imag:
                    logits[i] += total.real / total.imag
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))))], names=[*batch.schema.names[:-1], "score"])

    rest = carried((id_col, *keep), ("score",))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(rest)) + ", score double"
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], text_of(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(rest)})
