"""Document fingerprints: bottom-k sketches of shingle hashes (operator 7).

A fingerprint is the k least of the distinct hashes (48 bits) of a text's five-word shingles, in ascending order, as 12 hexadecimal
digits each. Fewer than k hashes mean that the sketch is the whole set. Sketches of parts merge into the sketch of the whole, and
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.llm.common import Words, text_of
from cellmend.llm.minhash_dedup import shingle_sets

WIDTH = 5
K = 128
BITS = 48
_DIGITS = BITS // 4
_NULL_ID = -(1 << 63)
SLICE = 1_000_000
#: A frequent id's rows are dealt by so many first characters of their texts, at cuts from so many texts for each bucket.
PREFIX, SAMPLE = 200, 16


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The sketch of each text; words are runs of characters other than ASCII white space, unchanged."""
    hashes, first = shingle_sets(Words(pa.array(texts, pa.large_string())), WIDTH)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        values = hashes[a : min(b, a + k + 8)] >> np.uint64(64 - BITS)
        if len(values) > 1:
            values = values[np.concatenate([[True], values[1:] != values[:-1]])]
        out.append(values[:k])
    return out


def to_text(sketch: np.ndarray) -> str:
    return np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]).tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).view(">u8").ravel().astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity of two sketched sets, from the k least of their union; 1 for two empty sets."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    union = len(both) - int(twice.sum())
    if union <= k or (len(a) < k and len(b) < k):
        return int(twice.sum()) / union
    new = np.concatenate([[True], ~twice])
    end = np.flatnonzero(new)[k]  # where the union's next value would start
    return int(twice[: end - 1].sum()) / k


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * float(1 << BITS) / (float(sketch[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that the second holds; 1 for an empty first set."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * (distinct_count(a, k) + distinct_count(b, k)) / (1 + r) / distinct_count(a, k))


def edit(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def merge_fingerprints(parts: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """``(by..., fingerprint)``: the sketch of each group's union. Null fingerprints count as empty sets; a group's parts may be many,
    as their values meet in ``salts`` shares first."""
    rows = parts.select(*by, F.coalesce(F.col(fingerprint), F.lit("")).alias("f"))
    every = rows.select(*by).distinct()
    cut = F.when(F.length("f") > 0, F.expr(f"transform(sequence(0, cast(length(f) / {_DIGITS} as int) - 1), i -> substr(f, i * {_DIGITS} + 1, {_DIGITS}))")).otherwise(F.array().cast("array<string>"))
    values = rows.select(*by, F.explode(cut).alias("value")).distinct().withColumn("salt", F.pmod(F.hash("value"), F.lit(salts)))
    for group in ([*by, "salt"], by):
        values = values.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("value"))).where(F.col("place") <= k).drop("place")
    merged = values.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("value")), "").alias(fingerprint))  # k values at most
    return every.join(merged, by, "left").withColumn(fingerprint, F.coalesce(fingerprint, F.lit("")))


def place_among(cuts: list[int], value: Column, ties: list[str] | None = None, tie: Column | None = None) -> Column:
    """How many of the ascending cuts are not above the value, found by halving. ``ties``: a text for each cut, to compare with ``tie``
    where the cut equals the value."""
    if not cuts:
        return F.lit(0)
    table, steps = F.lit(cuts), F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    texts = F.lit(ties) if ties and any(ties) else None

    def ahead(at: Column, step: Column) -> Column:
        there = at + step
        cut = F.get(table, there - 1)
        below = cut <= value if texts is None else (cut < value) | ((cut == value) & (F.get(texts, there - 1) <= tie))
        return F.when((there <= len(cuts)) & below, there).otherwise(at)

    return F.aggregate(steps, F.lit(0), ahead)


def _cuts(base: DataFrame, parts: int) -> list[tuple[int, str]]:
    """Where buckets begin, as (id, start of a text). An id that is several quantiles at once is cut into as many ranges of its texts, by
    the first ``PREFIX`` characters of ``SAMPLE`` of them for each range."""
    quantiles = Counter(int(x) for x in base.approxQuantile("doc", [i / parts for i in range(1, parts)], max(0.2 / parts, 1e-4)))
    cuts = {(doc, "") for doc in quantiles}
    hot = {doc: n for doc, n in quantiles.items() if n > 1}
    if hot:
        rows = base.where(F.col("doc").isin([*hot])).select("doc", F.left("text", F.lit(PREFIX)).alias("start"))
        sample = rows.orderBy(F.rand(7)).limit(SAMPLE * sum(hot.values())).collect()  # as many for each bucket; only sets the cuts
        for doc, n in hot.items():
            starts = sorted(r["start"] for r in sample if r["doc"] == doc)
            cuts |= {(doc, starts[len(starts) * i // n]) for i in range(1, n) if starts}
            cuts |= {(doc + 1, "")} if doc < -1 - _NULL_ID else set()
    return sorted(cuts - {(_NULL_ID, "")})


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(bucket, guard, doc, text)`` dealt by ranges of ids and sorted: after each bucket's rows comes, as a guard, the row that follows
    them in the next bucket (the first row of all after the last). A frequent id (or null) is dealt by ranges of its texts, so only
    rows whose texts begin alike stay together. One shuffle of the texts; the driver sees one id for each bucket."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), text_of(text_col).alias("text"))
    cuts = _cuts(base, parts) if parts > 1 else []
    hot = sorted({doc for doc, start in cuts if start})
    base = base.withColumn("start", F.when(F.col("doc").isin(hot), F.left("text", F.lit(PREFIX))).otherwise("") if hot else F.lit(""))
    base = base.withColumn("bucket", place_among([doc for doc, _ in cuts], F.col("doc"), [start for _, start in cuts], F.col("start")))
    heads = sorted((r["bucket"], *r["head"]) for r in base.groupBy("bucket").agg(F.min(F.struct("doc", "start")).alias("head")).collect())
    guards = [(doc, start, heads[i - 1][0]) for i, (_, doc, start) in enumerate(heads)]  # each head also goes to the bucket before its own
    lookup = spark.createDataFrame(guards, "head long, head_start string, before int")
    again = base.join(F.broadcast(lookup), (base["doc"] == lookup["head"]) & (base["start"] == lookup["head_start"]), "left")  # a row for each bucket
    rows = again.select("doc", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(0).alias("guard")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("guard")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guard"))))).alias("to"))
    rows = rows.select("to.bucket", "to.guard", "doc", "text")
    return rows.repartitionById(max(1, len(cuts) + 1), F.col("bucket")).sortWithinPartitions("bucket", "guard", "doc", "text")


def _fingerprint(k: int):
    names = ["doc", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "within_next"]

    def emit(rows: list[tuple[int, int, str]], following: list[str]) -> pa.RecordBatch:
        texts = [t for *_, t in rows]
        edited = [edit(t, f) for t, f in zip(texts, following)]
        last = len(texts) and following[-1]
        own, other = sketches([*texts, last or ""], k), sketches(edited, k)
        # a row's next is the row after it, but for the last row of a bucket or slice
        after = [own[i + 1] if i + 1 < len(own) and (i + 1 == len(rows) or texts[i + 1] is following[i]) else None for i in range(len(rows))]
        for i in [i for i, s in enumerate(after) if s is None]:
            after[i] = sketches([following[i]], k)[0]
        columns = [
            pa.array([d for _, d, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([to_text(s) for s in own[: len(rows)]], pa.string()),
            pa.array([to_text(s) for s in other], pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, other)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, after)], pa.float64()),
            pa.array([distinct_count(a, k) for a in own[: len(rows)]], pa.float64()),
            pa.array([containment(a, b, k) for a, b in zip(own, after)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        rows: list[tuple[int, int, str]] = []
        following: list[str] = []
        size = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for bucket, guard, doc, text in zip(*(c.to_pylist() for c in columns[:3]), (x.as_py() for x in columns[3])):
                if held is not None and held[0] == bucket:
                    rows.append(held)
                    following.append(text)
                    size += len(held[2])
                    if size > SLICE:
                        yield emit(rows, following)
                        rows, following, size = [], [], 0
                held = None if guard else (bucket, doc, text)
        if rows:
            yield emit(rows, following)

    return run


def fingerprint_documents(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, within_next)`` for every row.

    The last two are the estimated number of distinct shingles, and the share of them that the next text holds, too.
    ``edited`` is the text with its last half replaced by the start of the next text in ascending order of ids (after the last, the first;
    rows of equal ids by text, null ids first; a single row is its own next). Texts of fewer than five words have one shingle, null and
    empty texts none: their fingerprint is empty, and like another empty one. Repeated rows follow each other. An empty table gives an
    empty result; columns other than the two named take no part. Ids are integers.
    """
    kind = docs.schema[id_col].dataType
    out = with_next(docs, id_col, text_col).mapInArrow(_fingerprint(k), "doc long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, within_next double")
    return out.withColumn("doc", F.when(F.col("doc") != _NULL_ID, F.col("doc")).cast(kind)).withColumnRenamed("doc", id_col)
