"""Near-duplicate documents by HyperMinHash (operator 8).

A document is the set of its distinct word shingles, each a 64-bit hash of its words' two hashes. The hash's first bits choose one of 512 buckets; a
bucket keeps its least hash as a register of a leading-zero count and some mantissa bits. An empty bucket borrows the register of
the filled one that a fixed permutation of its own names first, so short texts have as many registers as long ones. Bands of
registers are the candidate keys: documents that agree in a band meet. Copies with equal sets are one class and meet once.

Within a band's members each is compared with the smallest id (the hub). Links so confirmed give components, and only members
whose component is not their hub's are then compared with the hub's other members of other components: links inside a component
change nothing. These meet by prefixes: a set is put in order, what the hub lacks first, and linked sets share one of the first
shingles (a quarter of the larger set, a seventh of the smaller), and a bit map of each set bounds what they share. So a band of n copies costs n comparisons, texts that have no more
in common than what the hub has too do not meet at all, and no pair of different components is left out.

A comparison estimates the similarity from the registers, corrected for registers that agree by chance, rules out what is far below
the threshold, and confirms the rest on the full sets. Texts are read twice: for the registers, and (members and hubs only) for the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import Words, joint_runs, mix64, signed, slices, text_of
from cellmend.llm.components import connected_components
from cellmend.sources.scratch import Scratch

WIDTH = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 20
#: Registers in a band, and bands: documents of similarity 0.75 share at least one band but for four pairs in a million.
ROWS = 6
BANDS = 64
#: Standard errors that an estimate may lie below the threshold before the pair is dropped.
MARGIN = 6.0
#: Longs of the bit map of a document's shingles.
LONGS = 16
#: First shingles of a set by which two sets meet once, not at each shingle that they have in common.
FIRSTS = 16
SLICE = 1_500_000
#: Key of the shingle hashes; shorter sequences have the keys that follow.
_KEY = 800
_SEEDS = np.random.default_rng(801).integers(0, 1 << 63, 3, dtype=np.uint64)
_TIMES = np.random.default_rng(802).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RANK = np.argsort(np.random.default_rng(803).random((BUCKETS, BUCKETS)), axis=1).astype(np.uint16)  # by empty bucket
_BAND = mix64(np.arange(BANDS, dtype=np.uint64) + _SEEDS[2])


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and each row's first position (one more at the end).

    A row of fewer words has its whole sequence as its only shingle, a row without words none.
    """
    counts = np.diff(words.first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(words.first[:-1], n) + np.arange(first[-1]) - np.repeat(first[:-1], n)
    hashes = np.empty(len(start), np.uint64)
    full = np.repeat(counts >= width, n)
    hashes[full] = joint_runs(words.hashes, words.checks, width, _KEY)[start[full]]
    for k in range(1, width):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            own = (words.first[rows][:, None] + np.arange(k)).ravel()
            hashes[first[rows]] = joint_runs(words.hashes[own], words.checks[own], k, _KEY + k)[::k]
    for i in np.flatnonzero(n > 1):
        hashes[first[i] : first[i + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[first[:-1][n > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[first]


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rows' registers: leading zeros + 1 and the mantissa of each bucket's least hash; 0 for an empty bucket."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    new = np.ones(len(hashes), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    row, bucket, value = row[new], bucket[new], hashes[new] << np.uint64(BUCKET_BITS)
    zeros = np.minimum(64 - np.frexp(value.astype(np.float64))[1], 64 - BUCKET_BITS)
    zeros = np.where(value >> (63 - zeros).astype(np.uint64) == 0, np.minimum(zeros + 1, 64 - BUCKET_BITS), zeros)  # the conversion rounded up
    rest = value << np.minimum(zeros + 1, 63).astype(np.uint64)
    out = np.zeros((len(first) - 1, BUCKETS), np.uint32)
    out[row, bucket] = ((zeros + 1) << MANTISSA).astype(np.uint32) | (rest >> np.uint64(64 - MANTISSA)).astype(np.uint32)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of all bands, by row; every row has a filled register."""
    full = regs.copy()
    for i in range(len(full)):
        filled = np.flatnonzero(full[i])
        empty = np.flatnonzero(full[i, : BANDS * ROWS] == 0)
        if len(empty):
            full[i, empty] = full[i, filled[_RANK[np.ix_(empty, filled)].argmin(axis=1)]]
    cut = full[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    return mix64((cut.astype(np.uint64) * _TIMES).sum(axis=2) ^ _BAND)


def bit_maps(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By row, which of 64 * LONGS values the hashes' low bits take."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flags = np.zeros((len(first) - 1, 64 * LONGS), bool)
    flags[row, (hashes & np.uint64(64 * LONGS - 1)).astype(np.int64)] = True
    return np.packbits(flags, axis=1).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity, by row, from two tables of registers, less the agreements expected by chance; 1 for two empty rows."""
    used = (a > 0) | (b > 0)
    total = np.maximum(used.sum(axis=1), 1)
    agree = np.where(used.any(axis=1), ((a == b) & used).sum(axis=1), 1)
    # two different least values of a bucket agree if they have the same exponent (one in three) and mantissa
    chance = total / 3 / (1 << MANTISSA) * np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    return np.maximum(0.0, (agree - chance) / (total - chance))


def _marks(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each row's whole set."""
    sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ seed))]) for seed in _SEEDS[:2])
    return [mix64(s[first[1:]] - s[first[:-1]]) for s in sums]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        hashes, first = shingle_sets(Words(batch.column(2), lower=True), WIDTH)
        n, marks = np.diff(first), _marks(hashes, first)
        # only the slice's smallest id of each class needs bands
        ids, copy = batch.column(0), batch.column(1)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((copy.to_numpy(), ids.fill_null(0).to_numpy(), ~known, marks[1], marks[0]))
        leads = np.ones(len(order), bool)
        leads[1:] = (marks[0][order][1:] != marks[0][order][:-1]) | (marks[1][order][1:] != marks[1][order][:-1])
        need = np.zeros(len(order), bool)
        need[order] = leads
        need &= known & (n > 0)
        keys = band_keys(registers(hashes, first)[need]).ravel()
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(need * BANDS)]).astype(np.int32)), signed(keys))
        bits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(need * LONGS)]).astype(np.int32)), pa.array(bit_maps(hashes, first)[need].ravel()))
        yield pa.RecordBatch.from_arrays([ids, copy, pa.array(n), *map(signed, marks), bands, bits], names=["doc", "copy", "n", "c1", "c2", "bands", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        hashes, first = shingle_sets(Words(batch.column(1), lower=True), WIDTH)
        raw = hashes.tobytes()
        sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sets, batch.column(2), batch.column(3)], names=["node", "items", "hubs", "is_hub"])


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a column of sets, and each row's first position."""
    raw = sets.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the second set and of what both share; ``linked``: neither the estimate nor the full sets rule a link out; ``keys``: of
    the second set what the first lacks, then what it has, each by hash, as many as a linked set of like size must meet."""
    error = MARGIN * (PERCENT / 100 * (1 - PERCENT / 100) / BUCKETS) ** 0.5
    for whole in batches:
        for half in slices(iter([whole]), column="items_a", limit=8_000_000):
            for batch in slices(iter([half]), column="items_b", limit=8_000_000):
                (a, at_a), (b, at_b) = _flat(batch.column(2)), _flat(batch.column(3))
                n_a, n_b = np.diff(at_a), np.diff(at_b)
                likely = estimate(registers(a, at_a), registers(b, at_b), n_a, n_b) >= PERCENT / 100 - error * np.sqrt(np.maximum(1, BUCKETS / np.maximum(np.minimum(n_a, n_b), 1)))
                shared, keys = np.zeros(batch.num_rows, np.int64), []
                for i in range(batch.num_rows):
                    left, right = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                    common = left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right
                    shared[i] = common.sum()
                    keys.append(np.concatenate([right[~common], right[common]])[: len(right) * (100 - PERCENT) // 100 + 1])
                linked = likely & (100 * shared >= PERCENT * (n_a + n_b - shared))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_b), pa.array(shared), pa.array(linked), listed], names=["a", "b", "n", "shared", "linked", "keys"])


def _compared(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(_compare, f"a {kind}, b {kind}, n long, shared long, linked boolean, keys array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_keys: bool = False) -> DataFrame:
    """``(id, n_shingles, component_id, kept[, copy, c1])`` for every row.

    A-Z count as a-z; words are runs of characters other than ASCII white space. Linked rows have similarity 0.75 or more; a row
    without words (a null, empty or blank text) is linked with nothing and is its own component, as is a row without id (its component is
    null if no row with an id has the same set). Repeated rows have equal results and all stay; rows that share an id but not a set are
    compared each on its own. An empty table gives an empty result; columns other than the two named take no part. Ids are integers.

    ``row_keys``: also a hash of the text (``copy``, xxhash64) and one of the set (``c1``), by which rows of one id can be told apart.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).select("doc", F.xxhash64("text").alias("copy"), "text")
    digest = scratch.put("digest", base.mapInArrow(_digest, "doc long, copy long, n long, c1 long, c2 long, bands array<long>, bits array<long>"))
    filled = digest.where("n > 0")
    by_id = filled.where("doc is not null").groupBy("doc").agg(F.count("*").alias("rows"), (F.min("c1") < F.max("c1")).alias("clash"))
    odd = by_id.agg(F.max(F.col("rows") > 1).alias("repeats"), F.max("clash").alias("clash")).first()
    # a document is known by its id, or by its id and text where an id has several sets
    node = F.struct("doc", "copy") if odd["clash"] else F.col("doc")
    node_kind = "struct<doc:bigint,copy:bigint>" if odd["clash"] else "bigint"
    classes = scratch.put("classes", filled.where("doc is not null").groupBy("c1", "c2").agg(F.min(node).alias("rep")))
    leads = digest.where(F.size("bands") > 0).withColumn("node", node).join(classes, ["c1", "c2"]).where(F.col("node") == F.col("rep"))
    leads = scratch.put("leads", leads.select("node", "bands", "bits"))
    keys = leads.select(F.explode("bands").alias("band"), "node")
    hubs = scratch.put("hubs", keys.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top"))
    members = scratch.put("members", keys.join(hubs, "band").where(F.col("node") != F.col("hub")))

    # the sets of all members and hubs, made once; what grows with the documents is never broadcast
    wanted = members.select("node", "hub").unionByName(members.select(F.col("hub").alias("node"), F.lit(None).cast(node_kind).alias("hub")))
    wanted = wanted.groupBy("node").agg(F.collect_set("hub").alias("hubs"), F.max(F.col("hub").isNull()).alias("is_hub"))  # at most a hub for each band
    texts = base.where("doc is not null").select(node.alias("node"), "text")
    texts = texts.dropDuplicates(["node"]) if odd["repeats"] else texts
    sets = scratch.put("sets", texts.join(wanted.hint("merge"), "node").select("node", "text", "hubs", "is_hub").mapInArrow(_sets, f"node {node_kind}, items binary, hubs array<{node_kind}>, is_hub boolean"))
    right = sets.where("is_hub").select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    tried = scratch.put("tried", _compared(sets.select(F.explode("hubs").alias("a"), F.col("node").alias("b"), F.col("items").alias("items_b")).join(right, "a"), node_kind))
    links = tried.where("linked").select("a", "b")
    parts = connected_components(links, scratch)
    # links found among these pairs only join components, so they open no other pairs
    pairs = scratch.put("pairs", _open_pairs(tried, parts, leads.select("node", "bits"), scratch))
    if pairs.take(1):
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
        found = scratch.put("found", _compared(both, node_kind).where("linked").select("a", "b"))
        if found.take(1):
            parts = connected_components(links.unionByName(found), scratch)
    scratch.drop("leads", "hubs", "members", "sets", "tried", "pairs", "open", "prefixes", "found")

    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    named = named.withColumn("component", F.col("component.doc")) if odd["clash"] else named
    columns = ["doc", "copy", "n", "c1", "c2"]
    out = filled.select(columns).join(named, ["c1", "c2"], "left").unionByName(digest.where("n = 0").select(*columns, F.col("doc").alias("component")))
    kept = F.col("doc").eqNullSafe(F.col("component"))
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"), kept.alias("kept"), *["copy", "c1"] * row_keys)


def _open_pairs(tried: DataFrame, parts: DataFrame, maps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of a hub's members that lie in different components, one of them not in its hub's, and may share enough."""
    return _meetings(tried, parts, maps, scratch).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _meetings(tried: DataFrame, parts: DataFrame, maps: DataFrame, scratch: Scratch) -> DataFrame:
    """``_open_pairs``, tried ones too, a row for each shingle at which a pair meets: one of a hub where its first shingles have any in common."""
    of = tried.select(F.col("a").alias("hub"), F.col("b").alias("node"), "n", "shared", "keys")
    of = of.join(parts.select("node", F.col("component").alias("part")), "node", "left")
    of = of.join(parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_part")), "hub", "left")
    of = of.withColumns({"part": F.coalesce("part", "node"), "stray": F.coalesce("part", "node") != F.coalesce("hub_part", "hub")}).drop("hub_part")
    of = scratch.put("open", of.join(of.where("stray").select("hub").distinct(), "hub", "left_semi").join(maps.dropDuplicates(["node"]), "node"))
    bits = [F.get("bits", F.lit(i)).alias(f"bits_{i}") for i in range(LONGS)]
    of = of.withColumn("keys", F.transform("keys", lambda k: F.xxhash64("hub", k))).withColumn("firsts", F.slice("keys", 1, FIRSTS))
    of = of.select("node", "n", "shared", "part", "stray", "firsts", *bits, F.posexplode("keys").alias("place", "key"))
    mixed = of.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    of = scratch.put("prefixes", of.join(mixed, "key", "left_semi"))
    # a larger set meets a smaller one, whose share of what both have is larger, by fewer of its first shingles
    small = of.where((100 + PERCENT) * F.col("place") <= (100 - PERCENT) * F.col("n"))
    small = small.withColumnsRenamed({c: f"other_{c}" for c in of.columns if c != "key"})
    met = of.where("stray").join(small, "key").unionByName(of.where("not stray").join(small.where("other_stray"), "key"))
    sized = (F.col("n") >= F.col("other_n")) & (PERCENT * F.col("n") <= 100 * F.col("other_n"))
    near = F.least("shared", "other_shared") + F.least(F.col("n") - F.col("shared"), F.col("other_n") - F.col("other_shared"))
    mapped = sum(F.bit_count(F.col(f"bits_{i}").bitwiseAND(F.col(f"other_bits_{i}"))) for i in range(LONGS))
    lost = F.least(*[F.col(f"{of_}n") - sum(F.bit_count(f"{of_}bits_{i}") for i in range(LONGS)) for of_ in ("", "other_")])
    after = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))  # all they share, at their first common shingle
    enough = (100 + PERCENT) * F.least(near, after, mapped + lost) >= PERCENT * (F.col("n") + F.col("other_n"))
    # all members of a hub have its shingles in one order and all bounds are widest at the first that two have in common, so a later one adds
    # no pair
    first = F.get(F.array_intersect("firsts", "other_firsts"), F.lit(0))
    met = met.where((F.col("part") != F.col("other_part")) & sized & enough & F.coalesce(first == F.col("key"), F.lit(True)))
    return met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))
