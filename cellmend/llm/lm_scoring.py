"""Masked pseudo-likelihood of documents by a bidirectional window network (operator 9).

The network predicts each word from the words on both sides of it, the word itself hidden: the window's word vectors (one table for
each place) add up to a hidden layer, whose softmax gives the word's class; within the class a binary tree gives the word, each node
a logistic turn on the same hidden layer. A document's score is the sum of its words' conditional log-probabilities.

The counts cover every word of every document. The most frequent words form the vocabulary, cut by frequency into classes of equal
mass; all other words are one more class, whose tree is that of the words' hashes: each turn is one of a hash's first bits, and the words of
one end share it by their counts (one more count is left there for words that the training corpus lacks). So every word is predicted from
both sides. The counts of the next most frequent words travel with the model, those of the rest are joined by the word.

The network is trained on every position of every document, once an epoch. Documents are cut into pieces (with the words around them), which
are dealt by a hash of id, text and place to shards, whose number follows from the words of the corpus, and to an epoch's rounds; the copies
of a piece (of rows equal in id and text) travel as their number, so many at most together. A shard's positions of a round are trained by stochastic gradient descent in the order of their hashes, all shards at once; after a round each vector of
the next model is the mean over the shards that used it, weighted by their uses. So the scores depend on the documents, not on how their files
are cut or rows repartitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import Words, mix64, signed, slices, text_of
from cellmend.sources.scratch import Scratch, stored

SLICE = 1_000_000
#: Positions in one piece of a document.
PIECE = 1024
#: Copies of a piece that are dealt to one shard and round.
COPIES = 64
#: Parameter rows that are averaged together.
CHUNK = 128
#: Leading bits of a word's hash by which its place among sorted hashes is looked up.
PREFIX = 18


@dataclass(frozen=True)
class LmParams:
    """``vocabulary``: words with vectors of their own; ``counted``: words, at most, whose counts travel with the model; ``shard``: positions of
    one shard, about, which are averaged ``rounds`` times an epoch; ``share``: an epoch trains on one position in so many (1: on all);
    ``codes``: bits of the codes of words outside the vocabulary."""

    vocabulary: int = 8192
    counted: int = 1 << 18
    classes: int = 64
    dim: int = 16
    places: tuple[int, ...] = (-2, -1, 1, 2)
    epochs: int = 1
    share: int = 1
    shard: int = 1 << 21
    rounds: int = 4
    codes: int = 4
    batch: int = 512
    rate: float = 0.3
    seed: int = 29


@dataclass(frozen=True)
class LmModel:
    """``words``: sorted hashes of the counted words; word i has the id ``id_of[i]``: its place in the vocabulary, or for words outside
    it the vocabulary's size; places outside the text have the id after. ``log_n``: the log of each counted word's count.

    ``log_share``: of each id in its class by the counts. A code is an id of the vocabulary, or for words outside it what ``code_of`` says;
    code i's turns are ``path`` and ``side`` (1 or -1) from ``path_first[i]``. ``end_share``: of a word with a count of 1 among those outside
    the vocabulary whose hashes begin alike. ``counts(word, n)`` is on the driver only.
    """

    words: np.ndarray
    id_of: np.ndarray
    log_n: np.ndarray
    class_of: np.ndarray
    log_share: np.ndarray
    tables: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    nodes: np.ndarray
    turn: np.ndarray
    path_first: np.ndarray
    path: np.ndarray
    side: np.ndarray
    end_share: np.ndarray
    places: tuple[int, ...]
    counts: DataFrame | None = None

    @property
    def other(self) -> int:
        """The id of words outside the vocabulary."""
        return len(self.class_of) - 1

    def indexed(self) -> LmModel:
        """With ``starts``: where the hashes of each prefix begin."""
        prefixes = np.arange((1 << PREFIX) + 1, dtype=np.uint64)
        starts = np.searchsorted(self.words >> np.uint64(64 - PREFIX), prefixes)
        object.__setattr__(self, "_starts", (starts, int(np.diff(starts).max(initial=0))))
        return self

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place among the counted words, or -1."""
        starts, longest = getattr(self, "_starts", None) or self.indexed()._starts
        at = starts[(hashes >> np.uint64(64 - PREFIX)).astype(np.int64)]
        padded = np.append(self.words, np.uint64((1 << 64) - 1))
        for _ in range(longest - 1):  # words of one prefix are few
            at += padded[at] < hashes
        at = np.minimum(at, len(self.words))
        return np.where((at < len(self.words)) & (padded[at] == hashes), at, -1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return np.append(self.id_of, self.other)[self.find(hashes)]

    @property
    def kind(self) -> type:
        """Of ids and codes."""
        return np.uint16 if len(self.class_of) + len(self.end_share) < 65_000 else np.int32

    def end_of(self, hashes: np.ndarray) -> np.ndarray:
        """Where the way to each word outside the vocabulary ends."""
        return (hashes >> np.uint64(65 - len(self.end_share).bit_length())).astype(np.int64) if len(self.end_share) > 1 else np.zeros(len(hashes), np.int64)

    def code_of(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.other, self.other + 1 + self.end_of(hashes), ids)

    def seen(self, ids: np.ndarray, at: np.ndarray, first: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """The ids at each place around the positions ``at`` (of documents ``doc``)."""
        pad, out = self.other + 1, []
        for place in self.places:
            other = at + place
            inside = (other >= first[doc]) & (other < first[doc + 1])
            out.append(np.where(inside, ids[np.clip(other, 0, max(len(ids) - 1, 0))], pad))
        return out

    def hidden(self, seen: list[np.ndarray]) -> np.ndarray:
        """The hidden layer of what is seen."""
        h = self.tables[0].take(seen[0], axis=0)
        for table, found in zip(self.tables[1:], seen[1:]):
            h += table.take(found, axis=0)
        return h

    def class_scores(self, h: np.ndarray) -> np.ndarray:
        """A row for each class."""
        scores = self.out.T @ h.T
        scores += self.bias[:, None]
        return scores

    def turns(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, node and side of each turn on the way to the words."""
        start = self.path_first.take(codes)
        length = self.path_first.take(codes + 1) - start
        row = np.repeat(np.arange(len(codes)), length)
        at = np.arange(len(row)) + (start - np.cumsum(length) + length).take(row)
        return row, self.path.take(at), self.side.take(at)

    def log_probabilities(self, words: Words) -> np.ndarray:
        """Conditional log-probability of each word; one that is not counted as if its count were 1."""
        found = self.find(words.hashes)
        ids = np.append(self.id_of, self.other)[found]
        codes, logs = self.code_of(words.hashes, ids), np.empty(len(ids), np.float64)
        for start in range(0, len(ids), 2048):
            at = np.arange(start, min(start + 2048, len(ids)))
            h = self.hidden(self.seen(ids, at, words.first, words.doc[at]))
            scores = self.class_scores(h)
            own = scores[self.class_of.take(ids[at]), np.arange(len(at))]
            top = scores.max(axis=0)
            np.exp(np.subtract(scores, top, out=scores), out=scores)
            row, node, side = self.turns(codes[at])
            z = side * (np.einsum("ij,ij->i", h.take(row, axis=0), self.nodes.take(node, axis=0)) + self.turn.take(node))
            within = np.bincount(row, np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z))), minlength=len(at))
            logs[at] = own - top - np.log(scores.sum(axis=0)) + within
        outside = ids == self.other
        logs[outside] += self.end_share[codes[outside] - self.other - 1] + np.append(self.log_n, 0.0)[found[outside]]
        return logs

    def packed(self) -> np.ndarray:
        """All that is trained, a row for each vector and its bias."""
        tables = self.tables.reshape(-1, self.tables.shape[2])
        zero = np.zeros(len(tables), np.float32)
        return np.concatenate([np.c_[tables, zero], np.c_[self.out.T, self.bias], np.c_[self.nodes, self.turn]]).astype(np.float32)

    def unpacked(self, rows: np.ndarray) -> LmModel:
        n = self.tables.shape[0] * self.tables.shape[1]
        tables, out, nodes = (np.ascontiguousarray(x) for x in np.split(rows, [n, n + len(self.bias)]))
        parts = {"tables": tables[:, :-1].reshape(self.tables.shape), "out": out[:, :-1].T, "bias": out[:, -1], "nodes": nodes[:, :-1], "turn": nodes[:, -1]}
        return replace(self, **{k: np.array(v, np.float32, order="C") for k, v in parts.items()})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the task's words, merged while there is room."""
    words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([signed(words), pa.array(counts)], names=["word", "n"])

    for batch in slices(batches, limit=3_000_000):
        new, n = np.unique(Words(batch.column(0)).hashes, return_counts=True)
        words, where = np.unique(np.concatenate([words, new]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), minlength=len(words)).astype(np.int64)
        if len(words) > 1_000_000:
            yield rows()
            words, counts = words[:0], counts[:0]
    yield rows()


def _tree(n: np.ndarray, cls: np.ndarray) -> tuple[list[list[int]], list[list[int]], list[float]]:
    """Nodes and sides on the way to each word, and each node's log odds: every class (a run of ``cls``) cut into halves of like mass."""
    mass = np.concatenate([[0], np.cumsum(n)])
    edge = np.flatnonzero(np.diff(cls, prepend=-1, append=-1)) if len(cls) else np.zeros(1, int)
    path, side, odds = [[] for _ in n], [[] for _ in n], []
    todo = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = int(np.clip(np.searchsorted(mass, (mass[low] + mass[high]) / 2), low + 1, high - 1))
        for i in range(low, high):
            path[i].append(len(odds))
            side[i].append(1 if i < middle else -1)
        odds.append(float(np.log((mass[middle] - mass[low]) / (mass[high] - mass[middle]))))
        todo += [(low, middle), (middle, high)]
    return path, side, odds


def _hash_tree(ends: np.ndarray, at: int) -> tuple[list[list[int]], list[list[int]], list[float]]:
    """As ``_tree``, to each end by the bits of its number; nodes are numbered from ``at`` on."""
    bits, odds, mass = len(ends).bit_length() - 1, [], [ends.astype(float)]
    while len(mass[0]) > 1:
        mass.insert(0, mass[0].reshape(-1, 2).sum(axis=1))
    for level in mass[1:]:
        odds += np.log((level[0::2] + 1) / (level[1::2] + 1)).tolist()
    ways = [[at + (1 << k) - 1 + (e >> (bits - k)) for k in range(bits)] for e in range(len(ends))]
    return ways, [[1 - 2 * (e >> (bits - 1 - k) & 1) for k in range(bits)] for e in range(len(ends))], odds


def least_count(counts: DataFrame, most: int) -> int:
    """The count from which on there are at most so many words, to within a sixteenth of a doubling; from a histogram of bounded size."""
    fine = F.floor(F.log2("n") * 16)
    bins = counts.groupBy(fine.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()  # 1024 at most
    room, least = most, 1 << 62
    for b in bins:
        room -= b["words"]
        if room < 0:
            break
        least = b["least"]
    return least


def train_lm(docs: DataFrame, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text") -> LmModel:
    """Count all words, then fit the network. Null texts are empty; a corpus without words, or an empty table, gives a model of one class."""
    p = params
    base = docs.select(text_of(text_col).alias("text"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("row"))
    counts = stored(base.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = counts.where(F.col("n") >= least_count(counts, max(p.counted, p.vocabulary))).toArrow()  # at most the counted words
    every, n_every = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    ranked = np.lexsort((every, -n_every))
    every, n_every = every[ranked], n_every[ranked]
    n = n_every[: p.vocabulary]
    rest = total - int(n.sum())
    mass = np.cumsum(n) - n / 2
    cls = np.minimum((mass * (p.classes - 1) / max(int(n.sum()), 1)).astype(int), p.classes - 2)
    cls = np.unique(cls, return_inverse=True)[1] if len(cls) else cls
    used = int(cls.max()) + 1 if len(cls) else 0
    in_class = np.bincount(cls, n, minlength=used)
    log_share = np.append(np.log(n) - np.log(in_class[cls]), 0.0)
    class_of = np.append(cls, used).astype(np.int64)
    prior = np.log(np.append(in_class, max(rest, 1)) / max(total, 1)).astype(np.float32)
    path, side, odds = _tree(n, cls)
    ends = np.zeros(1 << p.codes, np.int64)  # counts of the words outside the vocabulary by the first bits of their hashes
    prefix = F.shiftrightunsigned("word", 64 - p.codes) if p.codes else F.lit(0)
    for r in counts.groupBy(prefix.alias("end")).agg(F.sum("n").alias("n")).collect():  # a row for each end
        ends[r["end"]] = r["n"]
    if p.codes:
        np.subtract.at(ends, (every[: p.vocabulary] >> np.uint64(64 - p.codes)).astype(np.int64), n)
    else:
        ends[0] -= int(n.sum())
    ways, sides_of, more = _hash_tree(ends, len(odds))
    path, side, odds = [*path, [], *ways], [*side, [], *sides_of], [*odds, *more]
    first = np.concatenate([[0], np.cumsum([*map(len, path)])]).astype(np.int64)
    flat, sides = (np.array([x for way in ways for x in way], kind) for ways, kind in ((path, np.int64), (side, np.float32)))
    rng = np.random.default_rng(p.seed)
    tables = (rng.standard_normal((len(p.places), len(n) + 2, p.dim)) * 0.1).astype(np.float32)
    out = (np.random.default_rng(p.seed).standard_normal((p.dim, used + 1)) * 0.1).astype(np.float32)
    nodes, turn = np.zeros((len(odds), p.dim), np.float32), np.array(odds, np.float32)
    order = np.argsort(every)
    model = LmModel(every[order], np.minimum(order, len(n)), np.log(n_every)[order], class_of, log_share, tables, out, prior, nodes, turn, first, flat, sides, -np.log(ends + 1.0), p.places)
    return replace(fit(model, base, p, total), counts=counts.where("n > 1"))


def _cut(shared, p: LmParams):
    """(spot, lead, own, codes) of each piece of a document: the codes of its ``own`` positions, with ``lead`` before them and some
    after them that are seen from there; ``spot`` is a hash of id, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reach = shared.value, max(map(abs, p.places), default=0)
        for batch in slices(batches, limit=SLICE):
            w, row = Words(batch.column(0)), batch.column(1).to_numpy().view(np.uint64)
            if not len(w):
                continue
            codes = model.code_of(w.hashes, model.ids(w.hashes)).astype(model.kind)
            pieces = -(-np.diff(w.first) // PIECE)
            doc = np.repeat(np.arange(len(pieces)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = w.first[doc] + number * PIECE
            end = np.minimum(begin + PIECE, w.first[doc + 1])
            low, high = np.maximum(begin - reach, w.first[doc]), np.minimum(end + reach, w.first[doc + 1])
            ends = np.concatenate([[0], np.cumsum(high - low)])
            dealt = codes[np.arange(ends[-1]) + np.repeat(low - ends[:-1], high - low)]
            spot = mix64(row[doc] + mix64(number.astype(np.uint64) + np.uint64(p.seed)))
            made = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((ends * codes.itemsize).astype(np.int32)), pa.py_buffer(dealt)])
            yield pa.RecordBatch.from_arrays([signed(spot), pa.array(begin - low), pa.array(end - begin), made], names=["spot", "lead", "own", "codes"])

    return run


def deal(pieces: DataFrame, rounds: int, shards: int) -> DataFrame:
    """Equal pieces as one with ``copies``, in parts of so many at most, with each part's round and shard."""
    counted = pieces.groupBy("spot", "lead", "own", "codes").agg(F.count("*").alias("all"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"int((all - 1) div {COPIES})"))).alias("part"))
    place = F.xxhash64("spot", "part")
    copies = F.least(F.lit(COPIES), F.col("all") - F.col("part") * COPIES)
    return parts.select(F.pmod(F.xxhash64(place), F.lit(rounds)).alias("round"), F.pmod(place, F.lit(shards)).alias("shard"), "spot", F.col("part").cast("long").alias("part"), copies.alias("copies"), "lead", "own", "codes")


def positions(model: LmModel, p: LmParams, epoch: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions of dealt pieces that train in the epoch: keys (their order), and rows of code, id and the ids seen around."""
    spot, part, copies, lead, own = (batch.column(c).to_numpy() for c in ("spot", "part", "copies", "lead", "own"))
    parts = [np.frombuffer(x.as_buffer(), model.kind) for x in batch.column("codes")]
    first = np.concatenate([[0], np.cumsum([*map(len, parts)])]).astype(np.int64)
    codes = np.concatenate(parts).astype(np.int64)
    source = np.repeat(np.arange(len(own)), copies)  # of each copy
    copy = np.arange(len(source)) - np.repeat(np.cumsum(copies) - copies, copies) + COPIES * part[source]
    salt, size = mix64(spot.view(np.uint64)[source] ^ mix64(copy.astype(np.uint64))), own[source]
    which = np.repeat(np.arange(len(source)), size)
    place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    key = mix64(salt[which] + mix64(place.astype(np.uint64))) ^ mix64(np.full(1, epoch, np.uint64))
    piece = source[which]
    at = first[piece] + lead[piece] + place
    if p.share > 1:
        drawn = np.flatnonzero(mix64(key) % np.uint64(p.share) == 0)
        key, at, piece = key[drawn], at[drawn], piece[drawn]
    ids = np.minimum(codes, model.other)
    return mix64(key), np.stack([codes[at], ids[at], *model.seen(ids, at, first, piece)], axis=1).astype(model.kind)


def _draw(shared, p: LmParams, shards: int):
    """(epoch, spot, keys, rows) of the positions that train, piece by piece: what ``fit`` makes of pieces that are all different, undealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(shared, p)(batches):
            one = pa.array(np.ones(batch.num_rows, np.int64))
            batch = batch.append_column("copies", one).append_column("part", pa.compute.subtract(one, 1))
            for epoch in range(p.epochs):
                for i in range(batch.num_rows):
                    made = [pa.array([x.tobytes()], pa.binary()) for x in positions(shared.value, p, epoch, batch.slice(i, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([epoch]), batch.column("spot").slice(i, 1), *made], names=["epoch", "spot", "keys", "rows"])

    return run


def fit(model: LmModel, base: DataFrame, p: LmParams, total: int) -> LmModel:
    """Stochastic gradient descent over positions of all texts, by shards; a mean over the shards ends each round."""
    sc, scratch = base.sparkSession.sparkContext, Scratch(base.sparkSession)
    shards = max(1, -(-total // (p.share * p.shard)))
    now = sc.broadcast(model)  # bounded by the parameters
    dealt = deal(base.mapInArrow(_cut(now, p), "spot long, lead long, own long, codes binary"), p.rounds, shards)
    # a shard's pieces lie in one file, those of a round one after the other
    dealt = scratch.put("dealt", dealt.repartition(shards, "shard").sortWithinPartitions("round", "shard"))
    steps = [(e, r) for e in range(p.epochs) for r in range(p.rounds)]
    for step, (epoch, turn) in enumerate(steps):
        rate = np.float32(p.rate * (len(steps) - step) / len(steps))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def trained(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                made = [positions(now.value, p, epoch, x) for x in pieces]
                order = np.argsort(np.concatenate([key for key, _ in made]), kind="stable")
                m, uses = fit_shard(now.value, np.concatenate([rows for _, rows in made])[order], p, rate)
                values = m.packed()
                for chunk in range(0, len(values), CHUNK):
                    at = np.flatnonzero(uses[chunk : chunk + CHUNK]) + chunk
                    if len(at):
                        made = [at.astype(np.int32), uses[at], values[at]]
                        yield pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([x.tobytes()], pa.binary()) for x in made]], names=["chunk", "at", "uses", "rows"])

            last, pieces = None, []
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                heads = np.flatnonzero(np.diff(shard, prepend=-1))
                for i, j in zip(heads, np.append(heads[1:], len(shard))):
                    if shard[i] != last and pieces:
                        yield from trained(pieces)
                        pieces = []
                    last = shard[i]
                    pieces.append(batch.slice(i, j - i))
            if pieces:
                yield from trained(pieces)

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}  # at most the model
            for batch in batches:
                for chunk, at, uses, values in zip(*(c.to_pylist() for c in batch.columns)):
                    at, uses = np.frombuffer(at, np.int32) - chunk, np.frombuffer(uses, np.float64)
                    s = sums.setdefault(chunk, np.zeros((CHUNK, p.dim + 2)))
                    s[at, 0] += uses
                    s[at, 1:] += uses[:, None] * np.frombuffer(values, np.float32).reshape(len(at), -1)
            for chunk, s in sums.items():
                at = np.flatnonzero(s[:, 0])
                values = (s[at, 1:] / s[at, :1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in ((at + chunk).astype(np.int32), values)], names=["at", "rows"])

        made = dealt.where(F.col("round") == turn).mapInArrow(part, "chunk long, at binary, uses binary, rows binary")
        values = model.packed()
        for r in made.repartition("chunk").mapInArrow(mean, "at binary, rows binary").collect():  # the model
            at = np.frombuffer(r["at"], np.int32)
            values[at] = np.frombuffer(r["rows"], np.float32).reshape(len(at), -1)
        model = model.unpacked(values)
        now.destroy()
        now = sc.broadcast(model)
    now.destroy()
    scratch.clear()
    return model


def calm(rows: np.ndarray, n: int) -> np.ndarray:
    """What a batch's steps count for: an eighth, or less so that those on one row come to one whole step at most."""
    return (1 / np.maximum(np.bincount(rows, minlength=n).take(rows), 8)).astype(np.float32)


@cache
def cells(n: int, width: int) -> np.ndarray:
    """Where the cells of each row of a table lie."""
    return np.arange(n * width).reshape(n, width)


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the table's row of that number, which may come again."""
    np.add.at(table.reshape(-1), cells(*table.shape).take(at, axis=0).reshape(-1), rows.reshape(-1))


def fit_shard(start: LmModel, rows: np.ndarray, p: LmParams, rate: np.float32) -> tuple[LmModel, np.ndarray]:
    """The model after the rows (code, id, ids seen), in batches in their order, and how often each packed row was used."""
    model, n = start.unpacked(start.packed()), start.tables.shape[1]
    for k in range(0, len(rows), p.batch):
        codes, ids, *seen = np.ascontiguousarray(rows[k : k + p.batch].T).astype(np.int64)
        descend(model, codes, ids, seen, rate)
    uses = [np.bincount(found, minlength=n) for found in rows.T[2:]]
    on_path = np.repeat(np.bincount(rows[:, 0], minlength=len(model.path_first) - 1), np.diff(model.path_first))
    return model, np.concatenate([*uses, np.full(len(model.bias), len(rows)), np.bincount(model.path, on_path, minlength=len(model.nodes))]).astype(float)


def descend(model: LmModel, codes: np.ndarray, ids: np.ndarray, seen: list[np.ndarray], rate: np.float32) -> None:
    """One step on positions of these codes and ids, around which these ids are seen."""
    tables, nodes, n = model.tables, model.nodes, len(ids)
    h = model.hidden(seen)
    wrong = model.class_scores(h)
    wrong -= wrong.max(axis=0)
    np.exp(wrong, out=wrong)
    wrong /= wrong.sum(axis=0)
    wrong[model.class_of.take(ids), np.arange(n)] -= 1
    back = wrong.T @ model.out.T
    model.out[:] -= h.T @ wrong.T * (rate / n)
    model.bias[:] -= wrong.sum(axis=1) * (rate / n)
    row, node, side = model.turns(codes)
    if len(row):
        near, own = h.take(row, axis=0), nodes.take(node, axis=0)
        z = np.einsum("ij,ij->i", near, own)
        z += model.turn.take(node)
        off = -side / (1 + np.exp(np.clip(side * z, -30, 30)))
        own *= off[:, None]
        add_rows(back, row, own)
        off *= -rate * calm(node, len(nodes))
        near *= off[:, None]
        add_rows(nodes, node, near)
        model.turn[:] += np.bincount(node, off, minlength=len(nodes))
    back *= -rate
    for table, found in zip(tables, seen):
        add_rows(table, found, back * calm(found, len(table))[:, None])


def score_lm(docs: DataFrame, model: LmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, log_prob, mean_log_prob)`` of every whole text.

    Texts without words (null, empty or blank) have zeros; repeated rows score alike, however the table is cut; an empty table gives an empty result; columns other
    than the two named take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, counts=None))  # bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, done = shared.value, TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=SLICE):
            words = Words(batch.column(1))
            sums = np.concatenate([[0.0], np.cumsum(m.log_probabilities(words))])
            n = np.diff(words.first)
            total = sums[words.first[1:]] - sums[words.first[:-1]]
            other = m.find(words.hashes) < 0
            ends = np.concatenate([[0], np.cumsum(other)])[words.first].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), signed(words.hashes[other]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) + done), batch.column(0), pa.array(n), pa.array(total), rare], names=["row", "id", "n_tokens", "total", "rare"])
            done += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = Scratch(docs.sparkSession).put("scored", docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, n_tokens long, total double, rare array<long>"))
    shares = scored.select("row", F.explode("rare").alias("word")).join(model.counts, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    log_prob = F.col("total") + F.coalesce(F.col("more"), F.lit(0.0))
    return scored.join(shares, "row", "left").select(F.col("id").alias(id_col), "n_tokens", log_prob.alias("log_prob"), (log_prob / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))
