"""Substring deduplication by recompression (operator 5).

Rounds of run compression and pair compression rename a text's words: a run of one symbol becomes a new symbol, then symbols
are split into two classes and a symbol of the first class followed by one of the second becomes a new one. A symbol's name is
a hash of what it stands for, so all tasks agree on names without exchanging them, and since each decision depends on a few
neighbours, equal substrings have equal symbols but for some at their ends.

Every window of words takes the highest symbol whose naming it determines as its anchor (a single word where there is none), so
equal windows have equal anchors at equal places. Consecutive windows of one anchor form an occurrence: a *name* (the anchor and
the words around it that all its windows hold) and a *group* (all words of its windows). Spark then

1. gathers occurrences by name: an occurrence whose group came earlier repeats as a whole; names that occur only once are done;
2. gathers the windows of what is left (the ends of repeats) by their words, compared as 128-bit hashes;
3. removes each word that a repeated window covers.

A task sends one occurrence for a name (and one window for its words) from each slice of its input and settles the others of the
slice itself, so a passage that a third of all documents hold takes no more room in one partition than there are slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import Words, exploded, joint_runs, mix64, runs, signed, slices, text_of
from cellmend.sources.scratch import stored

WINDOW = 20
#: Rounds of run and pair compression whose symbols serve as anchors.
LEVELS = 3
#: Text bytes of a slice.
SLICE = 1_500_000
_ODD = np.random.default_rng(205).integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NULL_ID = -(1 << 63)
#: States of an occurrence or window: the slice's first of its name; the same, of a name that has other groups; to be compared by
#: windows in any case; repeated in any case.
FIRST, SHARED, COMPARE, REPEATED = range(4)


def anchor_keys(words: np.ndarray, doc: np.ndarray, before: int, after: int) -> np.ndarray:
    """For each word the rank (smaller is better) of the best symbol that starts there and needs at most the words from ``before``
    ahead of it to ``after`` behind it for its naming."""
    n = len(words)
    key = (mix64(words) >> np.uint64(2)) | np.uint64(3 << 62)
    if n == 0:
        return key
    symbol, start, lo, hi = words, np.arange(n), np.arange(n), np.arange(n)
    for level in range(LEVELS):
        # runs; the words lo to hi show that the neighbours differ
        own = doc[start]
        new_run = np.ones(len(symbol), bool)
        new_run[1:] = (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new_run)
        tail = np.append(head[1:], len(symbol)) - 1
        length = (tail - head + 1).astype(np.uint64)
        run = np.where(length > 1, mix64(symbol[head] + length * _ODD[0]), symbol[head])
        stop = np.append(start[1:], n)  # word after each symbol
        first, last = start[head], stop[tail] - 1
        low, high = np.minimum(lo[head], first - 1), np.maximum(hi[tail], last + 1)
        left, right = np.maximum(head - 1, 0), np.minimum(tail + 1, len(symbol) - 1)
        low = np.where(words[np.maximum(first - 1, 0)] == words[stop[head] - 1], np.minimum(low, lo[left]), low)
        high = np.where(words[np.minimum(last + 1, n - 1)] == words[first], np.maximum(high, hi[right]), high)
        symbol, start, lo, hi, own = run, first, low, high, own[head]
        # pairs
        second = (mix64(symbol ^ _ODD[1] ^ np.uint64(level)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(symbol), bool)
        joins[:-1] = ~second[:-1] & second[1:] & (own[1:] == own[:-1])
        joined = np.zeros(len(symbol), bool)
        joined[1:] = joins[:-1]
        behind, ahead = np.minimum(np.arange(len(symbol)) + 1, len(symbol) - 1), np.maximum(np.arange(len(symbol)) - 1, 0)
        alone = ~joins & ~joined
        low = np.where(alone & second, np.minimum(lo, lo[ahead]), lo)
        high = np.where(joins | (alone & ~second), np.maximum(hi, hi[behind]), hi)
        low = np.where(joins, np.minimum(low, lo[behind]), low)
        symbol = np.where(joins, mix64(symbol * _ODD[2] + symbol[behind] * _ODD[3]), symbol)
        fit = np.flatnonzero(joins & (low >= start - before) & (high <= start + after))
        key[start[fit]] = (mix64(symbol[fit]) >> np.uint64(2)) | np.uint64((LEVELS - 1 - level) << 62)
        keep = ~joined
        symbol, start, lo, hi = symbol[keep], start[keep], low[keep], high[keep]
    return key


def least(key: np.ndarray, width: int) -> np.ndarray:
    """Index of the (leftmost) least of each ``width`` consecutive keys."""
    at, have = np.arange(len(key)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at, have = np.where(key[b] < key[a], b, a), have + step
    return at


def occurrences(words: Words, window: int) -> dict[str, np.ndarray]:
    """Name, group, row, and first and last window (as words of the row) of each occurrence."""
    span = max(1, window * 3 // 5)
    before = span // 4
    room = window - span + 1
    counts = np.diff(words.first)
    begin = np.repeat(words.first[:-1], counts)
    valid = np.arange(len(words)) + window <= begin + np.repeat(counts, counts)
    at = np.flatnonzero(valid)
    if not len(at):
        empty = np.empty(0, np.int64)
        return {"name": empty.view(np.uint64), "group": empty.view(np.uint64), "row": empty, "a": empty, "b": empty}
    key = anchor_keys(words.hashes, words.doc, before, span - 1 - before)
    anchor = least(key, room)[at + before]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    a, b, mark = at[head], at[np.append(head[1:], len(at)) - 1], anchor[head]
    name = mix64(runs(words.hashes, span, 203)[mark - before] ^ key[mark])
    whole = joint_runs(words.hashes, words.checks, window, 204)  # an occurrence has at most ``room`` windows: its first and last one hold all its words
    group = mix64(mix64(whole[a] + (b - a).astype(np.uint64)) * _ODD[2] + whole[b] + (mark - a).astype(np.uint64) * _ODD[3])
    row = words.doc[a]
    return {"name": name, "group": group, "row": row, "a": a - words.first[row], "b": b - words.first[row]}


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, sub, text): the id as a long (null first) and, only where rows share an id but not a text, a hash of the text."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), text_of(text_col).alias("text"))
    hashed = base.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    clash = bool(hashed.where("low <> high").take(1))
    return base.select("doc", (F.xxhash64("text") if clash else F.lit(0).cast("long")).alias("sub"), "text")


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _find_occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            found = occurrences(Words(batch.column(2)), window)
            doc, sub = (batch.column(i).to_numpy()[found["row"]] for i in (0, 1))
            order = np.lexsort((found["a"], sub, doc, found["group"], found["name"]))
            name, group, a, b = (found[k][order] for k in ("name", "group", "a", "b"))
            same_name, same_group = _same(name), _same(name, group)
            shared = np.zeros(len(name), bool)  # the first of a name that has other groups
            owner = np.maximum.accumulate(np.where(same_name, 0, np.arange(len(name)))) if len(name) else np.arange(0)
            shared[owner[same_name & ~same_group]] = True
            state = np.where(same_group, REPEATED, np.where(same_name, COMPARE, np.where(shared, SHARED, FIRST)))
            yield pa.RecordBatch.from_arrays([signed(name), signed(group), pa.array(doc[order]), pa.array(sub[order]), pa.array((a << 8) | ((b - a) << 2) | state)], names=["name", "grp", "doc", "sub", "pack"])

    return run


def _compare_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name, group and place: which occurrences repeat, and which are to be compared by windows."""

    def emit(rows: np.ndarray, fine: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[4] >> 8), pa.array((rows[4] >> 2) & 63), pa.array(fine)], names=["doc", "sub", "a", "more", "fine"])

    last = np.empty((5, 0), np.int64)  # the last row so far, undecided
    seen = False  # whether the row before it has its name
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(5)])
        state = rows[4] & 3
        direct = state >= COMPARE
        if direct.any():
            yield emit(rows[:, direct], state[direct] == COMPARE)
        rows = np.concatenate([last, rows[:, ~direct]], axis=1)
        n = rows.shape[1]
        if n == 0:
            continue
        same_name, same_group = _same(rows[0]), _same(rows[0], rows[1])
        if last.shape[1]:
            same_name[0] = seen
            same_group[0] = held_group
        followed = np.append(same_name[1:], False)
        again = same_name | followed | ((rows[4] & 3) == SHARED)
        out = again[:-1]
        if out.any():
            yield emit(rows[:, :-1][:, out], ~same_group[:-1][out])
        last, seen, held_group = rows[:, -1:], bool(same_name[-1]), bool(same_group[-1])
    if last.shape[1] and (seen or int(last[4, 0]) & 3 == SHARED):
        yield emit(last, np.array([not held_group]))


def _find_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="text", limit=SLICE):
            words = Words(batch.column(2))
            packed, row = exploded(batch.column(3))
            count = (packed & 63) + 1
            row = np.repeat(row, count)
            a = np.repeat(packed >> 8, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            at = words.first[row] + a
            w1, w2 = (runs(own, window, key)[at] for own, key in ((words.hashes, 205), (words.checks, 206)))
            doc, sub = (batch.column(i).to_numpy()[row] for i in (0, 1))
            order = np.lexsort((a, sub, doc, w2, w1))
            w1, w2 = w1[order], w2[order]
            state = np.where(_same(w1, w2), REPEATED, FIRST)
            yield pa.RecordBatch.from_arrays([signed(w1), signed(w2), pa.array(doc[order]), pa.array(sub[order]), pa.array((a[order] << 8) | state)], names=["name", "grp", "doc", "sub", "pack"])

    return run


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by their words and place: those that came earlier."""
    last = np.empty((5, 0), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(5)])
        direct = (rows[4] & 3) == REPEATED
        rest = np.concatenate([last, rows[:, ~direct]], axis=1)
        again = _same(rest[0], rest[1])
        rows = np.concatenate([rows[:, direct], rest[:, again]], axis=1)
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[4] >> 8), pa.array(np.zeros(rows.shape[1], np.int64))], names=["doc", "sub", "a", "more"])
        last = rest[:, -1:]


def _dealt(rows: DataFrame) -> DataFrame:
    """By name where rows are to meet, evenly where they are settled; sorted."""
    by = F.when((F.col("pack").bitwiseAND(3)) < COMPARE, F.col("name")).otherwise(F.xxhash64("doc", "pack"))
    return rows.repartition(by).sortWithinPartitions("name", "grp", "doc", "sub", "pack")


def repeated_windows(keyed_docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc, sub, a, more)``: the windows from word a to word a + more came earlier, of all rows of ``keyed``'s result."""
    rows = "name long, grp long, doc long, sub long, pack long"
    found = stored(_dealt(keyed_docs.mapInArrow(_find_occurrences(window), rows)).mapInArrow(_compare_occurrences, "doc long, sub long, a long, more long, fine boolean"))
    open_ = found.where("fine").groupBy("doc", "sub").agg(F.collect_list(F.shiftleft("a", 8) + F.col("more")).alias("packed"))  # at most a document's windows
    texts = keyed_docs.join(open_, ["doc", "sub"]).select("doc", "sub", "text", "packed")
    windows = _dealt(texts.mapInArrow(_find_windows(window), rows)).mapInArrow(_compare_windows, "doc long, sub long, a long, more long")
    return found.where("not fine").drop("fine").unionByName(windows)


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="text", limit=SLICE):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            marks = batch.column(3)
            out = []
            for i, text in enumerate(texts):
                words, n, removed = text.split(), 0, 0
                n = len(words)
                if marks[i].is_valid:
                    packed = marks[i].values.to_numpy()
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, packed >> 8, 1)
                    np.add.at(edge, (packed >> 8) + (packed & 63) + window, -1)
                    kept = np.cumsum(edge[:n]) == 0
                    removed = n - int(kept.sum())
                    words = [words[k] for k in np.flatnonzero(kept)]
                out.append((n, removed, b" ".join(words)))
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)``: every text without the words of windows that came earlier, joined by one space.

    Windows are judged on the input; earlier means a smaller id (null is the smallest), or the same id and an earlier start. Texts of
    fewer than ``window`` words stay whole; null and empty texts have no words. Repeated rows (same id and text) count as one row and
    each has its result; rows that share an id only are ordered by a hash of their texts. Ids are integers; ``window`` is 2 to 40.
    """
    base = keyed(docs, id_col, text_col)
    again = base.groupBy("doc", "sub").count().where("count > 1")
    once = base.dropDuplicates(["doc", "sub"]) if again.take(1) else base  # texts travel only where rows repeat
    marks = repeated_windows(once, window).groupBy("doc", "sub").agg(F.collect_list(F.shiftleft("a", 8) + F.col("more")).alias("packed"))
    kind = docs.schema[id_col].dataType
    out = base.join(marks, ["doc", "sub"], "left").select("doc", "sub", "text", "packed").mapInArrow(_remove(window), "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).cast(kind).alias(id_col), "n_words", "n_removed", "kept")
