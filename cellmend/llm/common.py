"""Helpers shared by the training-data operators.

Conventions of every operator in this subpackage:

* it selects the columns it needs first, so extra columns of any name in the input neither clash nor travel;
* a null text counts as an empty text, a null id is carried through as null, an empty table gives an empty result;
* equal rows have equal results, and ties are broken by ids, so results do not depend on how rows are dealt (but see operator 9's parts);
* Python code works on Arrow batches cut into slices of bounded text size, so a task's memory does not depend on the
  number of rows in its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one slice of a batch may hold, unless a single text is longer.
SLICE_BYTES = 3_000_000

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def text_of(column: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id belongs to fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def carried(columns: tuple[str, ...], own: tuple[str, ...]) -> list[str]:
    """The columns that a result is to carry through, none of them called like the result's own."""
    if clash := sorted({*columns} & {*own}):
        raise ValueError(f"the result has columns of its own called {', '.join(clash)}")
    return list(dict.fromkeys(columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = texts.cast(pa.large_binary()) if not pa.types.is_binary(texts.type) else texts
        ends = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The bytes of an eight-byte block that belong to a span of which so many are left.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one at a time.
_LONG = 64


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[begin:end] (bytes), which together tell spans apart by 128 bits.

    Blocks of eight bytes go into two lanes, kept apart to the end: one mixes the block with what it holds, the other mixes the block on
    its own first. So no block undoes in both what an earlier one did. Long spans have BLAKE2b.
    """
    size = ends - begins
    a, b = mix64(size.astype(np.uint64)), mix64(size.astype(np.uint64) ^ _MIX_B)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))  # the block that starts at each byte
    todo, at = np.flatnonzero(size <= _LONG), 0
    while len(todo):
        left = size[todo] - at
        block = blocks[begins[todo] + at] & _MASK[np.minimum(left, 8)]
        a[todo] = mix64(a[todo] ^ block)
        b[todo] = mix64(b[todo] ^ mix64(block ^ _MIX_A))
        todo, at = todo[left > 8], at + 8
    first = mix64(a ^ (b << np.uint64(32) | b >> np.uint64(32)))
    second = mix64(b + first)
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(data[begins[i] : ends[i]].tobytes(), digest_size=16).digest()
        first[i], second[i] = (int.from_bytes(digest[j : j + 8], "little") for j in (0, 8))
    return first, second


def runs(values: np.ndarray, width: int, key: int) -> np.ndarray:
    """The hash of values[i : i + width] for each i from which so many values follow, from those of runs of 1, 2, 4, ... values."""
    odd = np.uint64((2 * key + 1) * int(_GOLD) % (1 << 64))
    power, size, out, done = mix64(values ^ odd), 1, None, 0
    while True:
        if width & size:
            out = power if out is None else mix64(out[: max(0, len(power) - done)] * odd + power[done:])
            done += size
        if 2 * size > width:
            return out[: max(0, len(values) - width + 1)]
        power, size = mix64(power[: max(0, len(power) - size)] * odd + power[size:]), 2 * size


def joint_runs(hashes: np.ndarray, checks: np.ndarray, width: int, key: int) -> np.ndarray:
    """``runs`` of words by both of their hashes."""
    return mix64(runs(hashes, width, key) ^ mix64(runs(checks, width, key + (1 << 20))))


class Words:
    """The words (runs of characters other than ASCII white space) of a column of texts, as hashes.

    ``hashes``, ``checks`` (a second hash), ``begins``, ``ends`` (bytes in ``data``) and ``doc`` (row) by word; row i has words ``first[i]``
    to ``first[i + 1]``. ``lower``: A-Z count as a-z.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        _, offsets, data = column.buffers()
        wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(_SPACE[self.data], out=inside[:n])
        change = np.zeros(n + 1, bool)
        change[1:] = inside[1:] != inside[:-1]
        change[0] = inside[0]
        change[at] |= inside[at] | np.where(at > 0, inside[at - 1], False)
        edge = np.flatnonzero(change)
        self.begins = edge[inside[edge]]
        stops = np.append(edge, n)
        self.ends = stops[np.searchsorted(edge, self.begins) + 1]
        self.first = np.searchsorted(self.begins, at)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.hashes, self.checks = span_hashes(_LOWER[self.data] if lower else self.data, self.begins, self.ends)

    def __len__(self) -> int:
        return len(self.hashes)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def exploded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the row of each."""
    return values.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(values)), np.diff(values.offsets.to_numpy()))
