"""SentencePiece encoding and decoding with offsets (operator 1).

The text is normalised by longest-prefix matches in the model's compiled character map. Every normalised character keeps
the byte span of the source that it came from, so each piece is projected to a span of the original text. Segmentation is
byte-pair merging by piece score with byte fallback.

Merges never cross a boundary whose two characters stand side by side in no piece, so a text is cut there and the parts are
looked up in a bounded memo; this changes no id. A slice's parts that the memo lacks are merged together, one merge of every part
at a time, in numpy; very long ones and those with characters outside the vocabulary go one by one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import carried, slices, text_of

SPACE = "▁"
#: Piece types in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MEMO = 250_000
#: Longest part, in characters, that is merged together with others; parts merged at once; the rank of no merge.
_TOGETHER, _ROWS, _NEVER = 32, 8192, np.int32(2**31 - 1)


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose values point into a pool of replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.pool = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at ``at``, and its replacement."""
        units, best = self.units, None
        node = self._jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._jump(unit)
            if unit & 0x100:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(b"\0", best[1])]


class PieceCodec:
    """A byte-pair piece model: normalise, encode, project and decode."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("only byte-pair models without user-defined pieces are supported")
        self.map = CharacterMap(model.normalizer_spec.precompiled_charsmap)
        self.dummy = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.escape = model.normalizer_spec.escape_whitespaces
        kinds = [p.type for p in model.pieces]
        self.unk = kinds.index(UNKNOWN)
        self.eos = next((i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == model.trainer_spec.eos_piece), -1)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.joined = {s[i : i + 2] for s in self.scores for i in range(len(s) - 1)}
        self.no_cross = not any(s[0] != SPACE and s[1] == SPACE for s in self.joined)
        self.kinds = kinds
        self.unk_surface = model.trainer_spec.unk_surface.encode()
        self.surface = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for i, kind in enumerate(kinds):
            if kind == CONTROL:
                self.surface[i] = b""
            elif kind == UNKNOWN:
                self.surface[i] = self.unk_surface
            elif kind == BYTE:
                self.surface[i] = bytes([int(model.pieces[i].piece[3:5], 16)])
        self.plain = np.array([k != BYTE for k in kinds])
        self.pool = pa.array(self.surface, pa.binary())
        # characters that an id stands for; a byte id stands for its character if it is the first byte
        self.steps = np.array([(s & 0xC0 != 0x80) if k == BYTE else 1 if k == UNKNOWN else 0 if k == CONTROL else len(p.piece) for p, k, s in zip(model.pieces, kinds, (b[0] if b else 0 for b in self.surface))], np.int64)
        self._number_symbols()
        self.memo: dict[str, bytes] = {}

    def _number_symbols(self) -> None:
        """Numbers for all symbols that merging can meet (0: a character of no piece) and the table of merges, sorted by pair."""
        names = sorted({c for s in self.scores for c in s} | set(self.scores))
        number = {s: i + 1 for i, s in enumerate(names)}
        self.count = len(names) + 1
        self.id_of = np.array([-1, *(self.ids.get(s, -1) for s in names)], np.int32)
        self.symbol_of = np.zeros(0x110000, np.int32)
        for s in names:
            if len(s) == 1:
                self.symbol_of[ord(s)] = number[s]
        # pieces of one score have one rank
        rank = {score: i for i, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [(number[s[:i]] * self.count + number[s[i:]], rank[self.scores[s]], number[s]) for s in self.scores for i in range(1, len(s)) if s[:i] in number and s[i:] in number]
        found.sort()
        self.pairs, self.ranks, self.made = (np.array(x, kind) for x, kind in zip(zip(*found or [(0, _NEVER, 0)]), (np.int64, np.int32, np.int32)))

    # normalisation ------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normalised text, and for each of its characters the byte span of the source that it stands for."""
        data, out, spans = text.encode(), [], []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit:
                length, new = hit[0], hit[1].decode()
            else:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + length].decode()
            out.extend(new)
            spans.extend([(at, at + length)] * len(new))
            at += length
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            out, spans = [out[i] for i in keep], [spans[i] for i in keep]
        if out and self.dummy:
            out.insert(0, " ")
            spans.insert(0, (spans[0][0], spans[0][0]))
        result = "".join(out)
        return (result.replace(" ", SPACE) if self.escape else result), spans

    def _normal_text(self, text: str) -> str:
        if self.map or self.squeeze or not self.escape:
            return self.normalise(text)[0]
        return (" " * bool(self.dummy and text) + text).replace(" ", SPACE)

    # segmentation -------------------------------------------------------------------------------------------------

    def _merge(self, part: str) -> list[str]:
        """Byte-pair merging: the best-scored neighbours first, the leftmost of equals."""
        scores = self.scores
        if len(part) == 1 or part in scores and len(part) == 2:
            return [part]
        symbols: list[str | None] = list(part)
        if len(symbols) <= 24:
            while len(symbols) > 1:
                best, where = None, -1
                for i in range(len(symbols) - 1):
                    score = scores.get(symbols[i] + symbols[i + 1])
                    if score is not None and (best is None or score > best):
                        best, where = score, i
                if where < 0:
                    break
                symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
            return symbols
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                whole = symbols[i] + symbols[j]
                score = scores.get(whole)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, whole))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != whole:
                continue
            symbols[i], symbols[j] = whole, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def _pieces(self, segment: str) -> list[str]:
        """Segment a part of the normalised text."""
        joined, start, out = self.joined, 0, []
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in joined:
                out += self._merge(segment[start:i])
                start = i
        if start < len(segment):
            out += self._merge(segment[start:])
        return out

    def _ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unk]

    def _segment_ids(self, segment: str) -> bytes:
        return np.array([i for piece in self._pieces(segment) for i in self._ids(piece)], np.int32).tobytes()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the merges of two symbols, and what they make."""
        pair = left.astype(np.int64) * self.count + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NEVER), self.made[at]

    def _merge_together(self, segments: list[str], size: int) -> None:
        """Merge segments of at most ``size`` characters and put their ids into the memo."""
        n, wide = len(segments), size + 2
        lengths = np.fromiter(map(len, segments), np.int64, n)
        real = np.zeros((n, wide), bool)
        real[:, 1:-1] = np.arange(size) < lengths[:, None]
        symbols = np.zeros((n, wide), np.int32)
        symbols[real] = self.symbol_of[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        rank, made = np.full((n, wide), _NEVER), np.zeros((n, wide), np.int32)
        rank[:, 1:-1], made[:, 1:-1] = self._rank(symbols[:, 1:-1], symbols[:, 2:])
        flat, order, alive, whole = symbols.reshape(-1), rank.reshape(-1), real.reshape(-1), made.reshape(-1)
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)
        rows = np.arange(n)
        while len(rows):
            at = rows * wide + rank[rows].argmin(axis=1)
            more = order[at] != _NEVER
            rows, at = rows[more], at[more]
            gone = after[at]
            flat[at], alive[gone], order[gone] = whole[at], False, _NEVER
            right, left = after[gone], before[at]
            after[at], before[right] = right, at
            changed = np.concatenate([at, left])
            order[changed], whole[changed] = self._rank(flat[changed], flat[np.concatenate([right, at])])
        ids = self.id_of[flat[alive]]
        ends = np.cumsum(real.sum(axis=1))
        odd = np.zeros(n, bool)
        odd[np.searchsorted(ends, np.flatnonzero(ids < 0), side="right")] = True
        packed, stop = ids.tobytes(), (4 * ends).tolist()
        for segment, a, b, slow in zip(segments, [0, *stop], stop, odd.tolist()):
            self.memo[segment] = self._segment_ids(segment) if slow else packed[a:b]

    def _learn(self, wanted: set[str]) -> None:
        """Put all wanted segments of moderate length into the memo."""
        if len(self.memo) + len(wanted) > _MEMO:
            self.memo = {s: p for s, p in self.memo.items() if s in wanted}
        new = sorted(wanted - self.memo.keys(), key=len)
        for start in range(0, len(new), _ROWS):
            part = new[start : start + _ROWS]
            self._merge_together(part, len(part[-1]))

    def _segments(self, normal: str) -> list[str]:
        if not self.no_cross:
            return [normal] if normal else []
        if normal[:1] == SPACE and SPACE + SPACE not in normal:
            return [SPACE + w for w in normal[1:].split(SPACE)]
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """By text, ids as packed 32-bit integers, without an end id."""
        cut = [self._segments(self._normal_text(t)) for t in texts]
        self._learn({s for segments in cut for s in segments if len(s) <= _TOGETHER})
        memo = self.memo
        return [b"".join([memo.get(s) or self._segment_ids(s) for s in segments]) for segments in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def source(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of the source of each normalised character."""
        if self.map or self.squeeze:
            spans = np.array(self.normalise(text)[1], np.int32).reshape(-1, 2)
            return spans[:, 0], spans[:, 1]
        data = np.frombuffer(text.encode(), np.uint8)
        edge = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int32)
        if self.dummy and text:
            return np.append(edge[:1], edge[:-1]), edge
        return edge[:-1], edge[1:]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the source for the text's ids; all byte ids of one character share its span."""
        begins, ends = self.source(text)
        step = self.steps[ids]
        stop = np.cumsum(step)
        return begins[stop - np.maximum(step, 1)], ends[stop - 1]

    def encode_with_spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the byte span of the source."""
        ids = np.frombuffer(self.encode_many([text])[0], np.int32)
        begins, ends = self.spans(text, ids)
        return ids.tolist(), list(zip(begins.tolist(), ends.tolist()))

    # decoding -----------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int32), np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of several rows' ids; row i has ids ``first[i]`` to ``first[i + 1]``."""
        whole = self.pool.take(pa.array(ids))
        edge = np.frombuffer(whole.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = memoryview(whole.buffers()[2] or b"")
        filled = np.append(np.flatnonzero(np.diff(edge)), len(ids))
        leads = filled[np.searchsorted(filled, first[:-1])]
        out = []
        for a, b, lead in zip(first[:-1].tolist(), first[1:].tolist(), leads.tolist()):
            try:
                text = str(data[edge[a] : edge[b]], "utf-8")
            except UnicodeDecodeError:
                text = self._decode_broken(ids[a:b].tolist())
            if (self.dummy or self.squeeze) and lead < b and self.kinds[ids[lead]] not in (BYTE, UNKNOWN):
                text = text.lstrip(" ") if self.squeeze else text[text[:1] == " " :]
            out.append(text)
        return out

    def _decode_broken(self, ids: list[int]) -> str:
        """Bytes that form no character become one replacement character each."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or at + n >= len(run):
                            out.append("�")
                            at += 1
                            break
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each model and Python worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


#: Ids that are decoded at once, unless one row has more.
DECODE_IDS = 500_000


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", add_eos: bool = True, with_spans: bool = False) -> DataFrame:
    """``(id, ids array<int>[, begins array<int>, ends array<int>])`` of every whole text.

    Null and empty texts have the end id alone (or no id). Spans are byte offsets into the UTF-8 text; the end id's span is
    empty and at the end. Repeated rows give repeated results, an empty table an empty result; columns other than the two named take no
    part. The model file's path must be readable by the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        tail = np.array([c.eos] if add_eos else [], np.int32)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            packed = c.encode_many(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 + len(tail) for p in packed])]).astype(np.int32))
            values = [b"".join([p + tail.tobytes() for p in packed])]
            if with_spans:
                rows = [c.spans(t, np.frombuffer(p, np.int32)) for t, p in zip(texts, packed)]
                last = [np.full(len(tail), len(t.encode()), np.int32) for t in texts]
                values += [b"".join([r[side].tobytes() + x.tobytes() for r, x in zip(rows, last)]) for side in (0, 1)]
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(v, np.int32))) for v in values]
            names = ["id", "ids", "begins", "ends"][: 1 + len(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + ", begins array<int>, ends array<int>" * with_spans
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keep..., text)``: the text of every row's ``ids``; null ids give an empty text, an empty table an empty result. Repeated rows
    give repeated results. Columns other than those named take no part; ``keep`` may not name ``text``."""
    keep = carried(keep, ("text", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            sizes = batch.column(batch.num_columns - 1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(sizes, dtype=np.int64), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + DECODE_IDS, side="right")))
                part, start = batch.slice(start, stop - start), stop
                lists = part.column(part.num_columns - 1)
                first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = c.decode_many(lists.flatten().to_numpy(zero_copy_only=False), first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", text string"
    return encoded.select(id_col, *keep, "ids").mapInArrow(run, schema)
