"""Source divergence audit by two-dimensional tiles of groups (operator 11).

A group is a (lang, source) of the documents. One pass over the texts counts each group's terms, with map-side sums, so neither a hot
source nor a frequent term is ever a group of rows. Each lang keeps the terms that enough of its documents have; kept terms are dealt by
hash to chunks of bounded size and numbered within them, and a group's counts become one packed vector for each chunk.

Groups are dealt by hash to blocks. A task takes a pair of blocks (a tile) and the chunks one after the other, and adds each chunk to the
tile's matrix of distances; it holds one chunk of two blocks at a time. Long vocabularies are cut into stripes of chunks, whose matrices
Spark adds up. A vector meets every block once, so it travels as often as there are blocks, not groups.

Arithmetic is exact: shares are integers by long division, distances sums of integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.llm.common import slices
from cellmend.sources.scratch import Scratch

#: What stands between terms.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DivergenceParams:
    """``documents``: of a lang that must have a term for it to be kept; ``smooth``: added to every count; ``top``: ranks of a group's terms.

    ``chunk``: terms packed into a vector, about; ``block``: groups of a block, about; ``stripe``: chunks that one task goes through.
    """

    documents: int = 30
    smooth: int = 5
    top: int = 50
    chunk: int = 1024
    block: int = 64
    stripe: int = 256


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice, and a row without a term for each of its groups."""
    for part in slices(batches):
        langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
        kinds, of_row = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
        lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), _BETWEEN)
        terms = lists.flatten().dictionary_encode()
        width = max(1, len(terms.dictionary))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        if (empty := pc.index(terms.dictionary, "").as_py()) >= 0:
            row = np.where(terms.indices.to_numpy() == empty, -1, row)
        pairs, times = np.unique((row * width + terms.indices.to_numpy())[row >= 0], return_counts=True)  # a document's terms
        every, at = np.unique(of_row[pairs // width] * width + pairs % width, return_inverse=True)
        n, docs = np.zeros(len(every), np.int64), np.bincount(at, minlength=len(every))
        np.add.at(n, at, times)
        kind, none = np.concatenate([kinds[every // width], kinds]), np.zeros(len(kinds), np.int64)
        term = pa.concat_arrays([terms.dictionary.take(pa.array(every % width)), pa.nulls(len(kinds), pa.string())])
        owner = [langs.dictionary.take(pa.array(kind // len(sources.dictionary))), sources.dictionary.take(pa.array(kind % len(sources.dictionary)))]
        yield pa.RecordBatch.from_arrays([*owner, term, pa.array(np.append(n, none)), pa.array(np.append(docs, none))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in each group and documents that have it; a null term for each group."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total), exact for totals below 9 * 10^15: three steps of a long division by thousands."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return out + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` of arrays."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


_TILE = ("lang", "low", "high", "stripe")


def _tiles(smooth: int):
    """(lang, a, b, value): what a stripe of chunks adds to the distance of each pair of groups of a tile.

    Rows come by tile and chunk, first (chunk -1) one for each group of the tile's two blocks. Where neither of two groups has a term, its
    distance is that of their smallest shares, so a chunk adds only what differs from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, groups, chunk, rows, found = None, [], -1, [], None

        def ready() -> None:
            """The matrix of the tile whose groups are known."""
            nonlocal found
            total = np.array([max(1, g["total"]) for g in groups], np.int64)
            least = _shares(np.full(len(groups), smooth, np.int64), total)
            a, b = ([i for i, g in enumerate(groups) if g["block"] == tile[k]] for k in (1, 2))
            terms = groups[0]["terms"] if tile[3] == 0 else 0
            apart = np.abs(least[a][:, None] - least[b][None, :])
            found = ({g["source"]: i for i, g in enumerate(groups)}, total, least, a, b, apart, apart * terms)

        def add() -> None:
            """Add the chunk whose rows are complete."""
            if not rows:
                return
            known, total, least, a, b, apart, sums = found
            at = np.repeat([known[r["source"]] for r in rows], [len(r["places"]) for r in rows])
            columns, col = np.unique(np.concatenate([r["places"].values.to_numpy() for r in rows]), return_inverse=True)
            table = np.repeat(least[:, None], len(columns), axis=1)
            table[at, col] = _shares(np.concatenate([r["counts"].values.to_numpy() for r in rows]) + smooth, total[at])
            others = table[b]
            for i, group in enumerate(a):
                sums[i] += np.abs(others - table[group]).sum(axis=1) - len(columns) * apart[i]

        def done() -> Iterator[pa.RecordBatch]:
            if tile is None:
                return
            ready() if found is None else add()
            _, _, _, a, b, _, sums = found
            i, j = np.nonzero(np.less.outer(a, b)) if tile[1] == tile[2] else np.nonzero(np.ones(sums.shape, bool))
            names = [g["source"] for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(i), pa.string()), pa.array([names[a[x]] for x in i], pa.string()), pa.array([names[b[x]] for x in j], pa.string()), pa.array(sums[i, j])], names=["lang", "a", "b", "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _TILE)))
            chunks, blocks, totals, terms, sources = (batch.column(c).to_pylist() for c in ("chunk", "block", "total", "terms", "source"))
            for i, key in enumerate(keys):
                if key != tile:
                    yield from done()
                    tile, groups, chunk, rows, found = key, [], -1, [], None
                if chunks[i] == -1:
                    groups.append({"source": sources[i], "block": blocks[i], "total": totals[i], "terms": terms[i]})
                    continue
                if chunks[i] != chunk:
                    ready() if found is None else add()
                    chunk, rows = chunks[i], []
                rows.append({"source": sources[i], "places": batch.column("places")[i], "counts": batch.column("counts")[i]})
        yield from done()

    return run


def source_divergence(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far the sources of a language are apart in their terms, and by which terms.

    Null text, lang and source are empty strings. Terms are runs of ASCII letters and characters beyond ASCII, A-Z as a-z. A kept term's
    share in a group is 1 + floor(10^9 (n + smooth) / (N + smooth V)) of its n of N occurrences of V kept terms. Part "pair": each other
    source of the lang with the sum over kept terms of the shares' distance (0 without kept terms). Part "term": the terms that occur in
    the group and whose share is above their share in the whole lang, by the difference, ``top`` at most. Ranks go by falling value, then
    by the item's bytes. Every lang and source that occurs is a group, whatever its texts; a lang of one source has no pairs; repeated
    rows are documents of their own; other columns take no part; an empty table gives an empty result. Exact up to 9 * 10^15 terms a lang.
    """
    keep, lang = Scratch(docs.sparkSession), ["lang"]
    counts = keep.put("counts", term_counts(docs))
    terms = counts.where("term is not null")
    kept = keep.put("kept", terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= params.documents).drop("docs"))
    # stored, so that its size is known when it is joined: where it is small the vocabulary isn't dealt by lang
    langs = keep.put("langs", kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_n")))
    chunked = kept.join(langs.select("lang", "terms"), lang).withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / params.chunk)))
    numbered = chunked.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    # terms of the kept vocabulary in each group: at most as many rows as the counts
    own = keep.put("own", terms.select("lang", "source", "term", "n").join(numbered.drop("terms"), ["lang", "term"]))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / params.block).alias("blocks"))
    groups = groups.join(blocks, lang).join(sums, ["lang", "source"], "left").join(langs, lang, "left").na.fill(0, ["total", "terms", "lang_n"])
    groups = groups.withColumn("total", F.col("total") + params.smooth * F.col("terms")).withColumn("lang_total", F.col("lang_n") + params.smooth * F.col("terms")).drop("lang_n")
    groups = keep.put("groups", groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")))
    keep.drop("counts", "kept", "langs")

    packed = own.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("cells"))  # about ``chunk`` terms
    packed = packed.select("lang", "source", "chunk", F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"), F.floor(F.col("chunk") / params.stripe).alias("stripe"))
    last = F.greatest(F.lit(0), F.ceil(F.ceil(F.col("terms") / params.chunk) / params.stripe) - 1)
    heads = groups.select("lang", "source", F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<long>").alias("counts"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("stripe"))
    rows = heads.unionByName(packed).join(groups.select("lang", "source", "block", "blocks", "total", "terms"), ["lang", "source"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = rows.select(*_TILE, "chunk", "source", "block", "total", "terms", "places", "counts").repartition(*_TILE).sortWithinPartitions(*_TILE, "chunk", "source")
    sums = dealt.mapInArrow(_tiles(params.smooth), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))

    p, q = (share(F.col(n) + params.smooth, F.col(total)) for n, total in (("n", "total"), ("lang_n", "lang_total")))
    above = own.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    above = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= params.top).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(above.select(*columns))


def divergence_sql(params: DivergenceParams = DivergenceParams()) -> str:
    """The result of ``source_divergence`` on a view ``documents``."""
    s = params.smooth
    share = lambda n, total: f"CAST(1 + (1000000000::HUGEINT * ({n} + {s})) // ({total} + {s} * v) AS BIGINT)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {params.documents}),
        l AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_total FROM k GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(v, 0) AS v, lang_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)),
        n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        t AS (SELECT g.*, coalesce(total, 0) AS total FROM g LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY ALL) USING (lang, source)),
        p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, {share('coalesce(n, 0)', 'total')} AS p, {share('lang_n', 'lang_total')} AS q FROM t JOIN k ON k.lang = t.lang LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= {params.top}"""
