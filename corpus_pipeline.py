"""From raw documents to token ids: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes what its predecessor kept, with the columns of ``documents`` (doc_id, text, lang, source, n_chars; others are dropped),
and works on all of it. A null text is empty; rows without an id pass the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.llm import minhash_dedup, mixing, pii, quality, sentencepiece_codec
from cellmend.llm.common import text_of
from cellmend.llm.queries import PIECE_MODEL, QUALITY_THRESHOLD
from cellmend.sources.scratch import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, keep=COLUMNS[1:]).where(F.col("score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of its rows the one whose text has the smallest hash.

    Repeated rows are a group; rows without words belong to none and stay. Rows without an id stay where no row has the same set, one each.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(text_of()).alias("copy"))
    found = stored(minhash_dedup.near_duplicates(docs, row_keys=True))
    worded = found.where("n_shingles > 0")
    # of kept rows, those of one component (or set, without an id) have the same set
    first = Window.partitionBy("component_id", "c1").orderBy("copy")
    later = worded.where("kept").groupBy("doc_id", "component_id", "c1", "copy").count().withColumn("place", F.row_number().over(first))
    dropped = worded.where("not kept").select("doc_id", "copy").unionByName(later.where("place > 1").select("doc_id", "copy")).distinct()
    repeated = later.where("place = 1 and count > 1").select("doc_id", "copy")
    rows = _without(keyed, dropped)
    if repeated.take(1):
        once = _only(keyed, repeated).dropDuplicates(["doc_id", "copy"])
        rows = _without(rows, repeated).unionByName(once)
    return rows.select(*COLUMNS)


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return _met(rows, keys, "left_anti")


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return _met(rows, keys, "left_semi")


def _met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    other = keys.select(F.col("doc_id").alias("k"), F.col("copy").alias("c")).hint("merge")  # grows with the documents: never broadcast
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("copy") == F.col("c")), how)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the data's kind."""
    found = pii.detect_pii(docs, keep=("lang", "source"), redacted=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights."""
    return mixing.mix(docs, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, with the end id."""
    return sentencepiece_codec.encode_documents(docs, PIECE_MODEL).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", token_ids),
]
#: Trained models and piece merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
