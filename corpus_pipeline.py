"""A corpus pipeline of five stages, each of which applies one operator to all documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Each row stays or goes by its own text: rows are told apart by doc_id and
a hash of the text, so null or shared identifiers do no harm. Null texts count as empty;
extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from endloom.llm import decontaminate, exact_dedup, ngram_join, packing, queries, toxicity
from endloom.llm.common import cut, shared_path

TOXIC_FROM = 0.3


def _row() -> Column:
    """A key of (doc_id, text)."""
    return F.xxhash64("doc_id", "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose key is in rejected (key)."""
    gone = rejected.select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__row", _row()).join(gone, F.col("__row") == F.col("__key"), "left_anti").drop("__row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC_FROM or more go. Repeated rows stay or go
    together; a null text counts as empty. Without labels of both kinds the score is the share
    of toxic labels, so all rows share one fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), labels, learn_from=lambda i: ~queries.held_out(i), by_row=True)
    toxic = scored.where(F.col("score") >= TOXIC_FROM).select("doc_id", "row_key").distinct()
    own = docs.withColumn("__row", F.xxhash64("text"))
    return own.join(toxic, own["doc_id"].eqNullSafe(toxic["doc_id"]) & (own["__row"] == toxic["row_key"]), "left_anti").drop("__row")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text (white space aside) one stays, and one of rows that
    repeat. Null, empty and blank texts are one text."""
    found = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha")).distinct()
    own = docs.withColumn("__own", F.unhex(F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)))
    kept = own.join(found, (own["__own"] == found["__sha"]) & own["doc_id"].eqNullSafe(found["__id"]), "left_semi")
    # The representative of a text has the most characters, so its repeats are sought among
    # rows of its own doc_id and digest only.
    first = Window.partitionBy("__own", "doc_id").orderBy(F.length(F.coalesce("text", F.lit(""))).desc(), F.xxhash64("text"))
    return kept.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__own", "__place")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that the n-gram Jaccard join links, the one with the least
    doc_id stays (null ones last). Empty texts are in no class and stay; rows that repeat share
    a key, so they stay or go together."""
    classes = ngram_join.classes(docs.select(_row().alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = cut(classes.join(docs.select(_row().alias("key"), "doc_id").distinct(), "key"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    return _without(docs, named.join(first, "key", "left_anti").select("key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lie in windows of benchmark items.
    Texts without words stay; with an empty benchmark all do. Repeated rows share one fate."""
    found = decontaminate.contamination(docs.select(_row().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, decontaminate.judged(found).where("contaminated").select(F.col("doc_id").alias("key")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences. Every row gives pieces,
    repeated ones and those with a null doc_id too; a null text counts as empty."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), queries.tokenizer("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
