"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame operations only).

Each input partition deals its rows into runs; a run is one partition's list of digests, in
ascending order, with one partial result a digest. The runs meet in rounds of a butterfly (a
binomial tree in which every node, not one root alone, ends with a share): a node has one
digit of base ``fan_in`` for each round, and round r sends every entry of a run to the node
whose digit r is the entry's, a hash of its digest and r. So a node receives parts of ``fan_in`` runs,
merges them in order of the digest, and keeps the verified smallest identifier of every
digest; after the last round a digest's node depends on the digest alone. In the plan a
round is one exchange by run, one sort by run and digest and a sort aggregate; nothing is
grouped across nodes before its round. No node ever holds more than one row for each of
its digests, however many copies a text has.

A digest is verified: rows merge only if SHA-256, a second 64-bit hash and the length of
the normalised text all agree.

The way back down joins the final rows to the partial rows of the runs (at most one for
each run and digest), and those to the rows of each run, so a text that holds a third of
all rows is split over all runs in every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, cut, picked, shuffle_width


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE + "+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (code points of the original text), sha (32 bytes), chk."""
    base = picked(docs, id=id_col, text=text_col).select("id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    return base.select(
        "id",
        "n",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
        F.struct(F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("bytes")).alias("chk"),
    )


def merged(entries: DataFrame) -> DataFrame:
    """entries: run, sha, chk, best, size. One partition for each run, in order of the digest,
    with the least best and the sum of sizes of every verified digest."""
    sent = entries.repartition("run").sortWithinPartitions("run", "sha", "chk")
    return sent.groupBy("run", "sha", "chk").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def merge_runs(leaves: DataFrame, fan_in: int, rounds: int) -> DataFrame:
    """leaves: sorted runs (run, sha, chk, best, size). One row for each (sha, chk)."""
    level = leaves
    for r in range(rounds):
        place = fan_in**r
        digit = F.pmod(F.xxhash64("sha", F.lit(r)), F.lit(fan_in))
        own = F.pmod(F.floor(F.col("run") / place), F.lit(fan_in))
        node = (F.col("run") + (digit - own) * place).cast("long")
        level = merged(level.select(node.alias("run"), "sha", "chk", "best", "size"))
    return level.select("sha", "chk", "best", "size")


def rounds_for(width: int, fan_in: int) -> int:
    """The rounds that give at least as many runs as there are shuffle partitions."""
    rounds = 1
    while fan_in**rounds < width:
        rounds += 1
    return rounds


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, rounds: int | None = None) -> DataFrame:
    """Group rows whose texts are identical once ASCII white space is deleted.

    Returns one row for every input row: doc_id, keep_id, group_size (rows), kept,
    text_sha256 (hex, of the normalised text in UTF-8). The representative has the most
    code points in its original text; ties go to the smallest identifier, null after all
    others. Null and empty texts, and texts of white space alone, form one group. Rows
    repeated with the same identifier stay repeated, and all of them are kept or none.
    Other columns of docs have no influence; an empty table gives an empty frame. Runs one
    job, which checkpoints the digests, so that texts are read and hashed once. rounds: two
    at least, and more with more shuffle partitions.
    """
    rounds = rounds or max(2, rounds_for(shuffle_width(docs.sparkSession), fan_in))
    # Rows of one identifier and text are dealt by their partition too, so none of them is hot.
    dealt = digests(docs, id_col, text_col).withColumn("run", F.pmod(F.xxhash64("id", "chk", F.spark_partition_id()), F.lit(fan_in**rounds)))
    rows = cut(dealt)
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("missing"), F.col("id").alias("id"))
    leaves = merged(rows.select("run", "sha", "chk", best.alias("best"), F.lit(1).cast("long").alias("size")))
    final = merge_runs(leaves, fan_in, rounds)
    down = leaves.select("run", "sha", "chk").join(final, ["sha", "chk"])
    return rows.select("id", "run", "sha", "chk").join(down, ["run", "sha", "chk"]).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
