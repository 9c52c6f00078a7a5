"""Stand-ins for alignment data, made from the star-schema tables.

Reads: one for each lineitem. A read's chromosome, strand, position, sample and CIGAR string
come from its columns by the arithmetic below, which the SQL in the query modules repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, line, chrom, strand, position, sample, weight, span, cigar, aligner."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("read_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_returnflag").alias("chrom"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("l_partkey") * 37 + F.col("l_orderkey") % 14).alias("position"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 6).cast("string")).alias("sample"),
        F.col("l_discount").alias("weight"),
        F.col("l_quantity").cast("long").alias("span"),
        F.concat(F.col("l_linenumber"), F.lit("S"), F.col("l_quantity").cast("long"), F.lit("M"), (20 + F.col("l_suppkey") % 4), F.lit("N"), (5 + F.col("l_partkey") % 7), F.lit("M2D"), (4 + F.col("l_orderkey") % 5), F.lit("M"), (60 + F.col("l_partkey") % 3), F.lit("N8M"), (F.col("l_orderkey") % 9), F.lit("S")).alias("cigar"),
        F.concat(F.lit("aligner"), (F.col("l_linenumber") % 3).cast("string")).alias("aligner"),
    )


READS_SQL = """
reads AS (
  SELECT l_orderkey AS read_id, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS chrom,
         CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
         l_partkey * 37 + l_orderkey % 14 AS position,
         's' || CAST(l_suppkey % 6 AS VARCHAR) AS sample,
         l_discount AS weight, CAST(l_quantity AS BIGINT) AS span,
         l_linenumber || 'S' || CAST(l_quantity AS BIGINT) || 'M' || (20 + l_suppkey % 4) || 'N' || (5 + l_partkey % 7) || 'M2D' || (4 + l_orderkey % 5) || 'M' || (60 + l_partkey % 3) || 'N8M' || (l_orderkey % 9) || 'S' AS cigar,
         'aligner' || CAST(l_linenumber % 3 AS VARCHAR) AS aligner
  FROM lineitem
)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, chrom, strand, g_start, g_end (half open) and the 3' end gene_3prime."""
    part = table(spark, sf_dir, "part")
    g = part.select(
        F.concat(F.lit("g"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("gene_id"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_size") % 3 + 1).cast("int")).alias("chrom"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("p_partkey") * 37 - 100).alias("g_start"),
        (F.col("p_partkey") * 37 + 10 + F.col("p_size") * 4).alias("g_end"),
    )
    return g.withColumn("gene_3prime", F.when(F.col("strand") == "+", F.col("g_end") - 1).otherwise(F.col("g_start")))


GENES_SQL = """
genes AS (
  SELECT *, CASE WHEN strand = '+' THEN g_end - 1 ELSE g_start END AS gene_3prime FROM (
    SELECT 'g' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS gene_id, ['A', 'N', 'R'][p_size % 3 + 1] AS chrom,
           CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
           p_partkey * 37 - 100 AS g_start, p_partkey * 37 + 10 + p_size * 4 AS g_end
    FROM part)
)"""


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: the letters of a whole document, mapped onto bases."""
    docs = table(spark, sf_dir, "documents")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return docs.select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTAAAGTTGCAGTACGTAGCACGTACGTAAAGTTGCAGTACGTAGC").alias("seq"))


DNA_SQL = """
dna AS (
  SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTAAAGTTGCAGTACGTAGCACGTACGTAAAGTTGCAGTACGTAGC') AS seq FROM documents
)"""
