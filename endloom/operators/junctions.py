"""Splice junctions: extraction, support, annotation status, validation, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..functions.udfs import cigar_junctions
from .intervals import band_match

JKEYS = ["chrom", "strand", "j_start", "j_end"]


def read_junctions(reads: DataFrame, start: str = "position", cigar: str = "cigar", keep: list[str] = ()) -> DataFrame:
    """One row for each skipped stretch of each read: chrom, strand, kept columns, j_start, j_end."""
    found = reads.select("chrom", "strand", *keep, F.explode(cigar_junctions(start, cigar)).alias("j"))
    return found.select("chrom", "strand", *keep, F.col("j.start").alias("j_start"), F.col("j.end").alias("j_end"))


def support(junctions: DataFrame, sample: str = "sample") -> DataFrame:
    """Reads and samples of each junction."""
    return junctions.groupBy(*JKEYS).agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct(sample).alias("n_samples"))


def validated(supported: DataFrame, min_samples: int = 2, min_reads: int = 3, max_length: int = 10_000) -> DataFrame:
    return supported.where((F.col("n_samples") >= min_samples) & (F.col("n_reads") >= min_reads) & (F.col("j_end") - F.col("j_start") <= max_length))


def filter_junctions(supported: DataFrame, min_reads: int = 5, min_samples: int = 1, canonical_only: bool = False) -> DataFrame:
    """Conjunctive; conditions on columns that are absent do not apply."""
    out = supported.where(F.col("n_reads") >= min_reads)
    if "n_samples" in out.columns:
        out = out.where(F.col("n_samples") >= min_samples)
    return out.where("is_canonical") if canonical_only and "is_canonical" in out.columns else out


def annotation_status(junctions: DataFrame, known: DataFrame, tolerance: int = 5) -> DataFrame:
    """annotated (exact), near (both offsets together within twice the tolerance) or novel.
    known: chrom, strand, k_start, k_end."""
    matched = band_match(junctions, known, ["chrom", "strand"], ("j_start", "j_end"), ("k_start", "k_end"), 2 * tolerance, JKEYS, total=2 * tolerance)
    status = F.when(F.col("k_start").isNull(), "novel").when((F.col("d_start") == 0) & (F.col("d_end") == 0), "annotated").otherwise("near")
    return matched.withColumn("status", status)


def splice_site_class(junctions: DataFrame, known: DataFrame, tolerance: int = 10) -> DataFrame:
    """exact, alt_5ss, alt_3ss, alt_both or novel, by genomic offsets to the closest known
    junction."""
    m = band_match(junctions, known, ["chrom", "strand"], ("j_start", "j_end"), ("k_start", "k_end"), tolerance, JKEYS)
    kind = (
        F.when(F.col("k_start").isNull(), "novel")
        .when((F.col("d_start") == 0) & (F.col("d_end") == 0), "exact")
        .when(F.col("d_end") == 0, "alt_5ss")
        .when(F.col("d_start") == 0, "alt_3ss")
        .otherwise("alt_both")
    )
    return m.withColumn("kind", kind)


def retained(junctions: DataFrame, valid: DataFrame, read: list[str]) -> DataFrame:
    """Reads with the number of junctions kept (in the validated set) and dropped."""
    marked = junctions.join(valid.select(*JKEYS).distinct().withColumn("ok", F.lit(1)), JKEYS, "left")
    return marked.groupBy(*read).agg(F.count("ok").alias("kept"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("dropped"))


def with_partial_evidence(full: DataFrame, partial: DataFrame, mode: str = "proportional") -> DataFrame:
    """full: keys, n_reads; partial: keys, group_id, n_partial (reads that fit every junction
    of the group). proportional: partial reads are dealt by the share of confident reads in
    the group, evenly where there are none; holdout: only groups of one count."""
    if mode not in ("proportional", "holdout"):
        raise ValueError(mode)
    g = Window.partitionBy("group_id")
    p = partial.join(full, JKEYS, "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))
    total, size = F.sum("n_reads").over(g), F.count(F.lit(1)).over(g)
    share = F.when(total > 0, F.col("n_reads") / total).otherwise(1 / size) if mode == "proportional" else F.when(size == 1, 1.0).otherwise(0.0)
    gained = p.withColumn("gain", F.col("n_partial") * share).groupBy(*JKEYS).agg(F.sum("gain").alias("gain"))
    return full.join(gained, JKEYS, "full").select(*JKEYS, (F.coalesce("n_reads", F.lit(0)) + F.coalesce("gain", F.lit(0.0))).alias("n_reads"))


def introns_from_exons(exons: DataFrame, transcript: str, keys: list[str], start: str, end: str) -> DataFrame:
    """Gaps between the sorted exons of each transcript, distinct."""
    w = Window.partitionBy(transcript).orderBy(start, end)
    nxt = exons.withColumn("__next", F.lead(start).over(w))
    return nxt.where(F.col("__next") > F.col(end)).select(*keys, F.col(end).alias("intron_start"), F.col("__next").alias("intron_end")).distinct()


def with_motif(junctions: DataFrame, genome: DataFrame) -> DataFrame:
    """Adds five_ss, three_ss, motif and is_canonical from genome (chrom, seq). The genome is
    joined by chromosome after junctions are distinct."""
    g = junctions.join(genome.select("chrom", "seq"), "chrom")
    left = S.window(F.col("seq"), F.col("j_start"), F.col("j_start") + 2)
    right = S.window(F.col("seq"), F.col("j_end") - 2, F.col("j_end"))
    five = F.when(F.col("strand") == "+", left).otherwise(S.revcomp(right))
    three = F.when(F.col("strand") == "+", right).otherwise(S.revcomp(left))
    return g.withColumns({"five_ss": five, "three_ss": three, "motif": S.splice_class(five, three), "is_canonical": S.canonical_junction(five, three)}).drop("seq")


def merge_ambiguous(junctions: DataFrame, genome: DataFrame, max_shift: int = 50) -> DataFrame:
    """Junctions that a homopolymer makes indistinguishable (sliding both ends over equal
    bases) become one: the canonical form is the leftmost slide; counts are summed.

    The slide stops where the base before the start differs from the base before the end,
    and after max_shift bases, a bound of the operator's own."""
    g = junctions.join(genome.select("chrom", "seq"), "chrom")
    same = lambda i: F.substring("seq", F.col("j_start") - i + 1, F.lit(1)) == F.substring("seq", F.col("j_end") - i + 1, F.lit(1))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(max_shift)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, i: F.struct(F.when(acc["on"] & (F.col("j_start") - i >= 0) & same(i), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & (F.col("j_start") - i >= 0) & same(i)).alias("on")))["n"]
    slid = g.withColumn("shift", run).withColumn("j_start", F.col("j_start") - F.col("shift")).withColumn("j_end", F.col("j_end") - F.col("shift"))
    return slid.groupBy(*JKEYS).agg(F.sum("n_reads").alias("n_reads"), F.count(F.lit(1)).alias("n_merged"))
