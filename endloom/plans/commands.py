"""One function for each analytic command: DataFrames in, DataFrames out, nothing is run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..operators import clustering as C
from ..operators import genes as G
from ..operators import intervals as I
from ..operators import junctions as J
from ..operators import stats as T

KEYS = ["chrom", "strand"]


def correct(reads: DataFrame, genome: DataFrame) -> DataFrame:
    """Adds ambiguity (struct), mispriming (struct), corrected_3prime, confidence, qc_flags and
    fraction to reads (chrom, strand, three_prime, ...).

    Positions are looked up once each: reads of one end share the genome's row. A read on a
    chromosome that the genome lacks keeps its position, with the flag no_sequence.
    """
    sites = reads.select(*KEYS, "three_prime").distinct()
    known = sites.join(genome.select("chrom", "seq"), "chrom", "left")
    looked = known.select(*KEYS, "three_prime", F.col("seq").isNull().alias("missing"), S.tract_ambiguity(F.col("seq"), F.col("three_prime"), F.col("strand")).alias("ambiguity"), S.mispriming(F.col("seq"), F.col("three_prime"), F.col("strand")).alias("mispriming"))
    out = reads.join(looked, [*KEYS, "three_prime"], "left")
    width = F.coalesce(F.col("ambiguity.hi") - F.col("ambiguity.lo"), F.lit(0))
    corrected = F.when(F.col("missing"), F.col("three_prime")).when(F.col("strand") == "+", F.col("ambiguity.lo")).otherwise(F.col("ambiguity.hi"))
    flags = F.array_compact(F.array(F.when(F.col("missing"), "no_sequence"), F.when(F.col("mispriming.misprimed"), "ag_rich"), F.when(width > 0, "a_tract")))
    confidence = F.when(width == 0, "high").when(width <= 2, "medium").otherwise("low")
    return out.withColumns({"corrected_3prime": F.coalesce(corrected, "three_prime"), "confidence": confidence, "qc_flags": flags, "fraction": F.lit(1.0)}).drop("missing")


def analyze(ends: DataFrame, genes: DataFrame, distance: int = 25, min_reads: int = 5) -> dict[str, DataFrame]:
    """clusters, matrix (long), genes (nearest), gene_counts of corrected ends (chrom, strand,
    position, sample, fraction) and genes (chrom, strand, gene_id, gene_3prime)."""
    clusters = C.cluster_fixed(ends, KEYS, "position", distance, min_reads)
    places = C.position_counts(ends, [*KEYS, "position", "sample"], "fraction", "weight")
    bounds = clusters.select(*KEYS, F.col("start").alias("c_start"), F.col("end").alias("c_end"), "cluster_id")
    assigned = I.first_containing(places, bounds, KEYS, "position", "c_start", "c_end", "cluster_id", [*KEYS, "position", "sample"], how="inner")
    sign = F.when(F.col("strand") == "+", 1).otherwise(-1)
    near = I.nearest_bounded(clusters.select("cluster_id", *KEYS, "modal_position"), genes.select(*KEYS, "gene_id", "gene_3prime"), KEYS, "modal_position", "gene_3prime", -500, 100, sign, "gene_id", ["cluster_id"])
    matrix = C.count_matrix(assigned, clusters, ends.select("sample"))
    by_gene = matrix.join(near.where("gene_id IS NOT NULL").select("cluster_id", "gene_id"), "cluster_id").groupBy("gene_id", "sample").agg(F.sum("total").alias("total"))
    return {"clusters": clusters, "matrix": matrix, "genes": near, "gene_counts": by_gene}


def aggregate_ends(ends: DataFrame, window: int = 10) -> DataFrame:
    """Anchored clusters of one kind of end with what lies behind it: keys, start, end, mode,
    n_reads, mean and median of the other end, mean length. ends: chrom, strand, position,
    other, length."""
    found = C.cluster_anchored(ends, KEYS, "position", window).select(*KEYS, F.col("start").alias("c_start"), F.col("end").alias("c_end"), "mode", "n_reads")
    hits = I.point_in_interval(ends, found, KEYS, "position", "c_start", "c_end")
    return hits.groupBy(*KEYS, F.col("c_start").alias("start"), F.col("c_end").alias("end"), "mode", "n_reads").agg(F.round(F.avg("other"), 1).alias("mean_other"), F.floor(F.expr("percentile(other, 0.5)")).alias("median_other"), F.round(F.avg("length"), 1).alias("mean_length"))


def aggregate_junctions(reads: DataFrame, genome: DataFrame | None = None, min_reads: int = 1) -> DataFrame:
    """Junction table of reads (chrom, strand, position, cigar, sample), with motifs if a
    genome is given."""
    table = J.filter_junctions(J.support(J.read_junctions(reads, keep=["sample"])), min_reads)
    return table if genome is None else J.with_motif(table, genome)


def shifts(matrix: DataFrame, clusters: DataFrame, conditions: DataFrame, a: str, b: str, least: float = 0.1, top: int = 20) -> DataFrame:
    """The genes whose clusters shift most between two conditions: matrix: cluster_id, sample,
    total; clusters: cluster_id, gene_id, strand, modal_position; conditions: sample, condition."""
    means = matrix.join(conditions, "sample").groupBy("cluster_id").agg(*[F.avg(F.when(F.col("condition") == c, F.col("total"))).alias(n) for c, n in ((a, "a"), (b, "b"))])
    wide = clusters.join(means, "cluster_id").select(F.col("gene_id").alias("gene"), "strand", F.col("modal_position").alias("position"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    out = T.jensen_shannon(wide, "gene", "position", "a", "b").join(T.cluster_shift(wide, "gene", "position", "a", "b"), "gene")
    return out.where(F.col("divergence") >= least).orderBy(F.col("divergence").desc(), "gene").limit(top)


def classify_positions(positions: DataFrame, features: DataFrame, priority: list[str]) -> DataFrame:
    """Each position (chrom, strand, position, n) with the category of highest priority that
    holds it; antisense if only the other strand has one, else intergenic."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("category"))
    f = features.select("chrom", F.col("strand").alias("f_strand"), "f_start", "f_end", "category")
    hits = I.point_in_interval(positions, f, ["chrom"], "position", "f_start", "f_end", half_open=True, how="left")
    same = F.col("strand") == F.col("f_strand")
    best = hits.groupBy("chrom", "strand", "position", "n").agg(F.min_by(F.when(same, F.col("category")), F.when(same, rank)).alias("own"), F.max(F.col("f_strand").isNotNull() & ~same).alias("other"))
    return best.select("chrom", "strand", "position", "n", F.coalesce("own", F.when(F.coalesce("other", F.lit(False)), F.lit("antisense")).otherwise(F.lit("intergenic"))).alias("category"))


def validate(ends: DataFrame, truth: DataFrame, reach: int = 10) -> DataFrame:
    """Metrics of corrected ends against the nearest true position within reach. ends: chrom,
    strand, read_id, three_prime, corrected_3prime, correction, confidence."""
    sites = I.nearest_bounded(ends.select(*KEYS, "corrected_3prime").distinct(), truth.select(*KEYS, F.col("position").alias("t_pos")), KEYS, "corrected_3prime", "t_pos", -reach, reach, row_id=[*KEYS, "corrected_3prime"])
    joined = ends.join(sites.select(*KEYS, "corrected_3prime", "t_pos"), [*KEYS, "corrected_3prime"], "left")
    return G.validation_metrics(joined.select("correction", "confidence", (F.col("corrected_3prime") - F.col("t_pos")).alias("error"), (F.col("three_prime") - F.col("t_pos")).alias("before")))


def split_reads(reads: DataFrame, chunks: int, read: str = "read_id") -> DataFrame:
    """Adds chunk: a hash of the read's name, so that all rows of a read share it."""
    return reads.withColumn("chunk", F.pmod(F.xxhash64(read), F.lit(chunks)))


def weighted_five_prime(reads: DataFrame) -> DataFrame:
    """Weighted 5' ends: full-length reads count one, others their confidence."""
    weight = F.when(F.col("is_full_length"), 1.0).otherwise(F.col("confidence")) * F.col("count")
    return reads.groupBy(*KEYS, "five_prime").agg(F.sum(weight).alias("weight"), F.sum("count").alias("n_reads"))


def junction_signatures(reads: DataFrame) -> DataFrame:
    return reads.groupBy(*KEYS, F.array_sort("junctions").alias("junctions")).agg(F.sum("count").alias("n_reads"))


def processing_regions(coverage: DataFrame, gap: int = 10_000, least: int = 100_000) -> DataFrame:
    """Regions cut where merged coverage leaves a gap: chrom, start, end. Regions shorter than
    ``least`` stay with the region before."""
    w = Window.partitionBy("chrom").orderBy("start")
    merged = I.merge_intervals(coverage, ["chrom"], "start", "end", gap)
    first = F.min("start").over(Window.partitionBy("chrom"))
    region = F.floor((F.col("start") - first) / least)
    return merged.withColumn("region", region).groupBy("chrom", "region").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("number", F.row_number().over(w) - 1).drop("region")
