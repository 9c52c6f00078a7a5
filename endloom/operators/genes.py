"""Gene attribution, isoforms, regions and quality counters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attribution_string(assignments: DataFrame, key: str, least: float = 0.01) -> DataFrame:
    """key, attribution: "genes,PP%" of each gene set, most reads first, joined by ";".
    assignments: key, genes (array, may be empty), n. Shares below ``least`` are left out;
    percentages are rounded half to even."""
    sets = assignments.groupBy(key, F.array_join(F.array_sort("genes"), ",").alias("genes")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    shares = sets.withColumn("share", F.col("n") / total).where(F.col("share") >= least)
    text = F.concat(F.when(F.col("genes") == "", "none").otherwise(F.col("genes")), F.lit(","), F.bround(F.col("share") * 100, 0).cast("long").cast("string"), F.lit("%"))
    each = shares.select(key, F.struct((-F.col("n")).alias("n"), "genes", text.alias("text")).alias("s"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), ";").alias("attribution"))


def isoforms(reads: DataFrame, least: int = 3) -> DataFrame:
    """gene, junctions (sorted), tes_bin -> n_reads, tes (median, floored). Without a TES
    cluster, ends are binned by 50 (rounded half to even). reads: gene, junctions, tes."""
    keyed = reads.withColumn("tes_bin", (F.bround(F.col("tes") / 50, 0) * 50).cast("long")).withColumn("junctions", F.array_sort("junctions"))
    counted = keyed.groupBy("gene", "junctions", "tes_bin", "tes").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("gene", "junctions", "tes_bin")
    before = F.sum("n").over(w.orderBy("tes").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    c = counted.withColumn("before", before).withColumn("total", F.sum("n").over(w))
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("tes")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return c.groupBy("gene", "junctions", "tes_bin").agg(F.sum("n").alias("n_reads"), F.floor((at(low) + at(high)) / 2).alias("tes")).where(F.col("n_reads") >= least)


def isoform_usage(iso: DataFrame) -> DataFrame:
    return iso.withColumn("usage", F.col("n_reads") / F.sum("n_reads").over(Window.partitionBy("gene")))


def proximal_distal(iso: DataFrame, least_span: int = 100) -> DataFrame:
    """gene, strand, proximal, distal for genes whose ends span enough."""
    ends = iso.groupBy("gene", "strand").agg(F.min("tes").alias("low"), F.max("tes").alias("high")).where(F.col("high") - F.col("low") >= least_span)
    plus = F.col("strand") == "+"
    return ends.select("gene", "strand", F.when(plus, F.col("low")).otherwise(F.col("high")).alias("proximal"), F.when(plus, F.col("high")).otherwise(F.col("low")).alias("distal"))


def body_category(overlaps: DataFrame, body: list[str], priority: list[str]) -> DataFrame:
    """The category with the largest summed overlap; ties by priority. overlaps: body,
    category, overlap_bp."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("category"))
    sums = overlaps.groupBy(*body, "category").agg(F.sum("overlap_bp").alias("bp"))
    return sums.groupBy(*body).agg(F.min_by("category", F.struct((-F.col("bp")).alias("bp"), rank.alias("rank"))).alias("category"))


def region_distribution(categories: DataFrame, category: str = "category", n: str = "n") -> DataFrame:
    counts = categories.groupBy(category).agg(F.sum(n).alias("n_reads"), F.count(F.lit(1)).alias("n_positions"))
    total = counts.agg(F.sum("n_reads").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(category, "n_reads", "n_positions", (100.0 * F.col("n_reads") / F.col("__t")).alias("percent"))


def qc_stats(reads: DataFrame) -> DataFrame:
    """One row of counters: conditional sums and maxima."""
    return reads.agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.count_if(F.col("is_primary")).alias("n_primary"),
        F.count_if(F.col("ambiguous")).alias("n_ambiguous"),
        F.count_if(F.col("corrected")).alias("n_corrected"),
        F.coalesce(F.max("shift"), F.lit(0)).alias("max_shift"),
        F.coalesce(F.sum("shift"), F.lit(0)).alias("total_shift"),
    )


def validation_metrics(rows: DataFrame) -> DataFrame:
    """correction, confidence ("all" where summed over) -> counts of rows with truth by
    distance, and of all rows. rows: correction, confidence, error (null without truth),
    before (error before correction)."""
    sets = rows.groupingSets([[], ["correction"], ["confidence"]], "correction", "confidence")
    within = lambda k: F.count_if(F.abs("error") <= k)
    out = sets.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("error").alias("n_truth"),
        *[within(k).alias(f"within_{k}") for k in (0, 1, 2, 5)],
        F.count_if(F.abs("error") < F.abs("before")).alias("improved"),
        F.count_if(F.abs("error") > F.abs("before")).alias("worsened"),
    )
    return out.withColumns({"correction": F.coalesce("correction", F.lit("all")), "confidence": F.coalesce("confidence", F.lit("all"))})


def variant_frequency(mismatches: DataFrame, coverage: DataFrame, keys: list[str], least: int = 5, fraction: float = 0.8) -> DataFrame:
    """Positions whose most frequent mismatch makes up so much of all covering reads."""
    top = mismatches.groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max_by(F.struct("base", "n"), F.struct("n", "base")).alias("t"))
    return top.join(coverage, keys).select(*keys, F.col("t.base").alias("base"), F.col("t.n").alias("n_mismatch"), "depth", (F.col("t.n") / F.col("depth")).alias("fraction")).where((F.col("depth") >= least) & (F.col("fraction") >= fraction))


def shift_calibration(tails: DataFrame) -> DataFrame:
    """a_count -> shift: how far the mean of replicate means lies below that of no As."""
    reps = tails.groupBy("a_count", "replicate").agg(F.avg("tail").alias("m"))
    means = reps.groupBy("a_count").agg(F.avg("m").alias("mean_tail"))
    base = means.where("a_count = 0").select(F.col("mean_tail").alias("base"))
    return means.crossJoin(F.broadcast(base)).select("a_count", "mean_tail", F.greatest(F.lit(0.0), F.col("base") - F.col("mean_tail")).alias("shift"))


def tail_training(seqs: DataFrame, richness: str = "richness") -> DataFrame:
    """Moments of richness and length, and the threshold: the 10th percentile less 0.05,
    kept between 0.6 and 0.95."""
    return seqs.agg(F.count(F.lit(1)).alias("n"), F.avg(richness).alias("mean_richness"), F.stddev_samp(richness).alias("sd_richness"), F.avg("length").alias("mean_length"), F.greatest(F.lit(0.6), F.least(F.lit(0.95), F.expr(f"percentile({richness}, 0.1)") - 0.05)).alias("threshold"))


def homopolymer_penalties(runs: DataFrame) -> DataFrame:
    """runs: base, length, deleted (whether a read shortened the run). base, length, n, rate
    (with half a case of either kind) and penalty: the cost of a deletion there against one
    that happens once in a hundred."""
    g = runs.groupBy("base", "length").agg(F.count(F.lit(1)).alias("n"), ((F.count_if("deleted") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("rate"))
    return g.withColumn("penalty", -F.log("rate") / F.lit(-math.log(0.01)))


def cluster_genes(assigned: DataFrame, keys: list[str], cluster: str = "cluster_id") -> DataFrame:
    """assigned: keys of a cluster, gene_id (null: none), n. keys, attribution, primary_gene (most
    reads, then the first; none if there is no gene), primary_fraction (of the reads with a
    gene, to three decimals; 1 if there is none), n_intergenic."""
    n = assigned.groupBy(*keys, "gene_id").agg(F.sum("n").alias("n"))
    genic = F.col("gene_id").isNotNull()
    best = n.groupBy(*keys).agg(
        F.min_by("gene_id", F.when(genic, F.struct((-F.col("n")).alias("n"), "gene_id"))).alias("primary_gene"),
        F.max(F.when(genic, F.col("n"))).alias("__top"), F.sum(F.when(genic, F.col("n"))).alias("__genic"), F.coalesce(F.sum(F.when(~genic, F.col("n"))), F.lit(0)).alias("n_intergenic"),
    )
    named = n.withColumn("__key", F.struct(*keys)).withColumn("genes", F.when(genic, F.array("gene_id")).otherwise(F.array().cast("array<string>")))
    text = attribution_string(named, "__key").select("__key.*", "attribution")
    shown = best.select(*keys, F.coalesce("primary_gene", F.lit("none")).alias("primary_gene"), F.coalesce(F.round(F.col("__top") / F.col("__genic"), 3), F.lit(1.0)).alias("primary_fraction"), "n_intergenic")
    return shown.join(text, keys)
