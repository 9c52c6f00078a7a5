"""Evidence and summaries: junction evidence, ambiguous reads, low counts, categories, result
tables and spike-in votes. All are joins and aggregates of distinct keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from .intervals import nearest_bounded
from .junctions import JKEYS


def ordered_list(df: DataFrame, keys: list[str], item: str, name: str, distinct: bool = False) -> DataFrame:
    """keys with all items of a group in ascending order. The list is as long as its group:
    for a group without bound, count instead."""
    items = F.collect_set(item) if distinct else F.collect_list(item)
    return df.groupBy(*keys).agg(F.array_sort(items).alias(name))


def junction_evidence(junctions: DataFrame, known: DataFrame, list_reads: bool = False) -> DataFrame:
    """junctions: JKEYS, read_id, mapq (one row for each junction of each read); known: chrom,
    strand, k_start, k_end. JKEYS, n_reads, mean_mapq, annotated and, if asked for, the
    ordered read list."""
    lists = [F.array_sort(F.collect_list("read_id")).alias("reads")] if list_reads else []
    found = junctions.groupBy(*JKEYS).agg(F.count(F.lit(1)).alias("n_reads"), F.avg("mapq").alias("mean_mapq"), *lists)
    listed = known.select("chrom", "strand", F.col("k_start").alias("j_start"), F.col("k_end").alias("j_end")).distinct().withColumn("annotated", F.lit(True))
    return found.join(listed, JKEYS, "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))


def valid_evidence(evidence: DataFrame, least: int = 2, canonical: str | None = "is_canonical") -> DataFrame:
    """Annotated junctions, and others with enough reads and (if the column is named) a
    canonical motif."""
    novel = F.col("n_reads") >= least
    return evidence.where(F.col("annotated") | (novel & F.coalesce(F.col(canonical), F.lit(False)) if canonical else novel))


def ambiguous_counts(evidence: DataFrame, mode: str = "proportional") -> DataFrame:
    """evidence: read_id, intron_id, alternatives (array of the introns that fit as well; null
    or empty for a read that fits one). intron_id, confident, ambiguous, attributed, total.

    proportional: an intron's ambiguous reads count by its share of the confident reads of
    its group (itself and its alternatives), evenly where a group has none; holdout: not
    at all. A group is that of an intron's first ambiguous read in order of the group, and
    each group deals once: its introns take the share of the first group that names them.
    """
    if mode not in ("proportional", "holdout"):
        raise ValueError(mode)
    unsure = F.size(F.coalesce("alternatives", F.expr("CAST(array() AS array<string>)"))) > 0
    counts = evidence.groupBy("intron_id").agg(F.count_if(~unsure).alias("confident"), F.count_if(unsure).alias("ambiguous"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("alternatives")))).alias("others"))
    if mode == "holdout":
        return counts.select("intron_id", "confident", "ambiguous", F.lit(0.0).alias("attributed"), F.col("confident").cast("double").alias("total"))
    groups = counts.where("ambiguous > 0").select(F.array_sort(F.array_distinct(F.array_append("others", F.col("intron_id")))).alias("group"), "intron_id").groupBy("group").agg(F.min("intron_id").alias("leader"))
    members = groups.select("group", "leader", F.size("group").alias("size"), F.explode("group").alias("intron_id"))
    known = members.join(counts.select("intron_id", "confident", "ambiguous"), "intron_id", "left").withColumn("confident", F.coalesce("confident", F.lit(0)))
    w = Window.partitionBy("group")
    share = F.when(F.sum("confident").over(w) > 0, F.col("confident") / F.sum("confident").over(w)).otherwise(1 / F.col("size"))
    dealt = known.withColumn("gain", F.coalesce("ambiguous", F.lit(0)) * share)
    first = dealt.groupBy("intron_id").agg(F.min_by("gain", F.struct("leader", "group")).alias("gain"))
    out = counts.join(first, "intron_id", "left").withColumn("attributed", F.when(F.col("ambiguous") > 0, F.coalesce("gain", F.lit(0.0))).otherwise(0.0))
    return out.select("intron_id", "confident", "ambiguous", "attributed", (F.col("confident") + F.col("attributed")).alias("total"))


def enough_counts(counts: DataFrame, least: float, samples: int) -> DataFrame:
    """Rows of features with at least ``least`` in at least ``samples`` samples. counts:
    feature, sample, count."""
    kept = counts.groupBy("feature").agg(F.count_if(F.col("count") >= least).alias("n")).where(F.col("n") >= samples).select("feature")
    return counts.join(kept, "feature", "left_semi")


def enough_total(counts: DataFrame, least: float) -> DataFrame:
    """Rows of features whose counts add up to at least ``least``."""
    kept = counts.groupBy("feature").agg(F.sum("count").alias("n")).where(F.col("n") >= least).select("feature")
    return counts.join(kept, "feature", "left_semi")


def annotate_results(results: DataFrame, clusters: DataFrame, key: str = "feature") -> DataFrame:
    """Results with the columns of their cluster; a result without a cluster keeps nulls and
    is marked unannotated."""
    return results.join(clusters.dropDuplicates([key]).withColumn("__known", F.lit(True)), key, "left").withColumn("unannotated", F.col("__known").isNull()).drop("__known")


def result_tables(results: DataFrame, alpha: float = 0.05, fold: float = 1.0) -> DataFrame:
    """Rows with padj below alpha and a log2 fold change beyond fold, with direction up or
    down. Null p-values are not significant."""
    lfc = F.col("log2fc")
    return results.where((F.col("padj") < alpha) & (F.abs(lfc) > fold)).withColumn("direction", F.when(lfc > 0, "up").otherwise("down"))


def category_summary(df: DataFrame, value: str, category: str) -> DataFrame:
    """category ('all' for all rows) with n, mean, median, max of value over its rows."""
    sums = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile(`{value}`, 0.5)").alias("median"), F.max(value).alias("max")]
    return df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("none")).alias("category")).agg(*sums).unionByName(df.agg(*sums).select(F.lit("all").alias("category"), "n", "mean", "median", "max"))


def shares(df: DataFrame, category: str) -> DataFrame:
    """category, n, percent of all rows: the form of the spike-in, exclusion and chimeric
    reports."""
    c = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("__total"))
    return c.crossJoin(F.broadcast(total)).select(category, "n", (100.0 * F.col("n") / F.col("__total")).alias("percent"))


def spikein_votes(seq: Column, spikein: list[str], genomic: list[str], least: int = 2) -> Column:
    """struct<spikein, genomic, kind>: how many cores of either list a read holds; a list
    with at least ``least`` wins over one with fewer, else the larger."""
    hits = lambda cores: sum((F.contains(seq, F.lit(c)).cast("long") for c in cores), F.lit(0).cast("long"))
    x, y = hits(spikein), hits(genomic)
    kind = F.when((x >= least) & (y < least), "spikein").when((x < least) & (y >= least), "genomic").when((x < least) & (y < least), "none").when(x > y, "spikein").when(y > x, "genomic").otherwise("ambiguous")
    return F.struct(x.alias("spikein"), y.alias("genomic"), kind.alias("kind"))


def spikein_signature(df: DataFrame, seq: str, anchor: str, size: int = 12) -> DataFrame:
    """The most frequent ``size`` bases behind an anchor, with their support (ties: the first)."""
    hit = df.select(F.explode(F.regexp_extract_all(seq, F.lit(f"{anchor}([ACGT]{{{size}}})"), F.lit(1))).alias("tail"))
    return hit.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tail").limit(1)


def complete_variants(variants: DataFrame) -> DataFrame:
    """Rows that are neither sub-variants nor filtered; nulls count as false, and columns
    that are not there do not apply."""
    for flag in ("is_sub_variant", "is_filtered"):
        if flag in variants.columns:
            variants = variants.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return variants


def with_trim(reads: DataFrame, trim: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads with their trim record (tail length, adapter, trimmed bases and qualities); reads
    without one pass with nulls."""
    return reads.join(trim.dropDuplicates([key]), key, "left")


def restored(reads: DataFrame) -> DataFrame:
    """Reads (seq, cigar, strand, and trimmed_seq of with_trim()) with the trimmed bases put
    back at the 3' end as a soft clip, in genome orientation."""
    given = F.coalesce("trimmed_seq", F.lit(""))
    tail = F.when(F.col("strand") == "+", given).otherwise(S.revcomp(given))
    n = F.length(tail)
    at_end = F.regexp_extract("cigar", "([0-9]+)S$", 1)
    at_start = F.regexp_extract("cigar", "^([0-9]+)S", 1)
    plus = F.concat(F.regexp_replace("cigar", "[0-9]+S$", ""), (n + F.coalesce(at_end.try_cast("int"), F.lit(0))).cast("string"), F.lit("S"))
    minus = F.concat((n + F.coalesce(at_start.try_cast("int"), F.lit(0))).cast("string"), F.lit("S"), F.regexp_replace("cigar", "^[0-9]+S", ""))
    right = F.col("strand") == "+"
    return reads.withColumns({"seq": F.when(right, F.concat("seq", tail)).otherwise(F.concat(tail, F.col("seq"))), "cigar": F.when(n == 0, F.col("cigar")).when(right, plus).otherwise(minus)})


def nearest_site(positions: DataFrame, sites: DataFrame, keys: list[str], row_id: list[str], reach: int = 50) -> DataFrame:
    """positions (position) with the nearest site (site) of their keys within reach, and
    distance (position less site); the lower site wins ties, nulls where none is near."""
    return nearest_bounded(positions, sites, keys, "position", "site", -reach, reach, row_id=row_id)


def truth_cascade(ends: DataFrame, known: DataFrame, signal: DataFrame, annotation: DataFrame, keys: list[str], row_id: list[str], near: int = 10, least: float = 0.5, far: int = 50) -> DataFrame:
    """ends (position) with truth and source: a known position (known: site) at the place
    itself or at the lowest offset within near; else the strongest signal (site, value) of
    at least ``least`` within near, ties to the lowest; else the nearest annotated end (site)
    within far."""
    band = lambda df, reach, extra: _band(ends, df, keys, reach, extra)
    first = band(known, near, []).groupBy(*row_id).agg(F.min(F.struct(F.col("site") != F.col("position"), "site"))["site"].alias("k"))
    second = band(signal.where(F.col("value") >= least), near, ["value"]).groupBy(*row_id).agg(F.min(F.struct(-F.col("value"), "site"))["site"].alias("s"))
    third = band(annotation, far, []).groupBy(*row_id).agg(F.min(F.struct(F.abs(F.col("site") - F.col("position")), "site"))["site"].alias("a"))
    out = ends.join(first, row_id, "left").join(second, row_id, "left").join(third, row_id, "left")
    source = F.when(F.col("k") == F.col("position"), "known_exact").when(F.col("k").isNotNull(), "known_positions").when(F.col("s").isNotNull(), "signal").when(F.col("a").isNotNull(), "annotation").otherwise("none")
    return out.withColumns({"source": source, "truth": F.coalesce("k", "s", "a")}).drop("k", "s", "a")


def _band(a: DataFrame, b: DataFrame, keys: list[str], reach: int, extra: list[str]) -> DataFrame:
    """Pairs of a (position) and b (site) of equal keys within reach, by an equi-join on bins."""
    left = a.withColumn("__bin", F.floor(F.col("position") / reach))
    right = b.select(*keys, "site", *extra).distinct().withColumn("__bin", F.explode(F.array(*[F.floor(F.col("site") / reach) + k for k in (-1, 0, 1)])))
    return left.join(right, [*keys, "__bin"]).where(F.abs(F.col("site") - F.col("position")) <= reach).drop("__bin")


def splice_boundary(reads: DataFrame, sites: DataFrame, tolerance: int = 5, least_clip: int = 1) -> DataFrame:
    """reads: read_id, chrom, strand, boundary, clip; sites: chrom, strand, intron_id,
    three_ss, five_ss. Reads whose boundary lies within tolerance of a 3' splice site, with
    that intron's 5' splice site; one row for each read and site."""
    own = reads.where(F.col("clip") >= least_clip).withColumnRenamed("boundary", "position")
    found = _band(own, sites.withColumnRenamed("three_ss", "site"), ["chrom", "strand"], max(tolerance, 1), ["intron_id", "five_ss"])
    return found.where((F.abs(F.col("site") - F.col("position")) <= tolerance) & F.col("five_ss").isNotNull()).select("read_id", "chrom", "strand", F.col("position").alias("boundary"), "clip", "intron_id", F.col("site").alias("three_ss"), "five_ss")


def junction_proximity(errors: DataFrame, junctions: DataFrame, reach: int = 5) -> DataFrame:
    """read_id, near: the errors of a read (read_id, pos, in_homopolymer) within reach of either
    end of one of its junctions (read_id, j_start, j_end); one in a homopolymer counts a half,
    and an error near several ends once."""
    near = (F.abs(F.col("pos") - F.col("j_start")) <= reach) | (F.abs(F.col("pos") - F.col("j_end")) <= reach)
    hit = errors.join(junctions.select("read_id", "j_start", "j_end"), "read_id").where(near).select("read_id", "pos", "in_homopolymer").distinct()
    return hit.groupBy("read_id").agg(F.sum(F.when(F.col("in_homopolymer"), 0.5).otherwise(1.0)).alias("near"))


def mismatch_windows(errors: DataFrame, read: list[str], pos: str = "pos", reach: int = 15, least: int = 3, density: float = 0.2) -> DataFrame:
    """read, start, end of the greedy dense spans of each read's errors."""
    from ..functions.kernels import mismatch_clusters
    from .grouped import map_groups

    types = {f.name: f.dataType.simpleString() for f in errors.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in read) + ", start long, end long"
    rows = errors.select(*read, F.col(pos).cast("long").alias("__p")).distinct()
    return map_groups(rows, read, ["__p"], lambda group, c: [(*group, a, b) for a, b in mismatch_clusters(c["__p"].tolist(), reach, least, density)], schema)


def packed_rows(intervals: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """intervals of each of keys with row: the first line of a drawing in which each fits, in
    order of start."""
    from ..functions.kernels import pack_rows
    from .grouped import map_groups

    types = {f.name: f.dataType.simpleString() for f in intervals.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {start} long, {end} long, row int"

    def run(group: tuple, c: dict) -> list[tuple]:
        spans = list(zip(c[start].tolist(), c[end].tolist()))
        return [(*group, *s, r) for s, r in zip(spans, pack_rows(spans, gap))]

    return map_groups(intervals.select(*keys, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)), keys, [start, end], run, schema)


def read_context(reads: DataFrame, genome: DataFrame, size: int = 20) -> DataFrame:
    """reads (chrom, strand, three_prime, ...) with context: the genome's bases behind the 3'
    end along the strand; distinct ends meet the genome once."""
    keys = ["chrom", "strand", "three_prime"]
    sites = reads.select(*keys).distinct().join(genome.select("chrom", F.col("seq").alias("__g")), "chrom")
    known = sites.select(*keys, S.downstream(F.col("__g"), F.col("three_prime").cast("int"), F.col("strand"), size).alias("context"))
    return reads.join(known, keys, "left")


def read_mismatches(reads: DataFrame, genome: DataFrame) -> DataFrame:
    """read_id, chrom, strand, position, base, in_homopolymer: the aligned bases of reads
    (read_id, chrom, strand, start, cigar, seq) that differ from the genome, as
    ``genes.variant_frequency``, ``mismatch_windows`` and ``junction_proximity`` take them."""
    from ..functions.udfs import mismatches

    r = reads.withColumn("__end", S.reference_end(F.col("start"), S.cigar_ops(F.col("cigar"))))
    r = r.join(genome.select("chrom", F.upper("seq").alias("__all")), "chrom").withColumn("__g", S.window(F.col("__all"), F.col("start").cast("int"), F.col("__end").cast("int")))
    found = r.select("read_id", "chrom", "strand", F.explode(mismatches("cigar", "seq", "__g", "start")).alias("m"))
    return found.select("read_id", "chrom", "strand", "m.*")
