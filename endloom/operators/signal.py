"""Signal windows, peaks, proportional splits and metagene profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.udfs import nnls_deconvolve


def local_maxima(counts: DataFrame, keys: list[str], pos: str, value: str, share: float = 0.5) -> DataFrame:
    """Positions above both neighbours (rows, not gaps) and at least ``share`` of their key's
    maximum, with prominence: value less the larger of the least values on either side."""
    w = Window.partitionBy(*keys).orderBy(pos)
    left = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(value).over(w.rowsBetween(1, Window.unboundedFollowing))
    top = F.max(value).over(Window.partitionBy(*keys))
    m = counts.withColumns({"__l": F.lag(value).over(w), "__r": F.lead(value).over(w), "__min_l": left, "__min_r": right, "__top": top})
    peaks = m.where((F.col(value) > F.col("__l")) & (F.col(value) > F.col("__r")) & (F.col(value) >= share * F.col("__top")))
    return peaks.withColumn("prominence", F.col(value) - F.least("__min_l", "__min_r")).drop("__l", "__r", "__min_l", "__min_r", "__top")


def best_peak(peaks: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col("prominence").desc(), pos)
    return peaks.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def windows(sites: DataFrame, signal: DataFrame, keys: list[str], site: str, pos: str, value: str, radius: int) -> DataFrame:
    """sites with ``signal``, the array of values from site - radius to site + radius (0 where
    there is none). The window is expanded into offsets, so the join is a hash join."""
    each = sites.select(*keys, site).distinct().withColumn("__o", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    hit = each.withColumn(pos, F.col(site) + F.col("__o")).join(signal.select(*keys, pos, value), [*keys, pos], "left")
    ordered = hit.groupBy(*keys, site).agg(F.array_sort(F.collect_list(F.struct("__o", F.coalesce(value, F.lit(0)).cast("double").alias("v")))).alias("a"))
    return ordered.select(*keys, site, F.transform("a", lambda x: x["v"]).alias("signal"))


def refine(sites: DataFrame, keys: list[str], site: str, radius: int, psf: list[float]) -> DataFrame:
    """Rows of sites (with ``signal``) split over their deconvolved ends: refined, fraction
    (sums to 1 for each site) and confidence; a site without signal keeps its place."""
    # Rows are few but costly: a number of partitions keeps them apart.
    spread = sites.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = spread.withColumn("__d", nnls_deconvolve("signal", F.array(*[F.lit(float(p)) for p in psf])))
    none = F.array(F.struct(F.lit(radius).alias("offset"), F.lit(1.0).alias("share")))
    rows = split.withColumn("__e", F.explode(F.when(F.size("__d") > 0, F.col("__d")).otherwise(none)))
    confidence = F.when(F.size("__d") == 0, "none").when(F.col("__e.share") > 0.9, "high").when(F.col("__e.share") > 0.7, "medium").otherwise("split")
    return rows.select(*keys, site, (F.col(site) + F.col("__e.offset") - radius).alias("refined"), F.col("__e.share").alias("fraction"), confidence.alias("confidence"))


def metagene(loci: DataFrame, signal: DataFrame, keys: list[str], center: str, pos: str, value: str, radius: int, cap: float | None = None) -> DataFrame:
    """offset, mean, sem (population deviation over the root of n), n over loci; along the
    strand. cap: values above this percentile of the nonzero ones are cut to it."""
    each = loci.select(*keys, center).withColumn("offset", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    step = F.when(F.col("strand") == "+", F.col("offset")).otherwise(-F.col("offset"))
    hit = each.withColumn(pos, F.col(center) + step).join(signal.select(*keys, pos, value), [*keys, pos], "left").withColumn("v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    if cap is not None:
        # A filter on v would make the join an inner one, whose windows (taken for as small as loci) Spark may broadcast.
        limit = hit.agg(F.expr(f"percentile(if(v > 0, v, null), {cap})").alias("__cap"))
        hit = hit.crossJoin(F.broadcast(limit)).withColumn("v", F.least("v", "__cap"))
    return hit.groupBy("offset").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Mean without int(n * share) values from each tail."""
    w = Window.partitionBy(*keys)
    r = df.withColumns({"__k": F.row_number().over(w.orderBy(value)), "__n": F.count(F.lit(1)).over(w)})
    cut = F.floor(F.col("__n") * share)
    return r.where((F.col("__k") > cut) & (F.col("__k") <= F.col("__n") - cut)).groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"))


def replicate_sem(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def proportional_split(sites: DataFrame, unsure: DataFrame, keys: list[str], value: str, ambiguous: str) -> DataFrame:
    """sites with assigned: their value and, by its share among the sites of their keys, what
    is ambiguous there (unsure: keys, ambiguous)."""
    w = Window.partitionBy(*keys)
    joined = sites.withColumn("__total", F.sum(value).over(w)).join(unsure.select(*keys, ambiguous), keys, "left")
    return joined.withColumn("assigned", F.col(value) + F.coalesce(ambiguous, F.lit(0)) * F.col(value) / F.col("__total")).drop("__total", ambiguous)


def scaled_profile(loci: DataFrame, signal: DataFrame, keys: list[str], pos: str, value: str, upstream: int, downstream: int, width: int = 20, least: float = 0.0, normalise: bool = True) -> DataFrame:
    """column, mean, sem, n over loci (keys, start, end, both inclusive): the bases upstream, the
    body drawn out or together to ``width`` columns by linear interpolation, the bases
    downstream, along the strand (columns -upstream to width + downstream - 1).

    Loci with less signal than ``least`` in their columns go; normalise: each locus counts as
    shares of its own signal. A column is a weighted sum of at most two positions, so no
    locus, however long, is gathered."""
    locus = [*keys, "start", "end"]
    each = loci.select(*locus).distinct().where("end >= start").withColumn("__n", (F.col("end") - F.col("start") + 1).cast("long"))
    n = F.col("__n")
    cell = lambda column, place, weight: F.struct(column.cast("int").alias("column"), place.cast("long").alias("place"), weight.cast("double").alias("weight"))
    at = lambda o: o * (n - 1) / max(width - 1, 1)
    body = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda o: F.when(n == 1, F.array(cell(o, F.lit(0), F.lit(1 / width)))).otherwise(F.array(cell(o, F.floor(at(o)), 1 - (at(o) - F.floor(at(o)))), cell(o, F.least(F.floor(at(o)) + 1, n - 1), at(o) - F.floor(at(o))))))
    parts = [F.flatten(body)]
    if upstream:
        parts.append(F.transform(F.sequence(F.lit(-upstream), F.lit(-1)), lambda i: cell(i, i, F.lit(1.0))))
    if downstream:
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(downstream - 1)), lambda i: cell(i + width, n + i, F.lit(1.0))))
    cells = each.withColumn("__c", F.explode(F.concat(*parts)))
    place = F.when(F.col("strand") == "+", F.col("start") + F.col("__c.place")).otherwise(F.col("end") - F.col("__c.place"))
    summed = signal.groupBy(*keys, pos).agg(F.sum(value).cast("double").alias("__v"))
    hit = cells.withColumn(pos, place).join(summed, [*keys, pos], "left")
    columns = hit.groupBy(*locus, F.col("__c.column").alias("column")).agg(F.sum(F.col("__c.weight") * F.coalesce("__v", F.lit(0.0))).alias("v"))
    own = columns.withColumn("__t", F.sum("v").over(Window.partitionBy(*locus))).where(F.col("__t") >= least)
    if normalise:
        own = own.withColumn("v", F.when(F.col("__t") > 0, F.col("v") / F.col("__t")).otherwise(0.0))
    return own.groupBy("column").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n"))


def strand_check(loci: DataFrame, signal: DataFrame, keys: list[str], center: str, pos: str, value: str, radius: int, most: int = 2) -> DataFrame:
    """One row: the offset of the highest mean on either strand (the lowest of equals), and
    whether they differ by at most ``most``, as they should where coordinates are right."""
    peaks = []
    for strand, name in (("+", "plus"), ("-", "minus")):
        m = metagene(loci.where(F.col("strand") == strand), signal, keys, center, pos, value, radius)
        peaks.append(m.agg(F.max_by("offset", F.struct(F.col("mean"), -F.col("offset"))).alias(name)))
    return peaks[0].crossJoin(F.broadcast(peaks[1])).withColumn("agree", F.coalesce(F.abs(F.col("plus") - F.col("minus")) <= most, F.lit(True)))
