"""Nascent-transcript signal: deconvolved regions, fit quality, refinement against reference
sites, and penalties of homopolymer errors.

Regions and reference windows are arrays of a bounded length, so each is a row; signal meets
them by hash joins on expanded positions, never by a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import deconvolved_region


def region_signal(regions: DataFrame, signal: DataFrame, keys: list[str], start: str, end: str, pos: str, value: str, most: int = 5000) -> DataFrame:
    """regions (half open, of at most ``most`` positions; longer ones are cut into such) with
    ``signal``, the array of summed values of their positions (0 where there is none)."""
    cuts = regions.where(F.col(end) > F.col(start)).select(*keys, F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(most))).alias("__s"), F.col(end).alias("__e"))
    parts = cuts.select(*keys, F.col("__s").alias(start), F.least(F.col("__s") + most, F.col("__e")).alias(end)).distinct()
    each = parts.withColumn(pos, F.explode(F.sequence(F.col(start), F.col(end) - 1)))
    summed = signal.groupBy(*keys, pos).agg(F.sum(value).cast("double").alias("__v"))
    hit = each.join(summed, [*keys, pos], "left")
    ordered = hit.groupBy(*keys, start, end).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce("__v", F.lit(0.0)).alias("v")))).alias("a"))
    return ordered.select(*keys, start, end, F.transform("a", lambda x: x["v"]).alias("signal"))


def deconvolve_regions(regions: DataFrame, psf: list[float], start: str, ridge: float = 0.01, least: float = 0.1) -> DataFrame:
    """regions (with ``signal``) with one row for each peak: position, height, fraction of the
    region's deconvolved signal, r_squared and rmse of the fit, recovery (predicted over
    observed), confidence and flag. A region without a peak keeps a row with nulls.

    confidence: the cube root (0.33) of fraction, place (1 at the region's last position,
    else less by a tenth for each position from the nearer end, 0.3 at least) and r_squared
    (0.1 at least); strong from 0.3, weak from 0.1, else marginal."""
    spread = regions.repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fit = spread.withColumn("__f", deconvolved_region("signal", F.array(*[F.lit(float(p)) for p in psf]), F.lit(float(ridge)), F.lit(float(least))))
    rows = fit.withColumn("__p", F.explode_outer("__f.peaks"))
    flag = F.when(F.col("__p.confidence") >= 0.3, "strong").when(F.col("__p.confidence") >= 0.1, "weak").when(F.col("__p").isNotNull(), "marginal")
    return rows.withColumns(
        {"position": F.col(start) + F.col("__p.offset"), "height": F.col("__p.height"), "fraction": F.col("__p.fraction"), "r_squared": F.col("__f.r_squared"), "rmse": F.col("__f.rmse"), "recovery": F.col("__f.recovery"), "confidence": F.col("__p.confidence"), "flag": flag}
    ).drop("__f", "__p", "signal")


def outside_regions(signal: DataFrame, regions: DataFrame, keys: list[str], pos: str, start: str, end: str) -> DataFrame:
    """Signal that no region holds: it is kept as it is beside the deconvolved peaks."""
    from .intervals import exclude

    return exclude(signal, regions, keys, pos, start, end)


def sampled(reads: DataFrame, peaks: DataFrame, region: list[str], read_id: str = "read_id", position: str = "position", fraction: str = "fraction") -> DataFrame:
    """Each read with one peak of its region, drawn by the peaks' shares. The draw is a hash of
    the read's name, so it does not depend on the order of reads."""
    ranked = peaks.where(F.col(fraction).isNotNull()).groupBy(*region).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(fraction).alias("f")))).alias("__peaks"))
    draw = F.pmod(F.xxhash64(read_id, F.lit(42)), F.lit(1 << 30)) / float(1 << 30)
    total = F.aggregate("__peaks", F.lit(0.0), lambda acc, x: acc + x["f"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("p"))
    pick = F.aggregate("__peaks", start, lambda acc, x: F.struct((acc["sum"] + x["f"]).alias("sum"), F.when(acc["p"].isNull() & (acc["sum"] + x["f"] > draw * total), x["p"].cast("long")).otherwise(acc["p"]).alias("p")))["p"]
    last = F.element_at("__peaks", -1)["p"].cast("long")
    joined = reads.join(ranked, region, "left")
    return joined.withColumn("assigned", F.when(F.size("__peaks") > 0, F.coalesce(pick, last))).drop("__peaks")


def refine_by_reference(positions: DataFrame, sites: DataFrame, keys: list[str], row_id: list[str], reach: int = 50, radius: int = 10, psf: list[float] | None = None, least: float = 0.1, proportional: bool = True) -> DataFrame:
    """positions (position) against the reference site (site, signal: an array of 2 * radius + 1
    values) that is nearest within reach: refined, fraction, height, shift and method.

    Peaks are values of at least ``least`` of the window's maximum, of the deconvolved window
    where a psf is given. proportional: a row for each peak; else the highest (the lowest of
    equals) with confidence high above 0.8 of the peaks' sum, medium above 0.5, else low.
    Without a site a position stays, of confidence low."""
    from .evidence import nearest_site

    near = nearest_site(positions, sites.select(*keys, "site", "signal"), keys, row_id, reach)
    if psf is not None:
        near = near.withColumn("signal", F.when(F.col("signal").isNotNull(), deconvolved_region("signal", F.array(*[F.lit(float(p)) for p in psf]), F.lit(0.01), F.lit(0.0))["solution"]))
    each = F.transform("signal", lambda v, i: F.struct((F.col("site") - radius + i).cast("long").alias("p"), v.alias("v")))
    peaks = F.filter(each, lambda x: x["v"] >= least * F.array_max("signal"))
    total = F.aggregate(peaks, F.lit(0.0), lambda acc, x: acc + x["v"])
    shown = F.transform(peaks, lambda x: F.struct(x["p"].alias("refined"), F.when(total > 0, x["v"] / total).otherwise(0.0).alias("fraction"), x["v"].alias("height")))
    none = F.array(F.struct(F.col("position").cast("long").alias("refined"), F.lit(1.0).alias("fraction"), F.lit(0.0).alias("height")))
    method = F.when(F.col("site").isNull(), "no_reference").otherwise("raw" if psf is None else "deconvolved")
    rows = near.withColumn("method", method).withColumn("__all", F.when(F.col("site").isNull(), none).otherwise(shown))
    if proportional:
        out = rows.withColumn("__x", F.explode("__all"))
        return out.select(*positions.columns, "__x.refined", "__x.fraction", "__x.height", (F.col("__x.refined") - F.col("position")).alias("shift"), "method")
    best = F.array_max(F.transform("__all", lambda x: F.struct(x["height"].alias("height"), (-x["refined"]).alias("neg"), x["fraction"].alias("fraction"))))
    out = rows.withColumn("__b", best)
    confidence = F.when(F.col("site").isNull(), "low").when(F.col("__b.fraction") > 0.8, "high").when(F.col("__b.fraction") > 0.5, "medium").otherwise("low")
    return out.select(*positions.columns, (-F.col("__b.neg")).alias("refined"), "__b.fraction", "__b.height", (-F.col("__b.neg") - F.col("position")).alias("shift"), confidence.alias("confidence"), "method")


def penalty_of(table: dict[str, dict[int, float]], length: Column, base: Column, default: float = 1.0) -> Column:
    """The penalty of an error in a homopolymer: by class of the base (AT, CG) and length; a
    length that is not listed takes that of the longest listed one. table: a list in the
    program and so of bounded size."""
    out = None
    for kind, rows in table.items():
        if not rows:
            continue
        known = F.create_map(*[F.lit(x) for pair in sorted(rows.items()) for x in pair])
        value = F.coalesce(F.element_at(known, length.cast("int")), F.lit(rows[max(rows)]))
        inside = F.upper(base).isin(*kind)
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def penalty_table(rows: DataFrame, op: str, least: int = 100) -> dict[str, dict[int, float]]:
    """A table for penalty_of from rows (op_type, hp_length, penalty_score, count_total,
    base_class or none); rows with fewer events are left out. Collects one number for each
    class and length: rows of lengths above 200 are left out, too."""
    kept = rows.where((F.substring(F.lower("op_type"), 1, 1) == op) & (F.col("count_total") >= least) & (F.col("hp_length") <= 200))
    out: dict[str, dict[int, float]] = {"AT": {}, "CG": {}}
    classed = "base_class" in rows.columns
    for r in kept.select("hp_length", "penalty_score", *(["base_class"] if classed else [])).distinct().collect():
        own = [r["base_class"]] if classed and r["base_class"] in out else list(out)
        for kind in own:
            out[kind][int(r["hp_length"])] = float(r["penalty_score"])
    return out
