"""Interval and nearest joins.

Every join here is an equi-join on keys and a bin, with the range as a residual predicate:
intervals are repeated once for each bin that they touch, so no side is ever crossed with
the other. Bin widths are parameters; an interval much longer than a bin costs rows, not
correctness. Skewed bins are split by adaptive execution, as both sides are plain shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BIN = 4096
#: Positions of a stretch whose rows one window takes; stretches are stitched by one row each.
WIDE = 1 << 20


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bins touched by the closed interval."""
    return F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor(end / width), F.floor(start / width))))


def in_stretches(df: DataFrame, pos: str) -> DataFrame:
    """Adds __wide, the stretch of WIDE positions of each row: what runs over a whole
    chromosome is found within stretches and carried between them by ``carried``."""
    return df.withColumn("__wide", F.floor(F.col(pos) / WIDE))


def carried(df: DataFrame, keys: list[str], sums: list[Column], *levels: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Adds to each row of a stretch what the last of levels gives for it: windows over the one
    row of ``sums`` of each stretch of the keys; a level may use the columns of those before.
    Null keys are a group like any other."""
    w = Window.partitionBy(*keys).orderBy("__wide")
    rows = df.groupBy(*keys, "__wide").agg(*sums)
    for level in levels:
        rows = rows.select("*", *(f(w).alias(name) for name, f in level.items()))
    rows = rows.select(*(F.col(k).alias(f"__of_{k}") for k in [*keys, "__wide"]), *levels[-1])
    on = F.lit(True)
    for k in [*keys, "__wide"]:
        on &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return df.join(rows, on).drop(*[f"__of_{k}" for k in [*keys, "__wide"]])


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, half_open: bool = False, how: str = "inner", width: int = BIN) -> DataFrame:
    """points joined to the intervals that hold them; interval columns keep their names, so
    they must not clash with those of points (beyond keys). how: inner, left, left_semi or left_anti.
    Null points and bounds match nothing."""
    left = points.withColumn("__bin", F.floor(F.col(point) / width))
    right = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__bin", _bins(F.col(start), F.col(end), width))
    upper = F.col(point) < F.col(end) if half_open else F.col(point) <= F.col(end)
    renamed = {k: f"__{k}" for k in [*keys, "__bin"]}
    right = right.withColumnsRenamed(renamed)
    on = (F.col(point) >= F.col(start)) & upper
    for k, v in renamed.items():
        on &= F.col(k) == F.col(v)
    return left.join(right, on, how).drop("__bin", *renamed.values())


def first_containing(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, id_col: str, row_id: list[str], how: str = "left") -> DataFrame:
    """Each row of points once, with the containing interval of lowest start, then id."""
    hits = point_in_interval(points, intervals, keys, point, start, end, how=how)
    w = Window.partitionBy(*row_id).orderBy(F.col(start).asc_nulls_last(), F.col(id_col))
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_bounds: tuple[str, str], b_bounds: tuple[str, str], width: int = BIN) -> DataFrame:
    """All pairs of half-open intervals that overlap, with overlap_bp. A pair is found in
    the bin of the larger of the two starts only, so it comes once."""
    (s1, e1), (s2, e2) = a_bounds, b_bounds
    left = a.where(F.col(e1) > F.col(s1)).withColumn("__bin", _bins(F.col(s1), F.col(e1) - 1, width))
    right = b.where(F.col(e2) > F.col(s2)).withColumn("__bin", _bins(F.col(s2), F.col(e2) - 1, width)).withColumnsRenamed({k: f"__{k}" for k in [*keys, "__bin"]})
    on = (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1)) & (F.col("__bin") == F.floor(F.greatest(s1, s2) / width))
    for k in [*keys, "__bin"]:
        on &= F.col(k) == F.col(f"__{k}")
    overlap = F.least(e1, e2) - F.greatest(s1, s2)
    return left.join(right, on).drop("__bin", *[f"__{k}" for k in [*keys, "__bin"]]).withColumn("overlap_bp", overlap)


def nearest_bounded(a: DataFrame, b: DataFrame, keys: list[str], a_pos: str, b_pos: str, low: int, high: int, sign: Column | None = None, tie: str | None = None, row_id: list[str] = ()) -> DataFrame:
    """Left join of each row of a with the row of b of least distance within [low, high].

    distance = (a_pos - b_pos) * sign. Ties go to the smaller b_pos, then to the smaller tie
    column. row_id names the columns that identify a row of a.
    """
    reach = max(abs(low), abs(high), 1)
    left = a.withColumn("__bin", F.floor(F.col(a_pos) / reach))
    right = b.withColumn("__bin", F.explode(F.array(*[F.floor(F.col(b_pos) / reach) + k for k in (-1, 0, 1)]))).withColumnsRenamed({k: f"__{k}" for k in [*keys, "__bin"]})
    distance = (F.col(a_pos) - F.col(b_pos)) * (sign if sign is not None else F.lit(1))
    on = distance.between(low, high)
    for k in [*keys, "__bin"]:
        on &= F.col(k) == F.col(f"__{k}")
    joined = left.join(right, on, "left").drop("__bin", *[f"__{k}" for k in [*keys, "__bin"]]).withColumn("distance", distance)
    w = Window.partitionBy(*row_id).orderBy(F.abs("distance").asc_nulls_last(), F.col(b_pos), *([F.col(tie)] if tie else []))
    return joined.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def band_match(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str], tolerance: int, row_id: list[str], total: int | None = None) -> DataFrame:
    """Each row of a with the closest row of b whose two ends lie within tolerance each (and
    within ``total`` together, if given), else nulls. Ties: lower b start, then b end.
    Adds d_start, d_end (a minus b)."""
    (s1, e1), (s2, e2) = a_ends, b_ends
    width = max(tolerance, 1)
    left = a.withColumn("__bin", F.floor(F.col(s1) / width))
    right = b.withColumn("__bin", F.explode(F.array(*[F.floor(F.col(s2) / width) + k for k in (-1, 0, 1)]))).withColumnsRenamed({k: f"__{k}" for k in [*keys, "__bin"]})
    d_start, d_end = F.col(s1) - F.col(s2), F.col(e1) - F.col(e2)
    on = (F.abs(d_start) <= tolerance) & (F.abs(d_end) <= tolerance)
    if total is not None:
        on &= F.abs(d_start) + F.abs(d_end) <= total
    for k in [*keys, "__bin"]:
        on &= F.col(k) == F.col(f"__{k}")
    joined = left.join(right, on, "left").drop("__bin", *[f"__{k}" for k in [*keys, "__bin"]]).withColumns({"d_start": d_start, "d_end": d_end})
    w = Window.partitionBy(*row_id).orderBy((F.abs("d_start") + F.abs("d_end")).asc_nulls_last(), F.col(s2), F.col(e2))
    return joined.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Union of intervals by key, joining those at most gap apart: keys, start, end, n."""
    rows = in_stretches(df.where(F.col(start).isNotNull() & F.col(end).isNotNull()), start)
    rows = carried(rows, keys, [F.max(end).alias("__e")], {"__reach": lambda w: F.max("__e").over(w.rowsBetween(*_BEFORE))})
    w = Window.partitionBy(*keys, "__wide").orderBy(start, end)
    seen = F.greatest(F.max(end).over(w.rowsBetween(*_BEFORE)), F.col("__reach"))
    rows = rows.withColumn("__new", F.coalesce((F.col(start) > seen + gap).cast("int"), F.lit(1)))
    rows = carried(rows, keys, [F.sum("__new").alias("__n")], {"__base": lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(*_BEFORE)), F.lit(0))})
    # Of equal intervals only the first may be new (all, if they end before they start); the join may have changed their order.
    w = w.orderBy(start, end, F.col("__new").desc())
    marked = rows.withColumn("__g", F.col("__base") + F.sum("__new").over(w.rowsBetween(*_SO_FAR)))
    return marked.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__g")


def gaps(merged: DataFrame, keys: list[str], start: str, end: str, least: int) -> DataFrame:
    """Stretches of at least so many positions between merged intervals: keys, gap_start, gap_end."""
    rows = carried(in_stretches(merged, start), keys, [F.min(start).alias("__first")], {"__next": lambda w: F.lead("__first").over(w)})
    w = Window.partitionBy(*keys, "__wide").orderBy(start)
    after = rows.withColumn("gap_end", F.coalesce(F.lead(start).over(w), F.col("__next"))).withColumn("gap_start", F.col(end))
    return after.where(F.col("gap_end") - F.col("gap_start") >= least).select(*keys, "gap_start", "gap_end")


def depth(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Coverage as runs: keys, start, end, depth, from +1/-1 events and a running sum; a
    position is never expanded to a row."""
    events = df.select(*keys, F.col(start).alias("pos"), F.lit(1).alias("d")).unionByName(df.select(*keys, F.col(end).alias("pos"), F.lit(-1).alias("d")))
    steps = in_stretches(events.groupBy(*keys, "pos").agg(F.sum("d").alias("d")), "pos")
    over = {"__next": lambda w: F.lead("__first").over(w), "__base": lambda w: F.coalesce(F.sum("__d").over(w.rowsBetween(*_BEFORE)), F.lit(0))}
    steps = carried(steps, keys, [F.min("pos").alias("__first"), F.sum("d").alias("__d")], over)
    w = Window.partitionBy(*keys, "__wide").orderBy("pos")
    runs = steps.select(*keys, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), F.col("__next")).alias("end"), (F.col("__base") + F.sum("d").over(w.rowsBetween(*_SO_FAR))).alias("depth"))
    return runs.where("depth > 0")


def exclude(df: DataFrame, regions: DataFrame, keys: list[str], pos: str, start: str, end: str) -> DataFrame:
    """Rows of df outside all half-open regions."""
    return point_in_interval(df, regions, keys, pos, start, end, half_open=True, how="left_anti")
