"""One-dimensional clustering of sorted positions.

Fixed-gap clustering is gaps-and-islands; the order-dependent kinds (anchored windows, greedy
peaks, running centroids) work on distinct positions that are first cut at gaps which no
cluster can cross, so a group is a locus and never a chromosome.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .grouped import map_groups
from .intervals import carried, in_stretches


def position_counts(df: DataFrame, keys: list[str], weight: str | None = None, name: str = "count") -> DataFrame:
    """Rows (or the sum of weight, null counting 1) by keys."""
    value = F.count(F.lit(1)) if weight is None else F.sum(F.coalesce(F.col(weight), F.lit(1.0)))
    return df.groupBy(*keys).agg(value.alias(name))


def islands(df: DataFrame, keys: list[str], pos: str, gap: int, name: str) -> DataFrame:
    """Adds the number of the island of each row: a new one where the step to the row before
    is larger than gap. Windows run over stretches, so no task takes a whole chromosome."""
    w = Window.partitionBy(*keys, "__wide").orderBy(pos)
    step = F.when(F.col(pos) - F.lag(pos).over(w) > gap, 1).otherwise(0)
    rows = in_stretches(df, pos).withColumn("__step", step)
    before, so_far = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)
    seam = lambda w: (F.col("__first") - F.lag("__last").over(w) > gap).cast("int")
    base = lambda w: F.coalesce(F.sum("__steps").over(w.rowsBetween(*before)), F.lit(0)) + F.coalesce(F.sum("__seam").over(w.rowsBetween(*so_far)), F.lit(0))
    rows = carried(rows, keys, [F.min(pos).alias("__first"), F.max(pos).alias("__last"), F.sum("__step").alias("__steps")], {"__seam": seam}, {"__base": base})
    return rows.withColumn(name, F.col("__base") + F.sum("__step").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__step", "__base", "__wide")


def cluster_fixed(positions: DataFrame, keys: list[str], pos: str = "position", distance: int = 25, min_reads: int = 5) -> DataFrame:
    """keys, start, end, modal_position (median of the rows), n_positions (rows), cluster_id.

    positions: one row a read. Rows are first summed by position, so islands are found on
    distinct positions; the median is weighted by the number of rows. Ids follow (keys, start)
    among the clusters that are kept.
    """
    counted = positions.where(F.col(pos).isNotNull()).groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("c"))
    marked = islands(counted, keys, pos, distance, "__island")
    w = Window.partitionBy(*keys, "__island").orderBy(pos)
    marked = marked.withColumn("__before", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("__total", F.sum("c").over(Window.partitionBy(*keys, "__island")))
    # The two middle rows of an island lie at known places of the running count.
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    at = lambda place: F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("c")), F.col(pos)))
    found = marked.groupBy(*keys, "__island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.floor((at(low) + at(high)) / 2).cast("long").alias("modal_position"), F.sum("c").alias("n_positions"))
    found = found.where(F.col("n_positions") >= min_reads).drop("__island")
    return number(found, [*keys, "start"])


def number(clusters: DataFrame, order: list[str], name: str = "cluster_id", prefix: str = "cluster_") -> DataFrame:
    """Ids 0, 1, ... in the given order, whose last column is a position, padded to six digits.
    Ranks within stretches, then adds the counts of the stretches before: one task takes one
    row a stretch, none takes all clusters."""
    *keys, pos = order
    place = [*keys, "__wide"]
    rows = in_stretches(clusters, pos)
    totals = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    before = totals.select(*(F.col(k).alias(f"__of_{k}") for k in place), (F.sum("__n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"))
    on = F.lit(True)
    for k in place:
        on &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(pos)) - 1
    ranked = rows.withColumn("__rank", rank).join(before, on)
    return ranked.withColumn(name, F.concat(F.lit(prefix), F.lpad((F.col("__base") + F.col("__rank")).cast("string"), 6, "0"))).drop("__rank", "__base", "__wide", *(f"__of_{k}" for k in place))


def anchored(batches: Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]], window: int) -> Iterator[tuple]:
    """(group, start, end, mode, n) of clusters over batches of (names of the groups, group of
    each row, positions, counts), sorted by group and position; the cluster that is open at
    a batch's end goes on in the next."""
    held: list | None = None  # group, start, end, mode, its count, n
    for names, group, pos, count in batches:
        edges = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        i = 0
        while i < len(pos):
            stop, name = int(edges[np.searchsorted(edges, i, side="right")]), names[int(group[i])]
            if held and held[0] == name and pos[i] - held[1] <= window:
                start = held[1]
            else:
                if held:
                    yield (held[0], *held[1:4], held[5])
                start, held = int(pos[i]), None
            j = i + int(np.searchsorted(pos[i:stop], start + window, side="right"))
            top = int(np.argmax(count[i:j])) + i
            if held:
                held[2], held[5] = int(pos[j - 1]), held[5] + int(count[i:j].sum())
                if count[top] > held[4]:
                    held[3:5] = int(pos[top]), int(count[top])
            else:
                held = [name, start, int(pos[j - 1]), int(pos[top]), int(count[top]), int(count[i:j].sum())]
            i = j
    if held:
        yield (held[0], *held[1:4], held[5])


def cluster_anchored(positions: DataFrame, keys: list[str], pos: str = "position", window: int = 10) -> DataFrame:
    """Clusters whose members lie within ``window`` of their first position: keys, start, end,
    mode (most rows, lowest position), n_reads. A fold over the distinct positions of an
    island, at whose edges every cluster starts anew; batch by batch, so an island of any
    length is never held whole."""
    counted = positions.where(F.col(pos).isNotNull()).groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("c"))
    marked = islands(counted, keys, pos, window, "__island")
    n = len(keys)
    types = {f.name: f.dataType for f in positions.schema}
    schema = StructType([*(StructField(k, types[k]) for k in keys), *(StructField(c, LongType()) for c in ("start", "end", "mode", "n_reads"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def shown():
            for batch in batches:
                if batch.num_rows:
                    new = np.zeros(batch.num_rows, bool)
                    for i in range(n + 1):
                        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                        new[1:] |= codes[1:] != codes[:-1]
                    first = np.append(0, np.flatnonzero(new))
                    names = list(zip(*(batch.column(i).take(pa.array(first)).to_pylist() for i in range(n + 1))))
                    yield names, np.cumsum(new), batch.column(n + 1).to_numpy(), batch.column(n + 2).to_numpy()

        rows: list[tuple] = []
        for name, *values in anchored(shown(), window):
            rows.append((*name[:n], *values))
            if len(rows) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    ordered = marked.select(*keys, "__island", F.col(pos).cast("long").alias("__p"), F.col("c").alias("__c"))
    return ordered.repartition(*keys, "__island").sortWithinPartitions(*keys, "__island", "__p").mapInArrow(run, schema)


def greedy_peaks(pos: np.ndarray, count: np.ndarray, min_sep: int) -> list[int]:
    """Indices of peaks by count, largest first (ties: higher position), at least min_sep
    from every peak before; in order of position."""
    taken: list[int] = []  # positions, ascending
    chosen: list[int] = []
    for i in np.lexsort((-pos, -count)).tolist():
        p = int(pos[i])
        at = bisect_left(taken, p)
        if (at == 0 or p - taken[at - 1] >= min_sep) and (at == len(taken) or taken[at] - p >= min_sep):
            taken.insert(at, p)
            chosen.append(i)
    return sorted(chosen)


def adaptive_bounds(pos: np.ndarray, count: np.ndarray, peaks: list[int], radius: int) -> list[tuple[int, int]]:
    """Closed bounds of each peak: half-way to the valley to its neighbours, at most radius."""
    out = []
    valleys = []
    for a, b in zip(peaks, peaks[1:]):
        between = np.arange(a + 1, b)
        valleys.append(int(pos[between[np.argmin(count[between])]]) if len(between) else (int(pos[a]) + int(pos[b])) // 2)
    for k, i in enumerate(peaks):
        p = int(pos[i])
        low = p - radius if k == 0 else max((valleys[k - 1] + p) // 2, p - radius)
        high = p + radius if k == len(peaks) - 1 else min((p + valleys[k]) // 2, p + radius)
        out.append((low, high))
    return out


def cluster_adaptive(positions: DataFrame, keys: list[str], pos: str = "position", min_sep: int = 5, radius: int = 10, min_reads: int = 5) -> DataFrame:
    """keys, start, end (bounds), modal_position, total_reads, cluster_width by greedy peaks
    with valleys between. Positions more than 2 * radius apart never share a cluster."""
    counted = positions.where(F.col(pos).isNotNull()).groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("c"))
    marked = islands(counted, keys, pos, 2 * radius + min_sep, "__island")

    def run(group: tuple, columns: dict[str, np.ndarray]) -> list[tuple]:
        p, c = columns[pos], columns["c"]
        rows = []
        peaks = greedy_peaks(p, c, min_sep)
        for i, (low, high) in zip(peaks, adaptive_bounds(p, c, peaks, radius)):
            reads = int(c[(p >= low) & (p <= high)].sum())
            if reads >= min_reads:
                rows.append((*group[:-1], low, high, int(p[i]), reads, high - low + 1))
        return rows

    types = {f.name: f.dataType.simpleString() for f in positions.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", start long, end long, modal_position long, total_reads long, cluster_width long"
    return map_groups(marked, [*keys, "__island"], [pos], run, schema)


def centroid_groups(starts: np.ndarray, ends: np.ndarray, tolerance: int) -> np.ndarray:
    """Greedy grouping in order of ascending starts: a pair joins the first group whose running means are both
    within tolerance, else it founds one."""
    sums: list[list[float]] = []
    live: list[int] = []  # groups that a later start may still join
    out = np.zeros(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        live = [g for g in live if s - sums[g][0] / sums[g][2] <= tolerance]
        for g in live:
            a, b, n = sums[g]
            if abs(s - a / n) <= tolerance and abs(e - b / n) <= tolerance:
                sums[g] = [a + s, b + e, n + 1]
                out[i] = g
                break
        else:
            out[i] = len(sums)
            live.append(len(sums))
            sums.append([float(s), float(e), 1])
    return out


def centroid_dedup(junctions: DataFrame, keys: list[str], start: str, end: str, tolerance: int = 5) -> DataFrame:
    """keys, start, end (medians of the group), n. Junctions whose starts are further apart
    than the tolerance from all others are handled apart."""
    marked = islands(junctions, keys, start, 2 * tolerance, "__island")

    def run(group: tuple, columns: dict[str, np.ndarray]) -> list[tuple]:
        a, b = columns[start], columns[end]
        g = centroid_groups(a, b, tolerance)
        return [(*group[:-1], int(np.median(a[g == k])), int(np.median(b[g == k])), int((g == k).sum())) for k in range(int(g.max()) + 1)]

    types = {f.name: f.dataType.simpleString() for f in junctions.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {start} long, {end} long, n long"
    return map_groups(marked.select(*keys, "__island", start, end), [*keys, "__island"], [start, end], run, schema)


def count_matrix(assigned: DataFrame, clusters: DataFrame, samples: DataFrame, cluster: str = "cluster_id", sample: str = "sample", weight: str = "weight") -> DataFrame:
    """Long form: every cluster with every sample, zero where nothing was seen. The samples
    are those of a study: a list whose size is checked before it meets the clusters."""
    n = samples.select(sample).distinct().count()
    if n > 100_000:
        raise ValueError("too many samples for a dense matrix; use the sparse sums")
    names = samples.select(sample).distinct().agg(F.array_sort(F.collect_set(sample)).alias("__s"))
    grid = clusters.select(cluster).distinct().crossJoin(F.broadcast(names)).select(cluster, F.explode("__s").alias(sample))
    sums = assigned.groupBy(cluster, sample).agg(F.sum(weight).alias("total"))
    return grid.join(sums, [cluster, sample], "left").select(cluster, sample, F.coalesce("total", F.lit(0.0)).alias("total"))


def wide_matrix(long: DataFrame, cluster: str, sample: str, names: list[str], value: str = "total") -> DataFrame:
    return long.groupBy(cluster).pivot(sample, names).agg(F.sum(value))


