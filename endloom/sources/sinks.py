"""Writers: tables, position indexes, bedGraph, FASTA, statistics, provenance."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(column: str, a: str, b: str):
    return F.array_join(F.transform(column, lambda j: F.concat_ws("-", j[a].cast("string"), j[b].cast("string"))), ";")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """tsv, csv or parquet. In text, arrays of start-end pairs become s-e;s-e, booleans 0/1."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind.startswith("array<struct"):
            df = df.withColumn(f.name, _pairs(f.name, *(x.name for x in f.dataType.elementType.fields[:2])))
        elif kind.startswith("array"):
            df = df.withColumn(f.name, F.array_join(F.col(f.name).cast("array<string>"), ","))
        elif kind == "boolean":
            df = df.withColumn(f.name, F.col(f.name).cast("int"))
    df.write.mode("overwrite").csv(path, sep="\t" if fmt == "tsv" else ",", header=True, nullValue="")


def write_position_index(counts: DataFrame, path: str) -> None:
    """chrom, position, strand, count with six decimals, each file sorted and the files in
    order of (chrom, position)."""
    text = counts.select("chrom", "position", "strand", F.format_string("%.6f", F.col("count").cast("double")).alias("count"))
    text.repartitionByRange("chrom", "position").sortWithinPartitions("chrom", "position", "strand").write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def read_position_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="chrom string, position long, strand string, count double")


def bedgraph(counts: DataFrame, value: str, rpm: bool = False) -> DataFrame:
    """chrom, start, end, value: one row a position, 0-based half open; by strand."""
    v = F.col(value).cast("double")
    if rpm:
        total = counts.agg(F.sum(value).alias("__t"))
        counts, v = counts.crossJoin(F.broadcast(total)), F.col(value) * 1e6 / F.col("__t")
    return counts.select("strand", "chrom", F.col("position").alias("start"), (F.col("position") + 1).alias("end"), v.alias("value"))


def write_bedgraph(counts: DataFrame, path: str, value: str = "count", rpm: bool = False) -> None:
    """Folders strand=+ and strand=- of sorted bedGraph text."""
    rows = bedgraph(counts, value, rpm)
    rows.repartitionByRange("strand", "chrom", "start").sortWithinPartitions("strand", "chrom", "start").write.mode("overwrite").partitionBy("strand").csv(path, sep="\t")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_stats(row: DataFrame, path: str) -> None:
    """One row of counters as metric, value lines."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
    row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def provenance(spark: SparkSession, step: str, inputs: list[str], parameters: dict) -> DataFrame:
    """One row: step, time, parameters and the SHA-256 of each input's list of files (path,
    size, time of change), which Spark's reader lists."""
    digests = {}
    for path in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").cast("string"))
        h = hashlib.sha256()
        for r in files.orderBy("path").toLocalIterator():
            h.update("|".join(map(str, r)).encode())
        digests[path] = h.hexdigest()
    row = (step, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), json.dumps(parameters, sort_keys=True), json.dumps(digests, sort_keys=True))
    return spark.createDataFrame([row], "step string, written string, parameters string, inputs string")


def write_step(spark: SparkSession, out: str, step: str, inputs: list[str], parameters: dict, frames: Callable[[], dict[str, DataFrame]], fmt: str = "parquet", again: bool = False) -> bool:
    """Writes the frames of a step below out/step and, last, its provenance; a step whose
    inputs (paths, sizes, times) and parameters are those of its provenance is not run
    again. True if it ran. A step that failed has no provenance, so it runs anew."""
    now = provenance(spark, step, inputs, parameters).first()
    place = f"{out.rstrip('/')}/{step}"
    if not again:
        try:
            known = spark.read.json(f"{place}/_provenance.json").select("parameters", "inputs").first()
        except AnalysisException:
            known = None
        if known and (known["parameters"], known["inputs"]) == (now["parameters"], now["inputs"]):
            return False
    for name, df in frames().items():
        write_table(df, f"{place}/{name}", fmt)
    spark.createDataFrame([now]).coalesce(1).write.mode("overwrite").json(f"{place}/_provenance.json")
    return True


def by_region(spark: SparkSession, regions: list[tuple[str, int, int]], part: Callable[[tuple[str, int, int]], DataFrame], path: str) -> DataFrame:
    """part(region) for each of disjoint regions, each written to a folder of its own; regions
    that an earlier run wrote are not done again. The rows of all regions."""
    names = [f"region={c}_{a}_{b}" for c, a, b in regions]
    for region, name in zip(regions, names):
        try:
            spark.read.text(f"{path}/{name}/_SUCCESS").schema  # noqa: B018
        except AnalysisException:
            part(region).write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in names]).drop("region")


def summary_tables(results: DataFrame, alpha: float = 0.05, fold: float = 1.0) -> dict[str, DataFrame]:
    """up and down: significant features by falling effect; summary: how many of each kind."""
    from ..operators.evidence import result_tables

    told = result_tables(results, alpha, fold)
    kind = F.coalesce("direction", F.lit("none"))
    marked = results.join(told.select("feature", "direction"), "feature", "left")
    return {
        "up": told.where("direction = 'up'").orderBy(F.col("log2fc").desc(), "feature"),
        "down": told.where("direction = 'down'").orderBy("log2fc", "feature"),
        "summary": marked.groupBy(kind.alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.avg("log2fc").alias("mean_log2fc")),
    }
