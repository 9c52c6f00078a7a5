"""The commands: python -m endloom COMMAND ... writes tables below --out.

Each command reads its inputs by Spark's readers (any store that the cluster can open), runs
one function of ``plans.commands`` or of the operators, and writes its frames with their
provenance; a step whose inputs and parameters have not changed is not run again.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .operators import consensus, correction, evidence, genes, netseq
from .plans import commands
from .sources import alignments, annotation, references, sinks

KEYS = ["chrom", "strand"]
Frames = dict[str, DataFrame]


def _reads(spark: SparkSession, path: str) -> DataFrame:
    """Primary alignments with ends, under the names that the operators use."""
    found = alignments.read_table(alignments.primary(references.read_reads(spark, path)))
    return found.withColumnRenamed("name", "read_id")


def _genome(spark: SparkSession, path: str) -> DataFrame:
    return annotation.read_fasta(spark, path)


def extract(spark: SparkSession, a: argparse.Namespace) -> Frames:
    region = None
    if a.region:
        chrom, span = a.region.rsplit(":", 1)
        region = (chrom, *(int(x) for x in span.replace(",", "").split("-")))
    kept = alignments.extract(_reads(spark, a.input), region, a.min_mapq, a.min_length, a.strand, a.spliced_only)
    return {"reads": kept.drop("ops", "seq", "quals", "tags", "clips").withColumn("n_junctions", F.size("junctions"))}


def correct(spark: SparkSession, a: argparse.Namespace) -> Frames:
    reads, genome = _reads(spark, a.input), _genome(spark, a.genome)
    walked = correction.walk_back_ends(reads, genome).select("read_id", *KEYS, "start", "cigar", "seq", "end", "five_prime", "mapq", "flag", F.col("three_prime").alias("mapped"), F.col("corrected").alias("three_prime"))
    fixed = commands.correct(walked, genome)
    ends = fixed.select("read_id", *KEYS, F.col("mapped").alias("original_3prime"), "corrected_3prime", "five_prime", F.col("start").alias("alignment_start"), F.col("end").alias("alignment_end"), F.col("ambiguity.lo").alias("ambiguity_min"), F.col("ambiguity.hi").alias("ambiguity_max"), "mapq", "confidence", "qc_flags", "fraction")
    moved = F.abs(F.col("corrected_3prime") - F.col("original_3prime"))
    stats = genes.qc_stats(ends.select(F.lit(True).alias("is_primary"), (F.col("ambiguity_max") > F.col("ambiguity_min")).alias("ambiguous"), (moved > 0).alias("corrected"), moved.alias("shift")))
    return {"corrected_3ends": ends, "stats": stats, "position_index": ends.groupBy(*KEYS, F.col("corrected_3prime").alias("position")).agg(F.sum("fraction").alias("count"))}


def write_corrected_bam(spark: SparkSession, a: argparse.Namespace) -> Frames:
    records = references.read_reads(spark, a.input)
    ends = spark.read.parquet(a.ends).select("read_id", F.col("corrected_3prime").alias("corrected"))
    header, _ = alignments.bam_references(alignments.files_of(a.input, ".bam")[0][0])
    alignments.write_bam(correction.corrected_records(records, ends), f"{a.out.rstrip('/')}/corrected.bam", header)
    return {}


def _ends(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Ends of the samples of a manifest, or of one table."""
    if a.manifest:
        parts = None
        for row in annotation.read_manifest(spark, a.manifest).limit(100_000).toLocalIterator():
            one = _end_table(spark, row["path"]).withColumn("sample", F.lit(row["sample_id"]))
            parts = one if parts is None else parts.unionByName(one)
        return parts
    t = _end_table(spark, a.input)
    return t if "sample" in t.columns else t.withColumn("sample", F.lit("sample"))


def _end_table(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.parquet(path) if not path.endswith((".tsv", ".tsv.gz")) else spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    t = annotation.resolve_columns(t, annotation.ALIASES)
    weight = F.coalesce(F.col("fraction").cast("double"), F.lit(1.0)) if "fraction" in t.columns else F.lit(1.0)
    return t.select(*KEYS, F.col("position").cast("long").alias("position"), weight.alias("fraction"), *(["sample"] if "sample" in t.columns else []))


def _genes(spark: SparkSession, path: str) -> DataFrame:
    g = annotation.read_genes(spark, path)
    return g.select(*KEYS, "gene_id", F.when(F.col("strand") == "+", F.col("end") - 1).otherwise(F.col("start")).alias("gene_3prime"))


def analyze(spark: SparkSession, a: argparse.Namespace) -> Frames:
    return commands.analyze(_ends(spark, a), _genes(spark, a.annotation), a.distance, a.min_reads)


def aggregate(spark: SparkSession, a: argparse.Namespace) -> Frames:
    reads = _reads(spark, a.input).withColumn("sample", F.lit("sample"))
    length = F.col("end") - F.col("start")
    three = reads.select(*KEYS, F.col("three_prime").alias("position"), F.col("five_prime").alias("other"), length.alias("length"))
    five = reads.select(*KEYS, F.col("five_prime").alias("position"), F.col("three_prime").alias("other"), length.alias("length"))
    genome = _genome(spark, a.genome) if a.genome else None
    return {"three_prime": commands.aggregate_ends(three, a.window), "five_prime": commands.aggregate_ends(five, a.window), "junctions": commands.aggregate_junctions(reads.withColumnRenamed("start", "position"), genome, a.min_reads)}


def choose(spark: SparkSession, a: argparse.Namespace) -> Frames:
    """The winner of each read among corrected-end tables of several aligners (NAME=PATH)."""
    parts = None
    for item in a.inputs:
        name, path = item.split("=", 1)
        one = spark.read.parquet(path).withColumn("aligner", F.lit(name))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    t = parts.withColumns({"three_prime": F.col("corrected_3prime"), "rescued": F.lit(False), "span": F.col("alignment_end") - F.col("alignment_start"), "n_junctions": F.lit(0).cast("long")})
    won = consensus.winners(consensus.agreement(t, ["read_id"], "three_prime"), ["read_id"])
    return {"consensus": won.drop("three_prime", "rescued", "span"), "aligners": evidence.shares(won, "aligner")}


def validate(spark: SparkSession, a: argparse.Namespace) -> Frames:
    ends = spark.read.parquet(a.input).withColumnsRenamed({"original_3prime": "three_prime"})
    ends = ends if "correction" in ends.columns else ends.withColumn("correction", F.when(F.col("three_prime") != F.col("corrected_3prime"), "moved").otherwise("none"))
    truth = references.read_truth(spark, a.truth).withColumnRenamed("site", "position")
    return {"validation": commands.validate(ends, truth, a.reach)}


def export(spark: SparkSession, a: argparse.Namespace) -> Frames:
    counts = _end_table(spark, a.input).groupBy(*KEYS, "position").agg(F.sum("fraction").alias("count"))
    sinks.write_bedgraph(counts, f"{a.out.rstrip('/')}/bedgraph", "count", a.rpm)
    sinks.write_position_index(counts, f"{a.out.rstrip('/')}/position_index")
    return {}


def trim(spark: SparkSession, a: argparse.Namespace) -> Frames:
    reads = references.read_reads(spark, a.input).select(F.col("name").alias("read_id"), "seq", "quals").withColumn("t", S.tail_adapter(F.col("seq")))
    n = F.col("t.tail") + F.col("t.adapter")
    cut = (F.col("t.tail") > 0) & (n < F.length("seq"))
    kept = F.when(cut, F.length("seq") - n).otherwise(F.length("seq"))
    tail = lambda c: F.when(cut, F.substring(c, kept + 1, n)).otherwise(F.lit(""))
    scores = F.when(F.length(tail("quals")) > 0, F.transform(F.split(tail("quals"), ""), lambda q: F.ascii(q) - 33)).otherwise(F.expr("CAST(array() AS array<int>)"))
    record = reads.select("read_id", F.lit("+").alias("strand"), F.when(cut, F.col("t.tail")).otherwise(0).alias("polya_len"), F.when(cut, F.substring("seq", F.length("seq") - F.col("t.adapter") + 1, F.col("t.adapter"))).otherwise("").alias("adapter_seq"), F.col("t.pass").alias("adapter_pass"), F.when(cut, F.concat(F.lit("pt:i:"), F.col("t.tail").cast("string"))).otherwise("").alias("pt_tag"), tail("seq").alias("trimmed_seq"), scores.alias("trimmed_quals"))
    trimmed = reads.select("read_id", F.substring("seq", F.lit(1), kept).alias("seq"), F.substring("quals", F.lit(1), kept).alias("quals"))
    return {"trimmed": trimmed, "trim_metadata": record, "tails": evidence.category_summary(record, "polya_len", "adapter_pass")}


def restore(spark: SparkSession, a: argparse.Namespace) -> Frames:
    reads = _reads(spark, a.input).drop("ops", "junctions", "clips")
    back = evidence.restored(evidence.with_trim(reads, references.read_trim(spark, a.trim).drop("strand")))
    return {"restored": back.drop("tags")}


def train_tails(spark: SparkSession, a: argparse.Namespace) -> Frames:
    """A model of tails from the clipped ends of reads at control sites."""
    reads = _reads(spark, a.input)
    sites = references.read_control_sites(spark, a.sites).select(*KEYS, F.col("position").alias("three_prime")).distinct()
    clip = F.when(F.col("strand") == "+", F.substring("seq", F.length("seq") - F.col("clips.three") + 1, F.col("clips.three"))).otherwise(S.revcomp(F.substring("seq", F.lit(1), F.col("clips.three"))))
    tails = reads.join(sites, [*KEYS, "three_prime"], "left_semi").withColumn("tail", clip).where(F.length("tail") > 0)
    return {"model": genes.tail_training(tails.select(S.max_richness(F.col("tail")).alias("richness"), F.length("tail").alias("length")))}


def tag_tails(spark: SparkSession, a: argparse.Namespace) -> Frames:
    """Reads scored by a model of tails (one row)."""
    m = spark.read.parquet(a.model).first()
    reads = _reads(spark, a.input)
    clip = F.when(F.col("strand") == "+", F.substring("seq", F.length("seq") - F.col("clips.three") + 1, F.col("clips.three"))).otherwise(S.revcomp(F.substring("seq", F.lit(1), F.col("clips.three"))))
    scored = reads.select("read_id", *KEYS, "three_prime", clip.alias("tail")).withColumn("score", S.polya_score(F.col("tail"), threshold=m["threshold"], mean=m["mean_length"]))
    return {"tags": scored.withColumn("has_tail", F.col("score") > 0)}


def signal(spark: SparkSession, a: argparse.Namespace) -> Frames:
    """Ends refined by a nascent-transcript signal at reference sites."""
    ends = _end_table(spark, a.input).groupBy(*KEYS, "position").agg(F.sum("fraction").alias("count"))
    sites = references.read_site_signal(spark, a.reference)
    out = netseq.refine_by_reference(ends, sites, KEYS, [*KEYS, "position"], reach=a.reach)
    return {"refined": out, "positions": out.groupBy(*KEYS, F.col("refined").alias("position")).agg(F.sum(F.col("count") * F.col("fraction")).alias("count"))}


def prescan(spark: SparkSession, a: argparse.Namespace) -> Frames:
    """Processing regions, junction support and mismatch-free summaries of a file before work."""
    reads = _reads(spark, a.input)
    table = commands.aggregate_junctions(reads.withColumnRenamed("start", "position").withColumn("sample", F.lit("sample")))
    return {"regions": commands.processing_regions(reads.select("chrom", "start", "end")), "junctions": table, "summary": evidence.category_summary(reads.withColumn("length", F.col("end") - F.col("start")), "length", "strand")}


def split(spark: SparkSession, a: argparse.Namespace) -> Frames:
    reads = references.read_reads(spark, a.input).withColumnRenamed("name", "read_id")
    commands.split_reads(reads, a.chunks).drop("tags").write.mode("overwrite").partitionBy("chunk").parquet(f"{a.out.rstrip('/')}/chunks")
    return {}


def run_all(spark: SparkSession, a: argparse.Namespace) -> Frames:
    """correct, then analyze, of one file."""
    first = correct(spark, a)
    path = f"{a.out.rstrip('/')}/run-all/corrected"
    first["corrected_3ends"].write.mode("overwrite").parquet(path)
    a.input, a.manifest = path, None
    return {"stats": first["stats"], **analyze(spark, a)}


_IN = [("input", {})]
_GENOME = [("--genome", {"required": True})]
_CLUSTERS = [("--annotation", {"required": True}), ("--distance", {"type": int, "default": 25}), ("--min-reads", {"type": int, "default": 5})]
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], Frames], list]] = {
    "extract": (extract, [*_IN, ("--region", {}), ("--min-mapq", {"type": int, "default": 0}), ("--min-length", {"type": int, "default": 0}), ("--strand", {"choices": ["+", "-"]}), ("--spliced-only", {"action": "store_true"})]),
    "correct": (correct, [*_IN, *_GENOME]),
    "write-bam": (write_corrected_bam, [*_IN, ("--ends", {"required": True})]),
    "analyze": (analyze, [("input", {"nargs": "?"}), ("--manifest", {}), *_CLUSTERS]),
    "aggregate": (aggregate, [*_IN, ("--genome", {}), ("--window", {"type": int, "default": 10}), ("--min-reads", {"type": int, "default": 1})]),
    "consensus": (choose, [("inputs", {"nargs": "+"})]),
    "validate": (validate, [*_IN, ("--truth", {"required": True}), ("--reach", {"type": int, "default": 10})]),
    "export": (export, [*_IN, ("--rpm", {"action": "store_true"})]),
    "trim-polya": (trim, _IN),
    "restore-softclip": (restore, [*_IN, ("--trim", {"required": True})]),
    "train-polya": (train_tails, [*_IN, ("--sites", {"required": True})]),
    "tag-polya": (tag_tails, [*_IN, ("--model", {"required": True})]),
    "netseq": (signal, [*_IN, ("--reference", {"required": True}), ("--reach", {"type": int, "default": 50})]),
    "prescan": (prescan, _IN),
    "split": (split, [*_IN, ("--chunks", {"type": int, "default": 16})]),
    "run-all": (run_all, [*_IN, *_GENOME, *_CLUSTERS]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="endloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        p = sub.add_parser(name, help=(f.__doc__ or name).split("\n")[0])
        for flag, kind in options:
            p.add_argument(flag, **kind)
        p.add_argument("--out", required=True)
        p.add_argument("--format", choices=["parquet", "tsv", "csv"], default="parquet")
        p.add_argument("--again", action="store_true", help="run though nothing has changed")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> bool:
    """True if the command ran, False if nothing had changed since it last did."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"endloom {a.command}").getOrCreate()
    given = {k: v for k, v in vars(a).items() if k not in ("out", "again", "command")}
    inputs = [x.split("=", 1)[-1] for k in ("input", "inputs", "genome", "annotation", "manifest", "truth", "ends", "trim", "sites", "model", "reference") for v in [given.get(k)] if v for x in (v if isinstance(v, list) else [v])]
    return sinks.write_step(spark, a.out, a.command, inputs, given, lambda: COMMANDS[a.command][0](spark, a), a.format, a.again)


if __name__ == "__main__":
    main()
