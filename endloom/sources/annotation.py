"""Readers of annotation, sequence and table formats, all by Spark's own text and CSV readers,
so any path that Spark can open will do. Coordinates become 0-based and half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.junctions import introns_from_exons

_GFF = "chrom string, source string, feature string, g_start long, g_end long, score string, strand string, phase string, attributes string"


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Renames the first alias that is there to each wanted name; a wanted name that is
    there already stays. Columns that resolve nothing stay as they are."""
    for name, options in aliases.items():
        if name not in df.columns:
            found = next((o for o in options if o in df.columns), None)
            if found is not None:
                df = df.withColumnRenamed(found, name)
    return df


# Names under which tables hold a sample or a corrected position.
ALIASES = {"position": ["corrected_position", "corrected_3prime"], "sample": ["sample_id", "sample_name", "replicate", "condition"]}


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of ends with its position and sample columns resolved."""
    return resolve_columns(spark.read.csv(path, sep="\t", header=True, inferSchema=True), ALIASES)


def _attribute(attributes: Column, name: str) -> Column:
    """The value of a GFF (k=v) or GTF (k "v") attribute; null if it is not there."""
    raw = F.regexp_extract(attributes, rf'(?:^|; ?){name}[ =]"?([^";]*)"?', 1)
    return F.when(raw != "", F.replace(F.replace(F.replace(raw, F.lit("%20"), F.lit(" ")), F.lit("%3B"), F.lit(";")), F.lit("%2C"), F.lit(",")))


def read_gff(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """GFF3 or GTF rows: chrom, feature, start, end, strand, attributes. Malformed rows (no
    coordinates) are left out."""
    g = spark.read.csv(path, sep="\t", schema=_GFF, comment="#").where("g_start IS NOT NULL AND g_end IS NOT NULL")
    g = g.where(F.col("feature") == feature) if feature else g
    return g.select("chrom", "feature", (F.col("g_start") - 1).alias("start"), F.col("g_end").alias("end"), "strand", "attributes")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, strand, gene_id, gene_name of gene rows."""
    g = read_gff(spark, path, "gene")
    a = F.col("attributes")
    gene_id = F.coalesce(_attribute(a, "ID"), _attribute(a, "gene_id"), F.concat_ws("_", "chrom", F.col("start").cast("string")))
    name = F.coalesce(_attribute(a, "gene"), _attribute(a, "gene_name"), _attribute(a, "Name"), gene_id)
    return g.select("chrom", "start", "end", "strand", gene_id.alias("gene_id"), name.alias("gene_name"))


def read_introns(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, intron_start, intron_end: intron rows, or gaps between the exons of a
    transcript where there are none."""
    g = read_gff(spark, path)
    given = g.where("feature = 'intron'").select("chrom", "strand", F.col("start").alias("intron_start"), F.col("end").alias("intron_end"))
    a = F.col("attributes")
    exons = g.where("feature = 'exon'").select("chrom", "strand", "start", "end", F.coalesce(_attribute(a, "transcript_id"), _attribute(a, "Parent")).alias("transcript")).where("transcript IS NOT NULL")
    return given.unionByName(introns_from_exons(exons, "transcript", ["chrom", "strand"], "start", "end")).distinct()


def transcript_ends(genes: DataFrame) -> DataFrame:
    """gene_id, tss and tes (both inclusive) along the strand."""
    plus = F.col("strand") == "+"
    return genes.select("chrom", "strand", "gene_id", F.when(plus, F.col("start")).otherwise(F.col("end") - 1).alias("tss"), F.when(plus, F.col("end") - 1).otherwise(F.col("start")).alias("tes"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand; missing columns are null, '.' strands too."""
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.size(cells) >= 3))
    get = lambda i: F.get(cells, F.lit(i))
    return lines.select(get(0).alias("chrom"), get(1).try_cast("long").alias("start"), get(2).try_cast("long").alias("end"), get(3).alias("name"), get(4).alias("score"), F.when(get(5).isin("+", "-"), get(5)).alias("strand"))


def loci_from_bed(bed: DataFrame, rule: str = "mid") -> DataFrame:
    """chrom, strand, center: start, end or mid of the interval along its strand."""
    plus = F.coalesce(F.col("strand"), F.lit("+")) == "+"
    first, last = F.col("start"), F.col("end") - 1
    center = {"start": F.when(plus, first).otherwise(last), "end": F.when(plus, last).otherwise(first), "mid": F.floor((first + last) / 2)}[rule]
    return bed.select("chrom", F.coalesce("strand", F.lit("+")).alias("strand"), center.alias("center"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq (upper case). Records are split by the reader at '>', so a record is a row
    and never a driver object."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(head.alias("chrom"), F.upper(body).alias("seq"))


def read_fastq(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """name, seq, quals of four-line records, and complete: whether seq and quals are of one
    length. Files are read in ranges of bytes, so one file takes many tasks; gzip files take
    one each."""
    from . import alignments

    alignments.register(spark)
    return spark.read.format("fastq").option("split", split or alignments.SPLIT).load(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    m = resolve_columns(spark.read.csv(path, sep="\t", header=True), {"sample_id": ["sample", "sample_name"], "path": ["file", "bam"]})
    missing = {"sample_id", "path"} - set(m.columns)
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(sorted(missing))}")
    return m


def read_go(spark: SparkSession, path: str) -> DataFrame:
    return resolve_columns(spark.read.csv(path, sep="\t", header=True), {"gene_id": ["gene", "GeneID"], "go_term": ["term", "GO_term"], "go_id": ["GO_ID", "GO"]})


def normalise_chromosomes(df: DataFrame, names: dict[str, str], column: str = "chrom") -> DataFrame:
    """Maps chromosome names by a table in the program; others stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    return df if table is None else df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))
