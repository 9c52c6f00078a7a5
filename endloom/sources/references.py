"""Reference tables: chromosome names, organisms, control and truth sites, loci, signals, trim
records. All by Spark's readers; what is listed here is fixed and small."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annotation

# The chromosomes of budding yeast in order, and the first of their accessions.
ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI".split()
REFSEQ_FIRST, REFSEQ_MITO = 1133, "ref|NC_001224|"
SGD_FIRST, SGD_LAST, SGD_MITO = 6935, "BK006934.2", "AJ011856.1"
MITO_NAMES = ["chrMito", "chrM", "chrMT", "Mito", "MT"]


def yeast_names(target: str = "ucsc") -> dict[str, str]:
    """Names of the chromosomes of budding yeast in every form -> their form in ``target``
    (ucsc: chrI; ncbi: ref|NC_001133|)."""
    out: dict[str, str] = {}
    for i, roman in enumerate(ROMAN):
        refseq = f"ref|NC_{REFSEQ_FIRST + i:06d}|"
        sgd = SGD_LAST if roman == "XVI" else f"BK{SGD_FIRST + i:06d}.2"
        for name in (f"chr{roman}", roman, refseq, sgd):
            out[name] = f"chr{roman}" if target == "ucsc" else refseq
    for name in (*MITO_NAMES, REFSEQ_MITO, SGD_MITO):
        out[name] = "chrMito" if target == "ucsc" else REFSEQ_MITO
    if target == "ucsc":  # names that begin with chr stay as they are
        out = {k: k if k.startswith("chr") else v for k, v in out.items()}
    return out


def normalise_yeast(df: DataFrame, target: str = "ucsc", column: str = "chrom") -> DataFrame:
    """Chromosome names in one form; names that are not known stay."""
    return df if target == "passthrough" else annotation.normalise_chromosomes(df, yeast_names(target), column)


def name_format(names: Iterable[str]) -> str:
    """The form of chromosome names: ncbi, ucsc, sgd or unknown."""
    for prefix, form in (("ref|NC_", "ncbi"), ("chr", "ucsc"), ("BK00", "sgd")):
        if any(n.startswith(prefix) for n in names):
            return form
    return "unknown"


def organism(sizes: dict[str, int]) -> str | None:
    """The organism whose genome has chromosomes of such names and sizes."""
    total, known = sum(sizes.values()), set(sizes)
    if 10_000_000 < total < 15_000_000 and len(known & {n for n in yeast_names() if not n.startswith(("ref", "BK", "AJ"))}) >= 10:
        return "saccharomyces_cerevisiae"
    if 2_500_000_000 < total < 3_500_000_000 and known & {"chr1", "chr2", "chr3", "chrX", "chrY"}:
        return "homo_sapiens"
    if 2_000_000_000 < total < 3_000_000_000 and known & {"chr1", "chr2", "chrX", "chrY"}:
        return "mus_musculus"
    return None


def genome_sizes(spark: SparkSession, path: str, most: int = 100_000) -> dict[str, int]:
    """Chromosome -> length from a FASTA index (.fai) or a FASTA file; at most so many."""
    if path.endswith(".fai"):
        rows = spark.read.csv(path, sep="\t", schema="chrom string, size long, a long, b long, c long").select("chrom", "size")
    else:
        rows = annotation.read_fasta(spark, path).select("chrom", F.length("seq").cast("long").alias("size"))
    return {r["chrom"]: r["size"] for r in rows.limit(most).collect()}


def input_type(path: str, head: bytes = b"") -> str:
    """The kind of a reads file by its name, or by its first bytes: fastq, bam, ubam (a BAM
    whose header names no reference), sam, paf or unknown."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".ubam"):
        return "ubam"
    for suffix, kind in ((".bam", "bam"), (".fastq", "fastq"), (".fq", "fastq"), (".sam", "sam"), (".paf", "paf")):
        if name.endswith(suffix):
            if kind == "bam" and not head:
                from .alignments import bam_references

                try:
                    return "bam" if bam_references(path)[0] else "ubam"
                except (OSError, ValueError):
                    return "bam"
            return kind
    if head[:4] == b"\x1f\x8b\x08\x04":
        return "bam"
    return "fastq" if head[:1] == b"@" and not head.startswith((b"@HD", b"@SQ", b"@PG")) else "sam" if head[:1] == b"@" else "unknown"


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of any kind that input_type() knows, by its reader."""
    from . import alignments

    kind = input_type(path)
    readers = {"fastq": annotation.read_fastq, "bam": alignments.read_bam, "ubam": alignments.read_bam, "sam": alignments.read_sam, "paf": alignments.read_paf}
    if kind not in readers:
        raise ValueError(f"{path}: no reader for such a file")
    return readers[kind](spark, path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    return df.toDF(*[c.strip().lower() for c in df.columns])


# Other names of the columns of site tables.
_SITE_NAMES = {"position": ["pos", "corrected_3prime", "corrected_position", "cpa"], "gene_name": ["gene", "name"], "a_count": ["downstream_a_count", "acount"], "chrom": ["chr", "chromosome"]}


def read_control_sites(spark: SparkSession, path: str) -> DataFrame:
    """chrom, position, strand, gene_name of sites without downstream As (where the table says);
    rows without a position are left out."""
    t = annotation.resolve_columns(_table(spark, path), _SITE_NAMES)
    t = t.withColumn("position", F.col("position").try_cast("long")).where("position IS NOT NULL")
    if "a_count" in t.columns:
        t = t.where(F.coalesce(F.col("a_count").try_cast("long"), F.lit(0)) <= 0)
    name = F.col("gene_name") if "gene_name" in t.columns else F.lit(None).cast("string")
    return t.select("chrom", "position", "strand", name.alias("gene_name"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, site of a table of known ends, distinct."""
    t = annotation.resolve_columns(_table(spark, path), _SITE_NAMES)
    return t.select("chrom", "strand", F.col("position").try_cast("long").alias("site")).where("site IS NOT NULL").distinct()


def annotated_ends(genes: DataFrame) -> DataFrame:
    """chrom, strand, site: the 3' ends of genes (chrom, strand, start, end)."""
    return annotation.transcript_ends(genes).select("chrom", "strand", F.col("tes").alias("site")).distinct()


def center_of(start: Column, end: Column, strand: Column, rule: str) -> Column:
    """The place of an interval (half open) along its strand: start or tss, end or tes, else
    the middle."""
    plus = F.coalesce(strand, F.lit("+")) != "-"
    if rule in ("start", "tss"):
        return F.when(plus, start).otherwise(end - 1)
    if rule in ("end", "tes"):
        return F.when(plus, end - 1).otherwise(start)
    return F.floor((start + end - 1) / 2).cast("long")


def loci_from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, center of a table of loci."""
    t = annotation.resolve_columns(_table(spark, path), {"center": ["position", "pos", "site"], "chrom": ["chr", "chromosome"]})
    strand = F.coalesce("strand", F.lit("+")) if "strand" in t.columns else F.lit("+")
    return t.select("chrom", strand.alias("strand"), F.col("center").try_cast("long").alias("center")).where("center IS NOT NULL")


def loci_from_gff(spark: SparkSession, path: str, feature: str = "gene", rule: str = "tss") -> DataFrame:
    g = annotation.read_gff(spark, path, feature)
    return g.select("chrom", "strand", center_of(F.col("start"), F.col("end"), F.col("strand"), rule).alias("center"))


def loci_from_motif(genome: DataFrame, motif: str, rule: str = "start") -> DataFrame:
    """chrom, strand, center of all hits of an IUPAC motif on both strands of genome (chrom,
    seq)."""
    from ..functions.udfs import motif_scan

    hits = genome.select("chrom", F.explode(motif_scan("seq", F.lit(motif))).alias("h"))
    return hits.select("chrom", F.col("h.strand").alias("strand"), center_of(F.col("h.start").cast("long"), F.col("h.end").cast("long"), F.col("h.strand"), rule).alias("center"))


def junctions_from_bed(bed: DataFrame) -> DataFrame:
    """chrom, strand, k_start, k_end of junctions in BED rows; both strands where a row has
    none."""
    return bed.select("chrom", F.explode(F.when(F.col("strand").isNull(), F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand"))).alias("strand"), F.col("start").alias("k_start"), F.col("end").alias("k_end")).distinct()


def known_junctions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, k_start, k_end from a BED file, or from the introns or exons of a GFF or
    GTF file."""
    if path.lower().removesuffix(".gz").endswith(".bed"):
        return junctions_from_bed(annotation.read_bed(spark, path))
    return annotation.read_introns(spark, path).select("chrom", "strand", F.col("intron_start").alias("k_start"), F.col("intron_end").alias("k_end"))


def read_bedgraph(spark: SparkSession, path: str, strand: str) -> DataFrame:
    """chrom, strand, position, value of a bedGraph file, a row for each position of its
    intervals."""
    cells = F.split("value", r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.size(cells) >= 4))
    get = lambda i: F.get(cells, F.lit(i))
    spans = rows.select(get(0).alias("chrom"), get(1).try_cast("long").alias("s"), get(2).try_cast("long").alias("e"), get(3).try_cast("double").alias("value")).where("e > s AND value IS NOT NULL")
    return spans.select("chrom", F.lit(strand).alias("strand"), F.explode(F.expr("sequence(s, e - 1)")).alias("position"), F.abs("value").alias("value"))


def sum_tracks(tracks: list[DataFrame]) -> DataFrame:
    """chrom, strand, position, value summed over tracks: what a track lacks counts nothing."""
    both = tracks[0]
    for t in tracks[1:]:
        both = both.unionByName(t)
    return both.groupBy("chrom", "strand", "position").agg(F.sum("value").alias("value"))


def read_site_signal(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, site, a_count, signal (array of doubles) of a reference of tract sites:
    Parquet, or a table whose signal_window is a comma list."""
    if path.endswith(".parquet"):
        t = spark.read.parquet(path)
        t = annotation.resolve_columns(t, {"site": ["position"], "a_count": ["downstream_acount"], "signal": ["signal_window"]})
    else:
        t = annotation.resolve_columns(_table(spark, path), {"site": ["position"], "a_count": ["downstream_acount"], "signal": ["signal_window"]})
        t = t.withColumn("signal", F.transform(F.split("signal", ","), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))))
    return t.select("chrom", "strand", F.col("site").cast("long").alias("site"), F.col("a_count").try_cast("int").alias("a_count"), F.col("signal").cast("array<double>").alias("signal"))


def position_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """chrom, strand, position, count: rows of corrected-end tables added up over files."""
    parts = None
    for p in paths:
        t = annotation.resolve_columns(_table(spark, p), {"position": ["corrected_position", "corrected_3prime"]})
        weight = F.coalesce(F.col("fraction").try_cast("double"), F.lit(1.0)) if "fraction" in t.columns else F.lit(1.0)
        one = t.select("chrom", "strand", F.col("position").try_cast("long").alias("position"), weight.alias("w")).where("position IS NOT NULL")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("chrom", "strand", "position").agg(F.sum("w").alias("count"))


# The columns of trim records.
TRIM = "read_id string, strand string, polya_len int, adapter_seq string, adapter_pass int, pt_tag string, trimmed_seq string, trimmed_quals array<int>"


def write_trim(records: DataFrame, path: str) -> None:
    records.select(*[f.split()[0] for f in TRIM.split(", ")]).write.mode("overwrite").parquet(path)


def read_trim(spark: SparkSession, path: str) -> DataFrame:
    """Trim records from Parquet, or from a table whose qualities are a comma list; one for
    each read (the longest tail)."""
    if path.endswith((".tsv", ".tsv.gz")):
        t = annotation.resolve_columns(_table(spark, path), {"trimmed_seq": ["trimmed_3prime_seq"], "trimmed_quals": ["trimmed_3prime_quals"]})
        quals = F.transform(F.filter(F.split(F.coalesce("trimmed_quals", F.lit("")), ","), lambda x: x != ""), lambda x: x.try_cast("int"))
        t = t.withColumns({"trimmed_quals": quals, "polya_len": F.col("polya_len").try_cast("int"), "adapter_pass": F.col("adapter_pass").try_cast("int")})
    else:
        t = spark.read.parquet(path)
    columns = [f.split()[0] for f in TRIM.split(", ")]
    best = t.select(*columns).groupBy("read_id").agg(F.max_by(F.struct(*columns[1:]), F.struct("polya_len", "trimmed_seq")).alias("r"))
    return best.select("read_id", "r.*")


def default_mask(features: DataFrame, gap: int = 10_000) -> DataFrame:
    """chrom, start, end (half open), reason of what analyses leave out, from GFF rows (chrom,
    feature, start, end): the mitochondrion, and rRNA genes, those at most gap apart as one
    array of repeats."""
    from ..operators.intervals import merge_intervals

    names = [n for n, to in yeast_names().items() if to in ("chrMito", *MITO_NAMES)]
    mito = features.where(F.col("chrom").isin(names)).groupBy("chrom").agg(F.lit(0).cast("long").alias("start"), F.max("end").alias("end")).withColumn("reason", F.lit("mito"))
    repeats = features.where(F.lower("feature").isin("rrna", "rrna_gene") & ~F.col("chrom").isin(names)).select("chrom", "start", "end")
    rdna = merge_intervals(repeats, ["chrom"], "start", "end", gap).select("chrom", "start", "end", F.lit("rdna").alias("reason"))
    return mito.select("chrom", "start", "end", "reason").unionByName(rdna)
