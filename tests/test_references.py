"""Reference loaders, signal operators and evidence on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from endloom.functions import kernels as K
from endloom.functions import sequence as S
from endloom.operators import correction as R
from endloom.operators import evidence as E
from endloom.operators import netseq as N
from endloom.sources import annotation, references


def test_chromosome_names():
    names = references.yeast_names()
    assert names["BK006934.2"] == names["XVI"] == names["ref|NC_001148|"] == "chrXVI" and names["chrM"] == "chrM" and names["MT"] == "chrMito"
    ncbi = references.yeast_names("ncbi")
    assert ncbi["chrI"] == ncbi["BK006935.2"] == "ref|NC_001133|" and ncbi["chrM"] == "ref|NC_001224|" and len(ncbi) == 4 * 16 + 7
    assert references.name_format(["x", "BK006938.2"]) == "sgd" and references.name_format(["7"]) == "unknown"
    assert references.organism({**{f"chr{r}": 750_000 for r in references.ROMAN}}) == "saccharomyces_cerevisiae"
    assert references.organism({"chr1": 3_000_000_000}) == "homo_sapiens" and references.organism({"chr1": 2_200_000_000}) == "mus_musculus" and references.organism({"a": 5}) is None


def test_input_types():
    kinds = {"a.fq.gz": "fastq", "a.FASTQ": "fastq", "x.sam": "sam", "y.paf": "paf", "z.ubam": "ubam", "n.txt": "unknown"}
    assert {k: references.input_type(k) for k in kinds} == kinds
    assert references.input_type("n", b"@HD\tVN") == "sam" and references.input_type("n", b"@r1\nACG") == "fastq" and references.input_type("n", b"\x1f\x8b\x08\x04") == "bam"


def test_site_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Chrom\tPosition\tStrand\tgene\tA_count\nc1\t10\t+\tg\t0\nc1\t20\t-\th\t2\n#x\nc1\tbad\t+\ti\t0\n")
    assert [tuple(r) for r in references.read_control_sites(spark, str(tmp_path / "c.tsv")).collect()] == [("c1", 10, "+", "g")]
    assert sorted(r["site"] for r in references.read_truth(spark, str(tmp_path / "c.tsv")).collect()) == [10, 20]
    (tmp_path / "l.tsv").write_text("chrom\tstrand\tcenter\nc1\t-\t5\n")
    assert [tuple(r) for r in references.loci_from_tsv(spark, str(tmp_path / "l.tsv")).collect()] == [("c1", "-", 5)]
    (tmp_path / "a.gff").write_text("c1\tx\tgene\t11\t50\t.\t-\t.\tID=g\n")
    for rule, want in (("tss", 49), ("tes", 10), ("mid", 29)):
        assert references.loci_from_gff(spark, str(tmp_path / "a.gff"), rule=rule).first()["center"] == want
    genome = spark.createDataFrame([("c", "GGTATAAGGCCTTATAGG")], "chrom string, seq string")
    hits = {(r["strand"], r["center"]) for r in references.loci_from_motif(genome, "TATAAG").collect()}
    assert hits == {("+", 2), ("-", 15)}
    (tmp_path / "j.bed").write_text("c1\t10\t30\tj\t0\t+\nc1\t40\t60\n")
    assert {tuple(r) for r in references.known_junctions(spark, str(tmp_path / "j.bed")).collect()} == {("c1", "+", 10, 30), ("c1", "+", 40, 60), ("c1", "-", 40, 60)}


def test_signals_and_indexes(spark, tmp_path):
    (tmp_path / "p.bedgraph").write_text("track x\nc1 5 7 2.0\nc1\t9\t10\t-1.5\n")
    track = references.read_bedgraph(spark, str(tmp_path / "p.bedgraph"), "+")
    both = {r["position"]: r["value"] for r in references.sum_tracks([track, track.where("position < 6")]).collect()}
    assert both == {5: 4.0, 6: 2.0, 9: 1.5}
    (tmp_path / "s.tsv").write_text("chrom\tstrand\tposition\tdownstream_acount\tsignal_window\nc1\t+\t50\t3\t0,1.5,x\n")
    assert references.read_site_signal(spark, str(tmp_path / "s.tsv")).first()["signal"] == [0.0, 1.5, 0.0]
    for n, text in (("a", "chrom\tstrand\tcorrected_3prime\tfraction\nc1\t+\t7\t0.5\nc1\t+\t7\t\n"), ("b", "chrom\tstrand\tcorrected_position\nc1\t+\t7\n")):
        (tmp_path / f"{n}.tsv").write_text(text)
    index = references.position_index(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    assert [tuple(r) for r in index.collect()] == [("c1", "+", 7, 2.5)]


def test_trim_records_restore_reads(spark, tmp_path):
    trim = spark.createDataFrame([("r1", "+", 3, "", 0, "", "AAA", [30, 31, 32]), ("r1", "+", 2, "", 0, "", "AA", [30, 31]), ("r2", "-", 2, "T", 1, "", "AC", [1, 2])], references.TRIM)
    references.write_trim(trim, str(tmp_path / "t"))
    back = references.read_trim(spark, str(tmp_path / "t"))
    assert {r["read_id"]: r["polya_len"] for r in back.collect()} == {"r1": 3, "r2": 2}
    reads = spark.createDataFrame([("r1", "+", "GGG", "3M"), ("r2", "-", "CCC", "1S2M"), ("r3", "+", "TT", "2M")], "read_id string, strand string, seq string, cigar string")
    out = {r["read_id"]: (r["seq"], r["cigar"]) for r in E.restored(E.with_trim(reads, back.drop("strand"))).collect()}
    assert out == {"r1": ("GGGAAA", "3M3S"), "r2": ("GTCCC", "3S2M"), "r3": ("TT", "2M")}
    (tmp_path / "t.tsv").write_text("read_id\tstrand\tpolya_len\tadapter_seq\tadapter_pass\tpt_tag\ttrimmed_3prime_seq\ttrimmed_3prime_quals\nq\t+\t2\tT\t1\tx\tAA\t30,31\n")
    assert references.read_trim(spark, str(tmp_path / "t.tsv")).first()["trimmed_quals"] == [30, 31]


def test_regions_are_deconvolved(spark):
    psf = np.array([0.54, 0.26, 0.12, 0.08])
    truth = np.zeros(12)
    truth[[4, 11]] = [100, 40]
    signal = K.spread_matrix(psf, 12) @ truth
    rows = [("c", "+", 100 + i, float(v)) for i, v in enumerate(signal)] + [("c", "+", 100, 0.0)]
    frame = spark.createDataFrame(rows, "chrom string, strand string, position long, value double")
    regions = spark.createDataFrame([("c", "+", 100, 112), ("c", "-", 5, 8), ("c", "+", 300, 300)], "chrom string, strand string, s long, e long")
    w = N.region_signal(regions, frame, ["chrom", "strand"], "s", "e", "position", "value")
    out = N.deconvolve_regions(w, psf.tolist(), "s").orderBy("chrom", "strand", "position").collect()
    found = {r["position"]: r for r in out if r["strand"] == "+"}
    x, r2, rmse, recovery, peaks = K.fitted(signal, psf)
    assert set(found) == {104, 111} and found[104]["flag"] == found[111]["flag"] == "strong" and r2 > 0.99 and rmse < 1
    assert found[111]["confidence"] == pytest.approx((x[11] / x.sum() * 1.0 * r2) ** 0.33)
    assert [r["position"] for r in out if r["strand"] == "-"] == [None]
    # A region longer than the limit is cut, and loses no position.
    cut = N.region_signal(regions, frame, ["chrom", "strand"], "s", "e", "position", "value", most=5)
    assert sorted((r["s"], len(r["signal"])) for r in cut.where("strand = '+'").collect()) == [(100, 5), (105, 5), (110, 2)]
    held = N.outside_regions(frame, regions, ["chrom", "strand"], "position", "s", "e")
    assert held.count() == 0


def test_sampled_assignment_follows_the_shares(spark):
    peaks = spark.createDataFrame([("c", 10, 0.25), ("c", 20, 0.75)], "chrom string, position long, fraction double")
    reads = spark.range(4000).select(F.lit("c").alias("chrom"), F.col("id").cast("string").alias("read_id"))
    once = N.sampled(reads, peaks, ["chrom"])
    n = {r["assigned"]: r["count"] for r in once.groupBy("assigned").count().collect()}
    assert set(n) == {10, 20} and 850 < n[10] < 1150
    assert once.join(N.sampled(reads.repartition(7), peaks, ["chrom"]).withColumnRenamed("assigned", "b"), ["chrom", "read_id"]).where("assigned <> b").count() == 0


def test_refinement_by_reference_sites(spark):
    signal = [0.0] * 21
    signal[8], signal[12] = 9.0, 1.0
    sites = spark.createDataFrame([("c", "+", 100, signal)], "chrom string, strand string, site long, signal array<double>")
    ends = spark.createDataFrame([("c", "+", 103), ("c", "+", 400)], "chrom string, strand string, position long")
    args = (ends, sites, ["chrom", "strand"], ["chrom", "strand", "position"])
    rows = {(r["position"], r["refined"]): (r["fraction"], r["shift"], r["method"]) for r in N.refine_by_reference(*args).collect()}
    assert rows == {(103, 98): (0.9, -5, "raw"), (103, 102): (0.1, -1, "raw"), (400, 400): (1.0, 0, "no_reference")}
    best = {r["position"]: (r["refined"], r["confidence"]) for r in N.refine_by_reference(*args, proportional=False).collect()}
    assert best == {103: (98, "high"), 400: (400, "low")}
    sharp = N.refine_by_reference(*args, psf=[0.7, 0.3], proportional=False).collect()
    assert {r["position"]: r["method"] for r in sharp} == {103: "deconvolved", 400: "no_reference"}


def test_homopolymer_penalties(spark):
    rows = spark.createDataFrame([("del", 1, 2.0, 500, "AT"), ("D", 4, 0.5, 500, "AT"), ("del", 1, 3.0, 500, "CG"), ("del", 6, 9.0, 5, "CG"), ("ins", 1, 7.0, 500, "AT")], "op_type string, hp_length int, penalty_score double, count_total int, base_class string")
    table = N.penalty_table(rows, "d")
    assert table == {"AT": {1: 2.0, 4: 0.5}, "CG": {1: 3.0}}
    asked = spark.createDataFrame([(1, "a"), (4, "T"), (9, "A"), (2, "G"), (1, "N")], "n int, b string")
    assert [r[0] for r in asked.select(N.penalty_of(table, F.col("n"), F.col("b"))).collect()] == [2.0, 0.5, 0.5, 3.0, 1.0]


def test_ambiguous_reads(spark):
    rows = [("r1", "a", None), ("r2", "a", []), ("r3", "b", None), ("r4", "a", ["b"]), ("r5", "c", ["d"]), ("r6", "e", ["f"]), ("r7", "f", ["e"])]
    df = spark.createDataFrame(rows, "read_id string, intron_id string, alternatives array<string>")
    out = {r["intron_id"]: (r["confident"], r["ambiguous"], r["attributed"]) for r in E.ambiguous_counts(df).collect()}
    assert out == {"a": (2, 1, pytest.approx(2 / 3)), "b": (1, 0, 0.0), "c": (0, 1, 0.5), "e": (0, 1, 0.5), "f": (0, 1, 0.5)}
    held = {r["intron_id"]: r["total"] for r in E.ambiguous_counts(df, "holdout").collect()}
    assert held == {"a": 2.0, "b": 1.0, "c": 0.0, "e": 0.0, "f": 0.0}


def test_evidence_and_tables(spark):
    j = spark.createDataFrame([("c", "+", 1, 9, "b", 10), ("c", "+", 1, 9, "a", 30), ("c", "+", 5, 8, "c", 50)], "chrom string, strand string, j_start long, j_end long, read_id string, mapq int")
    known = spark.createDataFrame([("c", "+", 5, 8)], "chrom string, strand string, k_start long, k_end long")
    found = {r["j_start"]: r for r in E.junction_evidence(j, known, list_reads=True).collect()}
    assert (found[1]["reads"], found[1]["mean_mapq"], found[1]["annotated"], found[5]["annotated"]) == (["a", "b"], 20.0, False, True)
    marked = E.junction_evidence(j, known).withColumn("is_canonical", F.lit(False))
    assert [r["j_start"] for r in E.valid_evidence(marked).collect()] == [5] and E.valid_evidence(marked, canonical=None).count() == 2
    r = spark.createDataFrame([("x", 2.0, 0.01), ("y", -3.0, 0.01), ("z", 4.0, None), ("w", 0.5, 0.01)], "feature string, log2fc double, padj double")
    assert {(x["feature"], x["direction"]) for x in E.result_tables(r).collect()} == {("x", "up"), ("y", "down")}
    counts = spark.createDataFrame([("a", "s", 9), ("a", "t", 1), ("b", "s", 2)], "feature string, sample string, count long")
    assert {x["feature"] for x in E.enough_counts(counts, 1, 2).collect()} == {"a"} and {x["feature"] for x in E.enough_total(counts, 2).collect()} == {"a", "b"}


def test_soft_clips_and_indel_correction(spark):
    df = spark.createDataFrame([("3S5M2S", "AAACCCCCGG"), ("5M", "CCCCC")], "cigar string, seq string")
    clips = [[(c["side"], c["len"], c["seq"]) for c in r[0]] for r in df.select(S.soft_clips(S.cigar_ops(F.col("cigar")), F.col("seq"))).collect()]
    assert clips == [[("left", 3, "AAA"), ("right", 2, "GG")], []]
    genome = spark.createDataFrame([("c", "G" * 10 + "A" * 10 + "CG" + "A" * 20)], "chrom string, seq string")
    reads = [("del", "c", "+", 0, "20M2D10M", "G" * 10 + "A" * 20), ("far", "c", "+", 0, "5M2D25M", "G" * 10 + "A" * 20), ("long", "c", "+", 0, "20M4D10M", "G" * 10 + "A" * 20), ("ins", "c", "+", 0, "20M2I8M", "G" * 10 + "A" * 20), ("none", "x", "+", 0, "20M2D10M", "G" * 10 + "A" * 20)]
    out = {r["read_id"]: (r["three_prime"], r["corrected"], r["n_deletions"], r["n_insertions"]) for r in R.indel_correction(spark.createDataFrame(reads, "read_id string, chrom string, strand string, start long, cigar string, seq string"), genome).collect()}
    assert out == {"del": (31, 29, 1, 0), "far": (31, 31, 0, 0), "long": (33, 33, 0, 0), "ins": (27, 27, 0, 1), "none": (31, 31, 0, 0)}
    walked = R.walk_back_ends(spark.createDataFrame([("a", "c", "+", 0, "12M", "G" * 10 + "AA"), ("b", "x", "+", 0, "12M", "G" * 12)], "read_id string, chrom string, strand string, start long, cigar string, seq string"), genome)
    assert {r["read_id"]: r["corrected"] for r in walked.collect()} == {"a": 9, "b": 11}


def test_known_introns_of_a_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text("c1\tx\texon\t11\t20\t.\t+\t.\tParent=t1\nc1\tx\texon\t31\t50\t.\t+\t.\tParent=t1\n")
    assert [tuple(r) for r in references.known_junctions(spark, str(tmp_path / "a.gff")).collect()] == [("c1", "+", 20, 30)]
    assert annotation.read_introns(spark, str(tmp_path / "a.gff")).count() == 1


def test_mismatches_feed_the_variant_table(spark):
    from endloom.operators import genes

    text = "ACGTAAAACGTN"
    g = spark.createDataFrame([("c", text)], "chrom string, seq string")
    rows = [(f"r{i}", "c", "+", 2, "3M1D4M2S", "GTA" + "ACCG" + "TT") for i in range(4)] + [("q", "c", "-", 0, "12M", "ACGTAATACGTA")]
    found = E.read_mismatches(spark.createDataFrame(rows, "read_id string, chrom string, strand string, start long, cigar string, seq string"), g)
    got = {(r["read_id"], r["position"], r["base"], r["in_homopolymer"]) for r in found.collect()}
    assert got == {(f"r{i}", 7, "C", True) for i in range(4)} | {("q", 6, "T", True)}
    depth = spark.createDataFrame([("c", 7, 5), ("c", 6, 1)], "chrom string, position long, depth long")
    out = genes.variant_frequency(found.select("chrom", "position", "base"), depth, ["chrom", "position"], 3, 0.5).collect()
    assert [(r["position"], r["base"]) for r in out] == [(7, "C")]


def test_default_mask(spark):
    rows = [("chrMito", "gene", 10, 90), ("chrMito", "rRNA", 95, 99), ("chrXII", "rRNA", 100, 200), ("chrXII", "rRNA_gene", 5000, 5100), ("chrXII", "rRNA", 90_000, 90_100), ("chrI", "gene", 1, 2)]
    out = {tuple(r) for r in references.default_mask(spark.createDataFrame(rows, "chrom string, feature string, start long, end long")).collect()}
    assert out == {("chrMito", 0, 99, "mito"), ("chrXII", 100, 5100, "rdna"), ("chrXII", 90_000, 90_100, "rdna")}
