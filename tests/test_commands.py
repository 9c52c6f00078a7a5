"""Commands on a toy genome."""

from pyspark.sql import functions as F

from endloom.plans import commands as K


def test_correct(spark):
    genome = spark.createDataFrame([("c", "GCGCGCAAAAAAGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCGCG")], "chrom string, seq string")
    reads = spark.createDataFrame([("r1", "c", "+", 6), ("r2", "c", "+", 4), ("r3", "d", "-", 9), ("r4", "c", "+", 6)], "read_id string, chrom string, strand string, three_prime long")
    out = {r["read_id"]: r for r in K.correct(reads, genome).collect()}
    assert out["r1"]["corrected_3prime"] == 4 and "a_tract" in out["r1"]["qc_flags"] and out["r4"]["corrected_3prime"] == 4
    assert out["r2"]["corrected_3prime"] == 4 and out["r2"]["confidence"] == "high"
    assert out["r3"]["corrected_3prime"] == 9 and out["r3"]["qc_flags"] == ["no_sequence"]


def test_analyze(spark):
    ends = spark.createDataFrame([("c", "+", 100 + i % 5, f"s{i % 2}", 0.5) for i in range(10)] + [("c", "+", 500, "s0", 1.0)] * 5, "chrom string, strand string, position long, sample string, fraction double")
    genes = spark.createDataFrame([("c", "+", "g1", 110), ("c", "+", "g2", 5000)], "chrom string, strand string, gene_id string, gene_3prime long")
    out = K.analyze(ends, genes)
    assert [(r["start"], r["end"], r["n_positions"]) for r in out["clusters"].orderBy("start").collect()] == [(100, 104, 10), (500, 500, 5)]
    assert {(r["cluster_id"], r["sample"]): r["total"] for r in out["matrix"].collect()} == {("cluster_000000", "s0"): 2.5, ("cluster_000000", "s1"): 2.5, ("cluster_000001", "s0"): 5.0, ("cluster_000001", "s1"): 0.0}
    assert {r["gene_id"]: r["total"] for r in out["gene_counts"].groupBy("gene_id").agg(F.sum("total").alias("total")).collect()} == {"g1": 5.0}


def test_classify_validate_and_regions(spark):
    p = spark.createDataFrame([("c", "+", 5, 1), ("c", "-", 5, 2), ("c", "+", 99, 3)], "chrom string, strand string, position long, n long")
    f = spark.createDataFrame([("c", "+", 0, 10, "CDS"), ("c", "+", 4, 6, "UTR3")], "chrom string, strand string, f_start long, f_end long, category string")
    assert {(r["strand"], r["position"]): r["category"] for r in K.classify_positions(p, f, ["UTR3", "CDS"]).collect()} == {("+", 5): "UTR3", ("-", 5): "antisense", ("+", 99): "intergenic"}
    ends = spark.createDataFrame([("c", "+", "r1", 12, 10, "x", "high"), ("c", "+", "r2", 50, 50, "x", "low")], "chrom string, strand string, read_id string, three_prime long, corrected_3prime long, correction string, confidence string")
    truth = spark.createDataFrame([("c", "+", 10), ("c", "+", 9)], "chrom string, strand string, position long")
    m = [r for r in K.validate(ends, truth).collect() if (r["correction"], r["confidence"]) == ("all", "all")][0]
    assert (m["n_rows"], m["n_truth"], m["within_0"], m["improved"]) == (2, 1, 1, 1)
    cover = spark.createDataFrame([("c", 0, 50), ("c", 40, 90), ("c", 400_000, 400_010)], "chrom string, start long, end long")
    assert [(r["start"], r["end"], r["number"]) for r in K.processing_regions(cover).orderBy("number").collect()] == [(0, 90, 0), (400_000, 400_010, 1)]
    ends2 = spark.createDataFrame([("c", "+", 5, 90, 10), ("c", "+", 9, 92, 11), ("c", "+", 40, 95, 12)], "chrom string, strand string, position long, other long, length long")
    assert sorted((r["start"], r["n_reads"], r["mean_other"]) for r in K.aggregate_ends(ends2).collect()) == [(5, 2, 91.0), (40, 1, 95.0)]
