"""Profiles, enrichment, linkage and groupings against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from endloom.functions import sequence as S
from endloom.functions import udfs as U
from endloom.operators import clustering as C
from endloom.operators import evidence as E
from endloom.operators import genes as G
from endloom.operators import signal as X
from endloom.operators import stats as T
from endloom.sources import alignments

KEYS = ["chrom", "strand"]


def test_scaled_profile_against_numpy(spark):
    rng = random.Random(1)
    values = {(s, p): float(rng.randint(0, 9)) for s in "+-" for p in range(60) if rng.random() < 0.8}
    frame = spark.createDataFrame([("c", s, p, v) for (s, p), v in values.items()], "chrom string, strand string, position long, value double")
    loci = [("c", "+", 10, 30), ("c", "-", 20, 27), ("c", "+", 40, 40), ("c", "-", 55, 58)]
    rows = []
    for _, s, a, b in loci:
        at = (lambda p: values.get((s, a + p), 0.0)) if s == "+" else (lambda p: values.get((s, b - p), 0.0))  # noqa: B023
        n = b - a + 1
        body = np.array([at(p) for p in range(n)])
        scaled = np.interp(np.linspace(0, n - 1, 6), np.arange(n), body) if n > 1 else np.full(6, body[0] / 6)
        row = np.array([*(at(p) for p in (-2, -1)), *scaled, *(at(n + i) for i in range(3))])
        if row.sum() >= 1:
            rows.append(row / row.sum())
    want = np.mean(rows, axis=0)
    out = X.scaled_profile(spark.createDataFrame(loci, "chrom string, strand string, start long, end long"), frame, KEYS, "position", "value", 2, 3, width=6, least=1.0).orderBy("column").collect()
    assert [r["column"] for r in out] == list(range(-2, 9)) and np.allclose([r["mean"] for r in out], want)
    assert np.allclose([r["sem"] for r in out], np.std(rows, axis=0) / np.sqrt(len(rows)))
    centers = spark.createDataFrame([("c", "+", 30), ("c", "-", 30)], "chrom string, strand string, center long")
    spike = spark.createDataFrame([("c", "+", 33, 5.0), ("c", "-", 28, 5.0)], "chrom string, strand string, position long, value double")
    check = X.strand_check(centers, spike, KEYS, "center", "position", "value", 5).first()
    assert (check["plus"], check["minus"], check["agree"]) == (3, 2, True)


def test_windows_of_a_capped_profile_are_not_broadcast(spark):
    """Spark takes exploded loci for as small as loci: the join must not become one that may broadcast them."""
    loci = spark.range(2000).select(F.lit("c").alias("chrom"), F.lit("+").alias("strand"), (F.col("id") * 100).alias("center"))
    large = spark.range(4_000_000).select(F.lit("c").alias("chrom"), F.lit("+").alias("strand"), F.col("id").alias("position"), (F.col("id") % 7).alias("value"))
    plan = X.metagene(loci, large, KEYS, "center", "position", "value", 20, cap=0.9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BuildLeft" not in plan

    values = [0.0, 1.0, 2.0, 3.0, 100.0]
    signal = spark.createDataFrame([("c", "+", 100 * k + 3, v) for k, v in enumerate(values)], "chrom string, strand string, position long, value double")
    few = spark.createDataFrame([("c", "+", 100 * k) for k in range(6)], "chrom string, strand string, center long")
    cut = np.minimum([*values, 0.0], np.quantile(values[1:], 0.5))
    for out, at, want in ((signal, 3, cut), (signal.where("value = 0"), 3, np.zeros(6)), (signal.where("false"), -2, np.zeros(6))):
        rows = {r["offset"]: r for r in X.metagene(few, out, KEYS, "center", "position", "value", 5, cap=0.5).collect()}
        assert len(rows) == 11 and all(r["n"] == 6 for r in rows.values())
        assert np.allclose([rows[at]["mean"], rows[at]["sem"]], [np.mean(want), np.std(want) / np.sqrt(6)])


def test_set_enrichment(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(40)], "gene_id string")
    chosen = genes.where("int(substring(gene_id, 2)) < 10").union(spark.createDataFrame([("other",)], "gene_id string"))
    sets = [("hit", f"g{i}") for i in range(8)] + [("none", f"g{i}") for i in range(20, 26)] + [("small", "g1"), ("small", "g2")] + [("half", f"g{i}") for i in range(5, 15)]
    out = {r["go_id"]: r for r in T.set_enrichment(chosen, genes, spark.createDataFrame(sets, "go_id string, gene_id string"), largest=20).collect()}
    assert set(out) == {"hit", "half"} and (out["hit"]["hit"], out["hit"]["marked"]) == (8, 8)
    from math import comb

    assert out["hit"]["p"] == pytest.approx(comb(10, 8) / comb(40, 8), abs=1e-10)
    assert out["hit"]["expected"] == 2 and out["hit"]["fold"] == 4 and out["hit"]["padj"] == pytest.approx(3 * out["hit"]["p"], abs=1e-9)


def test_linkage(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(0, 100, (2, 50))
    rows = [(f"f{i}", s, int(base[k][i] + rng.uniform(0, 5))) for s, k in (("a", 0), ("b", 0), ("c", 1), ("d", 1)) for i in range(50)]
    out = T.sample_linkage(spark.createDataFrame(rows, "feature string, sample string, count long")).orderBy("step").collect()
    assert {(r["a"], r["b"]) for r in out[:2]} == {("a", "b"), ("c", "d")} and (out[2]["a"], out[2]["b"], out[2]["size"]) == ("a", "c", 4)
    assert out[0]["height"] <= out[1]["height"] <= out[2]["height"]


def test_principal_components_against_numpy(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 200, (30, 5))
    rows = [(f"f{i}", f"s{j}", int(counts[i, j])) for i in range(30) for j in range(5)]
    out = T.pca_samples(spark.createDataFrame(rows, "feature string, sample string, count long")).orderBy("sample").collect()
    x = np.log2(counts + 1.0)
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(z.T, full_matrices=False)
    for k in range(2):
        want = u[:, k] * s[k]
        got = np.array([r[f"pc{k + 1}"] for r in out])
        assert np.allclose(got, want) or np.allclose(got, -want)
        assert got[np.abs(got).argmax()] > 0


def test_cluster_genes(spark):
    rows = [("k1", "g1", 6), ("k1", "g2", 2), ("k1", None, 1), ("k2", None, 3)]
    out = {r["cluster_id"]: r for r in G.cluster_genes(spark.createDataFrame(rows, "cluster_id string, gene_id string, n long"), ["cluster_id"]).collect()}
    assert (out["k1"]["primary_gene"], out["k1"]["primary_fraction"], out["k1"]["n_intergenic"]) == ("g1", 0.75, 1)
    assert out["k1"]["attribution"] == "g1,67%;g2,22%;none,11%" and (out["k2"]["primary_gene"], out["k2"]["primary_fraction"]) == ("none", 1.0)


def test_groupings_of_reads(spark):
    errors = spark.createDataFrame([("r", p, p == 5) for p in (1, 3, 5, 60, 90, 92, 94)], "read_id string, pos long, in_homopolymer boolean")
    assert sorted((r["start"], r["end"]) for r in E.mismatch_windows(errors, ["read_id"]).collect()) == [(1, 5), (90, 94)]
    j = spark.createDataFrame([("r", 4, 61), ("r", 7, 500)], "read_id string, j_start long, j_end long")
    assert E.junction_proximity(errors, j).first()["near"] == 1 + 1 + 0.5 + 1
    spans = spark.createDataFrame([("c", 0, 5), ("c", 3, 8), ("c", 6, 9), ("c", 10, 12)], "chrom string, s long, e long")
    assert {(r["s"], r["row"]) for r in E.packed_rows(spans, ["chrom"], "s", "e").collect()} == {(0, 0), (3, 1), (6, 0), (10, 0)}
    reads = spark.createDataFrame([("c", "+", 3), ("c", "-", 6), ("x", "+", 1)], "chrom string, strand string, three_prime long")
    g = spark.createDataFrame([("c", "AACCGGTTAC")], "chrom string, seq string")
    assert {(r["chrom"], r["strand"], r["context"]) for r in E.read_context(reads, g, 4).collect()} == {("c", "+", "GGTT"), ("c", "-", "CCGG"), ("x", "+", None)}


def test_paf_becomes_records(spark, tmp_path):
    line = "r{i}\t10\t2\t9\t{s}\tc1\t1000\t10\t17\t7\t7\t60\tcs:Z:=ACGTACG\n"
    (tmp_path / "a.paf").write_text(line.format(i=1, s="+") + line.format(i=2, s="-"))
    reads = spark.createDataFrame([("r1", "TTACGTACGA", "IIIIIIIIIJ"), ("r2", "TTCGTACGTA", "IIIIIIIIIJ")], "name string, seq string, quals string")
    out = {r["name"]: r for r in alignments.paf_records(alignments.read_paf(spark, str(tmp_path / "a.paf")), reads).collect()}
    assert (out["r1"]["cigar"], out["r1"]["flag"], out["r1"]["seq"]) == ("2S7M1S", 0, "TTACGTACGA")
    assert (out["r2"]["cigar"], out["r2"]["flag"], out["r2"]["seq"], out["r2"]["quals"][0]) == ("1S7M2S", 16, "TACGTACGAA", "J")


def test_kmers_and_flanks(spark):
    rows = [("ACGTAC", True)] * 6 + [("GGGGGG", False)] * 14
    out = {r["kmer"]: r for r in T.kmer_enrichment(spark.createDataFrame(rows, "seq string, chosen boolean"), 4).collect()}
    assert (out["ACGT"]["hit"], out["ACGT"]["marked"]) == (6, 6) and out["ACGT"]["padj"] < 0.01 and out["GGGG"]["p"] == pytest.approx(1.0)
    g = spark.createDataFrame([("c", "AACCGGTTAC")], "chrom string, seq string")
    sites = spark.createDataFrame([("c", "+", 4), ("c", "-", 4), ("c", "+", 0)], "chrom string, strand string, position long")
    assert {(r["strand"], r["position"], r["flank"]) for r in T.flanks(sites, g, 3, 2).collect()} == {("+", 4, "ACCGG"), ("-", 4, "AACCG")}


def test_adaptive_clusters_and_centroids_of_frames(spark):
    rng = random.Random(8)
    rows = [(k, "+", rng.choice([0, 200]) + rng.randint(0, 40)) for k in "ab" for _ in range(150)]
    out = C.cluster_adaptive(spark.createDataFrame(rows, "chrom string, strand string, position long"), KEYS).collect()
    want = set()
    for k in "ab":
        for low in (0, 200):
            counts = {}
            for x in (p for a, _, p in rows if a == k and low <= p < low + 100):
                counts[x] = counts.get(x, 0) + 1
            pos, count = np.array(sorted(counts)), np.array([counts[p] for p in sorted(counts)])
            peaks = C.greedy_peaks(pos, count, 5)
            for i, (a, b) in zip(peaks, C.adaptive_bounds(pos, count, peaks, 10)):
                reads = int(count[(pos >= a) & (pos <= b)].sum())
                if reads >= 5:
                    want.add((k, "+", a, b, int(pos[i]), reads, b - a + 1))
    assert {tuple(r) for r in out} == want and want
    pairs = spark.createDataFrame([("c", 1, 50), ("c", 3, 52), ("c", 20, 70), ("d", 2, 50)], "chrom string, s long, e long")
    assert {tuple(r) for r in C.centroid_dedup(pairs, ["chrom"], "s", "e").collect()} == {("c", 2, 51, 2), ("c", 20, 70, 1), ("d", 2, 50, 1)}
    assert pairs.agg(F.count(F.lit(1))).first()[0] == 4


def test_batch_kernels_agree_with_columns(spark):
    rng = random.Random(12)
    rows = [(None, "5M"), (3, None), (7, "*"), (0, ""), (5, "12N")] + [(rng.randint(0, 10**6), "".join(f"{rng.randint(1, 12000)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 9)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "start long, cigar string").where("start IS NOT NULL AND cigar IS NOT NULL")
    both = df.select(S.junctions(F.col("start"), S.cigar_ops(F.col("cigar"))).alias("a"), U.cigar_junctions("start", "cigar").alias("b"))
    assert both.where("NOT a <=> b").count() == 0 and both.where("size(b) > 0").count() > 100
    odd = spark.createDataFrame(rows[:4], "start long, cigar string").select(U.cigar_junctions("start", "cigar").alias("b")).collect()
    assert [r["b"] for r in odd] == [None, None, [], []]
    texts = [("".join(rng.choice("AAACGT") for _ in range(rng.randint(0, 40))),) for _ in range(200)] + [("",), ("A" * 10,), ("C" * 300 + "A" * 9,)]
    seqs = spark.createDataFrame(texts, "seq string").select(S.max_richness(F.col("seq")).alias("a"), U.max_richness("seq").alias("b"))
    assert seqs.where("abs(a - b) > 1e-12").count() == 0
