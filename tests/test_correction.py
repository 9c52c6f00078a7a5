"""Corrections on hand-made reads, and mirrored between strands."""

import random

from pyspark.sql import functions as F

from endloom.functions import kernels as K
from endloom.functions import sequence as S
from endloom.operators import correction as C

#        0         1         2         3         4         5
GENOME = "CCTGACCATGGTACTTCTCTCTCTCTAGGCATCGATCGGCAAAAAAAAAAAAAAAAAAAAAAAA"


def genome(spark, seq=GENOME):
    return spark.createDataFrame([("c", seq)], "chrom string, seq string")


def test_artifact_junctions(spark):
    tail = "A" * 20
    reads = spark.createDataFrame([("real", "c", "+", 0, "10M18N12M", GENOME[:10] + GENOME[28:40]), ("fake", "c", "+", 28, "12M5N20M", GENOME[28:40] + tail)], "read_id string, chrom string, strand string, start long, cigar string, seq string")
    out = {r["read_id"]: r for r in C.artifact_junctions(C.junction_contexts(reads), genome(spark)).collect()}
    assert (out["real"]["j_start"], out["real"]["j_end"]) == (10, 28) and not out["real"]["is_artifact"] and out["fake"]["is_artifact"]


def test_deletions_and_oligo_a(spark):
    df = spark.createDataFrame([("AAAAAAAAAAAA", 6, "CA", "+"), ("AAAAAAAAAAAA", 6, "AA", "+"), ("GCGCGCAAAAAA", 6, "CA", "+"), ("TTTTTTTTTTTT", 6, "GT", "-")], "seq string, at int, deleted string, strand string")
    got = [r[0] for r in df.select(C.deletion_artifact(F.length("deleted"), F.col("deleted"), F.col("seq"), F.col("at"), F.col("strand"))).collect()]
    assert got == [True, False, False, True]
    reads = spark.createDataFrame([("5=3X2S", "GGGGGAAAGG", "+"), ("2S3X5=", "GGTTTGGGGG", "-"), ("5=3X", "GGGGGACA", "+"), ("8=", "GGGGGAAA", "+")], "cigar string, seq string, strand string")
    assert [r[0] for r in reads.select(C.oligo_a(S.cigar_ops(F.col("cigar")), F.col("seq"), F.col("strand"))).collect()] == [3, 3, 1, 0]


def test_refinement_and_rescue_are_mirrored(spark):
    n = len(GENOME)
    flip = lambda a, b: (n - b, n - a)
    before, after = "TT" + GENOME[:10], GENOME[28:40]
    for strand in "+-":
        plus = strand == "+"
        g = genome(spark, GENOME if plus else K.reverse_complement(GENOME))
        at = lambda a, b: (a, b) if plus else flip(a, b)  # noqa: E731, B023
        q = (before, after) if plus else (K.reverse_complement(after), K.reverse_complement(before))
        reads = spark.createDataFrame([("r", "c", strand, *at(12, 30), *q)], "read_id string, chrom string, strand string, j_start long, j_end long, before string, after string")
        pool = spark.createDataFrame([("c", strand, *at(10, 28), True)], "chrom string, strand string, p_start long, p_end long, annotated boolean")
        r = C.refine_junctions(reads, pool, g).first()
        assert (r["new_start"], r["new_end"]) == at(10, 28)
        clip = GENOME[2:10] if plus else K.reverse_complement(GENOME[2:10])
        body = at(28, 40)
        reads = spark.createDataFrame([("r", "c", strand, *body, clip)], "read_id string, chrom string, strand string, start long, end long, clip string")
        known = spark.createDataFrame([("c", strand, *at(10, 28))], "chrom string, strand string, k_start long, k_end long")
        r = C.rescue_five_prime(reads, known, g).first()
        assert r["distance"] == 0 and r["five_prime"] == (2 if plus else n - 3)


def test_effective_clip_psf_and_regions(spark):
    df = spark.createDataFrame([([1, 0, 1, 1, 0, 1] + [0] * 19, 2), ([0] * 25, 2), ([1] + [0] * 24, 0)], "e array<int>, clip int")
    assert [r[0] for r in df.select(C.effective_clip(F.col("e"), F.col("clip"))).collect()] == [8, 2, 0]
    w = spark.createDataFrame([([1.0, 3.0],), ([1.0, 1.0],), ([0.0, 0.0],)], "signal array<double>")
    assert {r["offset"]: r["weight"] for r in C.empirical_psf(w).collect()} == {0: 0.375, 1: 0.625}
    p = spark.createDataFrame([("c", 1, 5, 6.0), ("c", 15, 4, 6.0), ("c", 80, 9, 3.0), ("c", 16, 0, 99.0)], "chrom string, pos long, a_count int, count double")
    assert [tuple(r) for r in C.tract_regions(p, ["chrom"], "pos").collect()] == [("c", 1, 15, 12.0)]


def _rescued(clip, genome, at, least=3):
    """The plus strand, base by base: (shift, kind)."""
    inside = genome[at - least + 1 : at + 1]
    shift = 0
    if len(inside) == least and len(set(inside)) == 1:
        ext = 0
        while ext < len(clip) + 9 and at + ext + 1 < len(genome) and genome[at + ext + 1] == inside[0]:
            ext += 1
        got, run = 0, 0
        for i, base in enumerate(clip):
            place = at + ext + 1 + i
            run = run + 1 if base == "A" else 0
            if place >= len(genome):
                break
            if run >= least:
                got -= run - 1
                break
            if genome[place] != base:
                break
            got += 1
        while got > 0 and genome[at + ext + got] == "A":
            got -= 1
        if got > 0:
            return ext + got, "homopolymer"
    if len(clip) >= 5 and clip.count("A") >= 0.7 * len(clip):
        while shift < 5 and at + shift + 1 < len(genome) and clip[shift : shift + 1] == genome[at + shift + 1] == "A":
            shift += 1
    return shift, "prefix" if shift else None


def test_clip_rescue_against_brute_force_on_both_strands(spark):
    rng = random.Random(31)
    text = "".join(rng.choice("AACGT") * rng.choice([1, 1, 2, 4, 6]) for _ in range(120))
    mirrored, n, rows, want = K.reverse_complement(text), len(text), [], {}
    for i in range(250):
        at = rng.randint(20, n - 12)
        ahead = text[at + 1 :].lstrip(text[at]) if rng.random() < 0.6 else text[at + 1 :]
        clip = ahead[: rng.randint(0, 6)] + rng.choice(["", "A" * rng.randint(1, 12), "G", "CAAAAAAA"])
        want[f"p{i}"] = _rescued(clip, text, at)
        body = text[at - 9 : at + 1]
        rows.append((f"p{i}", "c", "+", at, f"10M{len(clip)}S" if clip else "10M", body + clip))
        want[f"m{i}"] = want[f"p{i}"]
        rows.append((f"m{i}", "m", "-", n - 1 - at, f"{len(clip)}S10M" if clip else "10M", K.reverse_complement(body + clip)))
    rows.append(("none", "x", "+", 5, "3M4S", "ACGAAAA"))
    want["none"] = (0, None)
    g = spark.createDataFrame([("c", text), ("m", mirrored)], "chrom string, seq string")
    out = C.rescue_clips(spark.createDataFrame(rows, "read_id string, chrom string, strand string, three_prime long, cigar string, seq string"), g).collect()
    got = {r["read_id"]: (r["rescued_bases"], r["rescue"]) for r in out}
    assert got == want and {k for _, k in got.values()} == {None, "homopolymer", "prefix"}
    for r in out:
        assert r["rescued"] - r["three_prime"] == (r["rescued_bases"] if r["strand"] == "+" else -r["rescued_bases"])


def test_five_prime_cases(spark):
    n = len(GENOME)
    known = spark.createDataFrame([("c", "+", 10, 28), ("m", "-", n - 28, n - 10)], "chrom string, strand string, k_start long, k_end long")
    g = spark.createDataFrame([("c", GENOME), ("m", K.reverse_complement(GENOME))], "chrom string, seq string")
    junction = "array<struct<start:bigint,end:bigint>>"
    plus = [("clip", 28, 40, GENOME[4:10], []), ("inside", 20, 40, "", []), ("spans", 20, 60, "", [(15, 30)]), ("near", 31, 40, "", []), ("far", 45, 60, "", [])]
    rows = [(f"+{k}", "c", "+", a, b, clip, j) for k, a, b, clip, j in plus]
    rows += [(f"-{k}", "m", "-", n - b, n - a, K.reverse_complement(clip), [(n - y, n - x) for x, y in j]) for k, a, b, clip, j in plus]
    out = {r["read_id"]: (r["five_prime"], r["kind"], r["intron_start"]) for r in C.five_prime_cases(spark.createDataFrame(rows, f"read_id string, chrom string, strand string, start long, end long, clip string, junctions {junction}"), known, g).collect()}
    want = {"clip": (4, "softclip", 10), "inside": (9, "intronic_snap", 10), "spans": (20, "proximity", 10), "near": (31, "proximity", 10), "far": (45, "none", None)}
    assert {k[1:]: v for k, v in out.items() if k[0] == "+"} == want
    assert {k[1:]: v[0] for k, v in out.items() if k[0] == "-"} == {k: n - 1 - v[0] for k, v in want.items()}
    assert {k[1:]: v[1] for k, v in out.items() if k[0] == "-"} == {k: v[1] for k, v in want.items()}


def _mismatched(columns, raw, run):
    """Real columns (place, read, genome) from the end inwards."""
    for place, r, g in columns:
        if r != run:
            return place
        if g != run:
            return raw
    return raw


def test_mismatches_in_runs_on_both_strands(spark):
    rng = random.Random(41)
    text = "".join(rng.choice("ACGT") * rng.choice([1, 1, 3, 7]) for _ in range(90))
    n, rows, want = len(text), [], {}
    for i in range(200):
        end = rng.randint(30, n - 8)
        body = list(text[end - 19 : end + 1])
        for _ in range(rng.randint(0, 2)):
            body[rng.randint(10, 19)] = rng.choice("ACGT")
        read, outside = "".join(body), text[end : end + 3]
        columns = [(end - k, read[-1 - k], text[end - k]) for k in range(20)]
        want[i] = _mismatched(columns, end, outside[0]) if len(set(outside)) == 1 else end
        rows.append((f"+{i}", "c", "+", end - 19, "20M", read))
        rows.append((f"-{i}", "m", "-", n - 1 - end, "20M", K.reverse_complement(read)))
    g = spark.createDataFrame([("c", text), ("m", K.reverse_complement(text))], "chrom string, seq string")
    out = {r["read_id"]: r["corrected"] for r in C.rescue_mismatches(spark.createDataFrame(rows + [("x", "no", "+", 5, "4M", "ACGT")], "read_id string, chrom string, strand string, start long, cigar string, seq string"), g).collect()}
    assert {i: out[f"+{i}"] for i in want} == want and out["x"] == 8
    assert {i: n - 1 - out[f"-{i}"] for i in want} == want
    assert sum(out[f"+{i}"] != rows[2 * i][3] + 19 for i in want) > 3
