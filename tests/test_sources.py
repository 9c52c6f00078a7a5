"""Readers and writers on small files."""

import gzip
import random
import struct
import zlib

from pyspark.sql import functions as F

from endloom.functions import sequence as S
from endloom.functions import udfs
from endloom.sources import alignments, annotation, sinks

GFF = "##gff\nc1\tx\tgene\t11\t50\t.\t+\t.\tID=g1;Name=alpha%20one\nc1\tx\texon\t11\t20\t.\t+\t.\tParent=t1\nc1\tx\texon\t31\t50\t.\t+\t.\tParent=t1\nc2\tx\tgene\t1\t9\t.\t-\t.\tgene_id \"g2\"; gene_name \"beta\"\nc2\tx\tintron\t3\t5\t.\t-\t.\tx=1\n"


def test_annotation(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    genes = annotation.read_genes(spark, str(tmp_path / "a.gff"))
    assert sorted(map(tuple, genes.collect())) == [("c1", 10, 50, "+", "g1", "alpha one"), ("c2", 0, 9, "-", "g2", "beta")]
    assert sorted(map(tuple, annotation.read_introns(spark, str(tmp_path / "a.gff")).collect())) == [("c1", "+", 20, 30), ("c2", "-", 2, 5)]
    assert sorted((r["tss"], r["tes"]) for r in annotation.transcript_ends(genes).collect()) == [(8, 0), (10, 49)]


def test_bed_fasta_fastq(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nc1\t10\t20\tn\t0\t-\nc1\t5\t9\n")
    bed = annotation.read_bed(spark, str(tmp_path / "a.bed"))
    assert sorted((r["center"], r["strand"]) for r in annotation.loci_from_bed(bed, "start").collect()) == [(5, "+"), (19, "-")]
    (tmp_path / "a.fa").write_text(">c1 first\nacgt\nAC\n>c2\nTT\n")
    assert sorted(map(tuple, annotation.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("c1", "ACGTAC"), ("c2", "TT")]
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nAC\n+\nI\n")
    assert sorted(map(tuple, annotation.read_fastq(spark, str(tmp_path / "a.fq")).collect())) == [("r1", "ACGT", "@III", True), ("r2", "AC", "I", False)]


def _bgzf(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bam(path):
    text = b"@HD\n"
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    cigar = [(5, 4), (4, 0), (90, 3), (2, 0)]
    seq = "ACGTACGTACG"
    codes = "=ACMGRSVTWYHKDBN"
    packed = bytes((codes.index(a) << 4) | codes.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2]))
    rec = struct.pack("<iiBBHHHiiii", 0, 99, 3, 60, 0, len(cigar), 16, len(seq), -1, -1, 0) + b"r1\0" + struct.pack("<4I", *[(n << 4) | o for n, o in cigar]) + packed + bytes([30] * len(seq)) + b"NMi" + struct.pack("<i", 2) + b"XAZhi\0"
    path.write_bytes(_bgzf(raw) + _bgzf(struct.pack("<i", len(rec)) + rec) + _bgzf(b""))


def test_sam_and_bam_agree(spark, tmp_path):
    _bam(tmp_path / "a.bam")
    (tmp_path / "a.sam").write_text("@HD\nr1\t16\tc1\t100\t60\t5S4M90N2M\t*\t0\t0\tACGTACGTACG\t" + "?" * 11 + "\tNM:i:2\tXA:Z:hi\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    alignments.register(spark)
    bam = alignments.read_bam(spark, str(tmp_path / "a.bam")).collect()
    assert bam == spark.read.format("bam").load(str(tmp_path / "a.bam")).collect()
    sam = alignments.primary(alignments.read_sam(spark, str(tmp_path / "a.sam")))
    assert bam == sam.collect()
    r = alignments.read_table(sam).collect()[0]
    assert (r["strand"], r["end"], r["three_prime"], r["five_prime"]) == ("-", 195, 99, 194)
    assert [tuple(j) for j in r["junctions"]] == [(103, 193)] and tuple(r["clips"]) == (0, 5)
    assert alignments.extract(alignments.read_table(sam), region=("c1", 190, 200), min_mapq=10, strand="-", spliced_only=True).count() == 1


def test_paf(spark, tmp_path):
    line = "r1\t20\t0\t20\t{s}\tc1\t1000\t10\t40\t18\t20\t{q}\tcs:Z:=ACG*at+gg=TT-c~gt12ag=A\n"
    (tmp_path / "a.paf").write_text(line.format(s="+", q=60) + line.format(s="-", q=3))
    rows = alignments.read_paf(spark, str(tmp_path / "a.paf")).collect()
    assert {(r["cigar"], r["strand"], r["is_primary"]) for r in rows} == {("4M2I2M1D12N1M", "+", True), ("4M2I2M1D12N1M", "-", False)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", 5, "+", 2.0), ("c1", 3, "-", 6.0)], "chrom string, position long, strand string, count double")
    sinks.write_position_index(df, str(tmp_path / "i"))
    assert sorted(map(tuple, sinks.read_position_index(spark, str(tmp_path / "i")).collect())) == [("c1", 3, "-", 6.0), ("c1", 5, "+", 2.0)]
    assert sorted((r["start"], r["end"], r["value"]) for r in sinks.bedgraph(df, "count", rpm=True).collect()) == [(3, 4, 750000.0), (5, 6, 250000.0)]
    sinks.write_bedgraph(df, str(tmp_path / "b"))
    sinks.write_fasta(spark.createDataFrame([("n", "ACG")], "name string, seq string"), str(tmp_path / "f"))
    assert annotation.read_fasta(spark, str(tmp_path / "f")).collect()[0]["seq"] == "ACG"
    j = df.withColumn("junctions", F.array(F.struct(F.lit(1).alias("start"), F.lit(4).alias("end"))))
    sinks.write_table(j, str(tmp_path / "t"), "tsv")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["junctions"] == "1-4"
    assert sinks.provenance(spark, "x", [str(tmp_path / "t")], {"a": 1}).count() == 1


def test_ambiguity_is_symmetric_between_strands(spark):
    rows = [("GGGAAAATTCGAAAAAAGG", i) for i in range(19)]
    df = spark.createDataFrame(rows, "seq string, p long")
    plus = df.select("p", S.tract_ambiguity(F.col("seq"), F.col("p"), F.lit("+")).alias("t")).collect()
    minus = {r["p"]: r["t"] for r in df.select("p", S.tract_ambiguity(S.revcomp(F.col("seq")), F.col("p"), F.lit("-")).alias("t")).collect()}
    for r in plus:
        m = minus[18 - r["p"]]
        assert (r["t"]["a_count"], r["t"]["tract"]) == (m["a_count"], m["tract"]) and r["t"]["hi"] - r["t"]["lo"] == m["hi"] - m["lo"]


def test_udfs_in_sql(spark):
    udfs.register(spark)
    row = spark.sql("SELECT hp_edit_distance('GAAAT', 'GAAT') AS d, affine_cigar('ACGT', 'ACT').cigar AS c").first()
    assert row["d"] == 0.5 and row["c"].count("M") >= 1


def _records(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        length = rng.choice([1, 30, 200, 3000])
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        quals = rng.choice(["*", "".join(chr(33 + rng.randint(0, 60)) for _ in range(length))])
        out.append((f"read{i}", rng.choice([0, 16, 256]), rng.choice(["c1", "c2"]), rng.randint(0, 5000), rng.randint(0, 60), f"{length}M" if length < 3000 else "1000M50N1990M10S", seq, quals, {"NM": str(i), "XA": f"t{i}", "XF": "0.5"}))
    return out


def test_bam_is_written_and_read_back_in_ranges(spark, tmp_path):
    rows = _records(300) + [("un", 4, "*", -1, 0, "*", "ACG", "*", {})]
    df = spark.createDataFrame(rows, alignments.SCHEMA)
    alignments.write_bam(df, str(tmp_path / "out"), [("c1", 10_000), ("c2", 10_000)])
    key = lambda r: r["name"]
    plain = lambda frame: sorted((tuple(r[:8]) + (sorted(r["tags"].items()),) for r in frame.collect()), key=lambda r: r[0])
    want = sorted((tuple(r[:8]) + (sorted(r[8].items()),) for r in rows), key=lambda r: r[0])
    sorted_rows = alignments.read_bam(spark, str(tmp_path / "out")).collect()
    places = [(r["chrom"] == "*", r["chrom"], r["start"]) for r in sorted_rows]
    assert places == sorted(places) and len(sorted_rows) == len(rows)
    alignments.write_bam(df.repartition(3), str(tmp_path / "three"), [("c1", 10_000), ("c2", 10_000)], by_place=False)
    assert len(alignments.files_of(str(tmp_path / "three"), ".bam")) == 3 and plain(alignments.read_bam(spark, str(tmp_path / "three"))) == want
    # One file of many blocks, cut anywhere.
    one = str(tmp_path / "one")
    alignments.write_bam(df.coalesce(1), one, [("c1", 10_000), ("c2", 10_000)], by_place=False)
    (path, size), = alignments.files_of(one, ".bam")
    refs, header = alignments.bam_references(path)
    assert refs == [("c1", 10_000), ("c2", 10_000)]
    for split in (size // 2 + 1, size // 5, 9_000):
        got = [r for at in range(0, size, split) for r in alignments.read_range(path, at, min(at + split, size), [n for n, _ in refs], header)]
        assert sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    split = alignments.read_bam(spark, one, split=20_000)
    assert split.rdd.getNumPartitions() > 4 and plain(split) == want
    parts = [alignments.read_bam(spark, one, region=("c1", a, a + 1000)).count() for a in range(0, 6000, 1000)]
    assert sum(parts) == sum(r[2] == "c1" for r in rows) and key(split.first())
    alignments.write_bam(df.limit(3), one, [("c1", 10_000), ("c2", 10_000)])  # overwrites
    assert alignments.read_bam(spark, one).count() == 3


def test_fastq_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+IF5") for _ in range(n))) for i in range(400) for n in [rng.randint(1, 60)]]
    text = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in rows)
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    for split in (300, 5000, 1 << 20):
        out = annotation.read_fastq(spark, str(tmp_path / "a.fq"), split).collect()
        assert sorted(map(tuple, out)) == sorted((*r, True) for r in rows)
    assert annotation.read_fastq(spark, str(tmp_path / "b.fq.gz"), 300).count() == len(rows)


def test_corrected_records(spark, tmp_path):
    from endloom.operators import correction

    rows = [("a", 0, "c1", 10, 60, "10M5S", "A" * 15, "*", {"NM": "1"}), ("b", 16, "c1", 10, 60, "4S10M", "C" * 14, "*", {}), ("c", 0, "c1", 10, 60, "5M", "AAAAA", "*", {})]
    ends = spark.createDataFrame([("a", 15), ("a", 16), ("b", 12), ("c", 14)], "read_id string, corrected long")
    out = {r["name"]: r for r in correction.corrected_records(spark.createDataFrame(rows, alignments.SCHEMA), ends).collect()}
    assert (out["a"]["start"], out["a"]["cigar"], out["a"]["tags"]) == (10, "6M9S", {"NM": "1", "cp": "15", "op": "19"})
    assert (out["b"]["start"], out["b"]["cigar"]) == (12, "6S8M") and out["c"]["cigar"] == "5M" and out["c"]["tags"] == {}
