"""Every command on a small file, and steps that are not run again."""

import random

import pytest

from endloom.__main__ import COMMANDS, main
from endloom.sources import alignments, references, sinks

GENOME = "".join(random.Random(1).choice("ACGT") for _ in range(600)) + "A" * 12 + "".join(random.Random(2).choice("CGT") for _ in range(400))


@pytest.fixture()
def files(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        start = rng.randint(0, 400)
        n = rng.choice([60, 90])
        body = GENOME[start : start + n]
        rows.append((f"r{i}", rng.choice([0, 0, 16]), "c1", start, 60, f"{n}M10S", body + "A" * 10, "I" * (n + 10), {}))
    rows += [(f"j{i}", 0, "c1", 100, 60, "40M200N40M", GENOME[100:140] + GENOME[340:380], "*", {}) for i in range(6)]
    alignments.write_bam(spark.createDataFrame(rows, alignments.SCHEMA), str(tmp_path / "bam"), [("c1", len(GENOME))])
    (path, _), *rest = alignments.files_of(str(tmp_path / "bam"), ".bam")
    assert not rest
    (tmp_path / "g.fa").write_text(f">c1\n{GENOME}\n")
    (tmp_path / "a.gff").write_text("c1\tx\tgene\t1\t450\t.\t+\t.\tID=g1\n")
    (tmp_path / "t.tsv").write_text("chrom\tposition\tstrand\n" + "".join(f"c1\t{p}\t+\n" for p in range(0, 600, 25)))
    (tmp_path / "ref.tsv").write_text("chrom\tstrand\tposition\tdownstream_acount\tsignal_window\n" + "".join(f"c1\t+\t{p}\t1\t{','.join(['1'] * 21)}\n" for p in range(0, 600, 100)))
    return {"bam": path, "genome": str(tmp_path / "g.fa"), "gff": str(tmp_path / "a.gff"), "truth": str(tmp_path / "t.tsv"), "reference": str(tmp_path / "ref.tsv"), "out": str(tmp_path / "out")}


def test_commands(spark, files):
    f, out = files, files["out"]
    run = lambda *args: main([*args, "--out", out], spark)
    table = lambda step, name: spark.read.parquet(f"{out}/{step}/{name}")
    assert run("extract", f["bam"], "--region", "c1:100-200", "--min-mapq", "10", "--spliced-only") and table("extract", "reads").count() == 6
    assert run("correct", f["bam"], "--genome", f["genome"])
    ends = table("correct", "corrected_3ends")
    assert ends.count() == 126 and table("correct", "stats").first()["n_reads"] == 126
    assert not run("correct", f["bam"], "--genome", f["genome"])  # nothing has changed
    assert run("correct", f["bam"], "--genome", f["genome"], "--again")
    ends = f"{out}/correct/corrected_3ends"
    assert run("analyze", ends, "--annotation", f["gff"], "--min-reads", "2") and table("analyze", "clusters").count() > 0
    assert run("aggregate", f["bam"], "--genome", f["genome"]) and {r["n_reads"] for r in table("aggregate", "junctions").collect()} == {6}
    assert run("consensus", f"one={ends}", f"two={ends}") and table("consensus", "consensus").count() == 126
    assert run("validate", ends, "--truth", f["truth"]) and table("validate", "validation").count() > 0
    assert run("export", ends, "--rpm") and spark.read.text(f"{out}/bedgraph").count() > 0
    assert run("trim-polya", f["bam"]) and table("trim-polya", "trim_metadata").where("polya_len >= 10").count() > 0
    assert run("restore-softclip", f["bam"], "--trim", f"{out}/trim-polya/trim_metadata") and table("restore-softclip", "restored").count() == 126
    assert run("train-polya", f["bam"], "--sites", f["truth"])
    assert run("tag-polya", f["bam"], "--model", f"{out}/train-polya/model") and table("tag-polya", "tags").count() == 126
    assert run("netseq", ends, "--reference", f["reference"]) and table("netseq", "refined").count() > 0
    assert run("prescan", f["bam"]) and table("prescan", "regions").count() >= 1
    assert run("split", f["bam"], "--chunks", "3") and spark.read.parquet(f"{out}/chunks").count() == 126
    assert run("run-all", f["bam"], "--genome", f["genome"], "--annotation", f["gff"], "--min-reads", "2")
    assert run("write-bam", f["bam"], "--ends", ends) and alignments.read_bam(spark, f"{out}/corrected.bam").count() == 126
    assert set(COMMANDS) == {"extract", "correct", "write-bam", "analyze", "aggregate", "consensus", "validate", "export", "trim-polya", "restore-softclip", "train-polya", "tag-polya", "netseq", "prescan", "split", "run-all"}


def test_regions_resume(spark, tmp_path):
    df = spark.createDataFrame([("c", i) for i in range(30)], "chrom string, start long")
    done = []

    def part(region):
        done.append(region)
        return alignments.starting_in(df, *region)

    regions = [("c", a, a + 10) for a in (0, 10, 20)]
    assert sinks.by_region(spark, regions[:2], part, str(tmp_path / "r")).count() == 20
    assert sinks.by_region(spark, regions, part, str(tmp_path / "r")).count() == 30 and len(done) == 3


def test_streamed_alignments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "r{i}\t0\tc1\t{p}\t60\t5M\t*\t0\t0\tACGTA\tIIIII\n"
    for k in range(3):
        (tmp_path / "in" / f"{k}.sam").write_text("@HD\n" + "".join(line.format(i=10 * k + i, p=1 + i) for i in range(4)))
    stream = alignments.extract(alignments.read_table(alignments.primary(alignments.stream_sam(spark, str(tmp_path / "in"), 1))), min_mapq=10).select("name", "three_prime")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_summary_tables(spark):
    r = spark.createDataFrame([("x", 2.0, 0.01), ("y", -3.0, 0.01), ("z", 0.1, 0.9)], "feature string, log2fc double, padj double")
    t = sinks.summary_tables(r)
    assert [x["feature"] for x in t["up"].collect()] == ["x"] and {x["direction"]: x["n"] for x in t["summary"].collect()} == {"up": 1, "down": 1, "none": 1}
    assert references.name_format(["chrI"]) == "ucsc"
