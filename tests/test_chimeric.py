"""Stitched alignments on made reads."""

import random

from endloom.functions.kernels import CIGAR
from endloom.operators import chimeric as Q


def size(cigar, kinds):
    return sum(int(n) for n, o in CIGAR.findall(cigar) if o in kinds)


def test_agreeing_versions_stay():
    same = {"a": (100, "5S40M200N30M5S"), "b": (100, "5S40M200N30M5S")}
    assert Q.stitched(same) == (100, "5S40M200N30M5S", ["a"], 0)
    assert Q.stitched({"a": (5, "10M")}) == (5, "10M", ["a"], 0)


def test_each_aligner_gives_its_better_half():
    # One finds the first junction, the other the second; both agree in the middle.
    versions = {"a": (100, "20M100N40M30S"), "b": (200, "20S20M0I20M300N30M")}
    start, cigar, aligners, n = Q.stitched({"a": versions["a"], "b": (220, "20S40M300N30M")})
    assert (start, cigar, aligners, n) == (100, "20M100N40M300N30M", ["a", "b"], 2)
    # A mismatched stretch against one with a known junction.
    known = {(140, 640)}
    start, cigar, aligners, _ = Q.stitched({"a": (100, "60M"), "b": (100, "40M500N20M")}, known)
    assert (start, cigar, aligners) == (100, "40M500N20M", ["b"])
    assert Q.stitched({"a": (100, "60M"), "b": (100, "40M20000N20M")})[1] == "60M"  # too long a skip


def test_versions_that_cannot_be_joined_stay_whole():
    apart = {"a": (100, "50M"), "b": (5000, "50M")}
    assert Q.stitched(apart) == (100, "50M", ["a"], 0)
    assert Q.stitched({"a": (100, "50M"), "b": (100, "49M")})[3] == 0  # of different lengths
    assert Q.joined([[("M", 5, 0, 100)], [("M", 5, 5, 90)]]) is None
    assert Q.joined([[("M", 5, 0, 100)], [("M", 5, 5, 108)]]) == (100, "5M3D5M")
    assert Q.joined([[("M", 5, 0, 100)], [("M", 5, 5, 150)]]) == (100, "5M45N5M")


def test_stitched_reads_lose_no_base():
    rng = random.Random(6)
    for _ in range(300):
        true, at = [], 0
        for _ in range(rng.randint(1, 4)):
            true += [("M", rng.randint(5, 40)), (rng.choice("NDI"), rng.randint(1, 60))]
        true.append(("M", rng.randint(5, 40)))
        total = sum(n for o, n in true if o in "MI")
        versions = {}
        for name in "abc"[: rng.randint(2, 3)]:
            ops, q, r = [], 0, 1000
            for o, n in true:
                if o == "M" and rng.random() < 0.3 and n > 6:
                    k = rng.randint(1, 3)
                    ops += [("M", n - k - 2), ("X", k), ("M", 2)]
                else:
                    ops.append((o, n))
            if rng.random() < 0.3 and ops[-1][1] > 4:
                ops[-1:] = [("M", ops[-1][1] - 3), ("S", 3)]
            versions[name] = (1000, "".join(f"{n}{o}" for o, n in ops))
        start, cigar, aligners, n = Q.stitched(versions)
        assert start == 1000 and size(cigar, "M=XIS") == total
        score = lambda c: Q.segment_score(Q.placed([(o, int(n)) for n, o in CIGAR.findall(c)], 1000), set())
        assert score(cigar) >= max(score(c) for _, c in versions.values()) - 1e-9
        assert set(aligners) <= set(versions) and at == 0


def test_frames_of_versions(spark):
    rows = [("r1", "a", "c", "+", 100, "20M100N40M30S", []), ("r1", "b", "c", "+", 220, "20S40M300N30M", ["280-580"]), ("r2", "a", "c", "-", 5, "10M", []), ("r1", "z", "d", "+", 1, "90M", []), (None, "a", "c", "+", 1, "5M", [])]
    df = spark.createDataFrame(rows, "read_id string, aligner string, chrom string, strand string, start long, cigar string, known array<string>")
    out = {(r["read_id"], r["chrom"]): r for r in Q.stitch_reads(df).collect()}
    assert len(out) == 3 and out["r1", "c"]["cigar"] == "20M100N40M300N30M" and out["r1", "c"]["is_chimeric"] and out["r1", "c"]["aligners"] == "a,b"
    assert (out["r2", "c"]["cigar"], out["r2", "c"]["n_segments"], out["r1", "d"]["cigar"]) == ("10M", 0, "90M")
