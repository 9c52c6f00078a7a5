"""Column functions over nucleotide sequences, CIGAR strings and junctions.

All are built-in Catalyst expressions: no Python runs on the executors. Coordinates are
0-based and half open; SQL's substring is 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rightward shift of an apparent 3' end by the number of downstream As; more
# than ten count as ten.
SHIFT_BY_A_COUNT = [0.0, 0.2, 0.3, 0.4, 1.0, 1.3, 1.7, 2.6, 2.8, 2.9, 3.8]
# IUPAC codes as classes of bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# Consensus and penalties of splice sites.
SPLICE_SITES = {
    "yeast": {"five": ("GTATGT", [4.0, 3.0, 1.0, 1.0, 2.0, 1.0]), "three": ("YYYAG", [1.0, 1.0, 1.0, 3.0, 4.0])},
    "metazoan": {"five": ("GTAAGT", [4.0, 3.0, 1.0, 1.0, 1.0, 1.0]), "three": ("YYYYAG", [1.0, 1.0, 1.0, 1.0, 3.0, 4.0])},
}


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def count_base(seq: Column, bases: str) -> Column:
    """How many characters of seq are one of bases."""
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def window(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end], clamped to the sequence."""
    s = F.greatest(start, F.lit(0))
    return F.when(end > s, F.substring(seq, s + 1, end - s)).otherwise(F.lit(""))


def downstream(seq: Column, position: Column, strand: Column, n: int) -> Column:
    """The n bases after position in the direction of the strand, read along it."""
    return F.when(strand == "+", window(seq, position + 1, position + 1 + n)).otherwise(revcomp(window(seq, position - n, position)))


def downstream_a_count(seq: Column, position: Column, strand: Column, n: int = 10) -> Column:
    """As (along the strand) in the downstream window; null if position is outside."""
    return F.when((position >= 0) & (position < F.length(seq)), count_base(downstream(seq, position, strand, n), "A"))


def expected_shift(a_count: Column) -> Column:
    table = F.array(*[F.lit(v) for v in SHIFT_BY_A_COUNT])
    return F.element_at(table, F.least(a_count, F.lit(len(SHIFT_BY_A_COUNT) - 1)) + 1)


def tract_length(seq: Column, position: Column, strand: Column, most: int = 10) -> Column:
    """Length of the run of As (Ts on the minus strand) around position, at most ``most``
    beyond it each way; 0 where the base itself is another."""
    base = F.when(strand == "+", F.lit("A")).otherwise(F.lit("T"))
    after = window(seq, position + 1, position + 1 + most)
    before = F.reverse(window(seq, position - most, position))
    run = lambda w: F.length(w) - F.length(F.ltrim(w, base))
    return F.when(window(seq, position, position + 1) == base, 1 + run(after) + run(before)).otherwise(F.lit(0))


def tract_ambiguity(seq: Column, position: Column, strand: Column, n: int = 10) -> Column:
    """struct<a_count, shift, tract, lo, hi>: where the true 3' end may lie. Outside a tract
    there is no ambiguity."""
    a = downstream_a_count(seq, position, strand, n)
    tract = tract_length(seq, position, strand, n)
    shift = F.when(a.isNull() | (tract == 0), F.lit(0.0)).otherwise(expected_shift(a))
    top = F.length(seq).cast("long") - 1
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c.cast("long"), top))
    inside = a.isNotNull() & (tract > 0)
    # Truncation toward zero, which is what a position just below zero gets too.
    lo = F.when(inside & (strand == "+"), clamp((position - shift).cast("long"))).otherwise(position.cast("long"))
    hi = F.when(inside & (strand != "+"), clamp(F.ceil(position + shift))).otherwise(position.cast("long"))
    return F.struct(a.alias("a_count"), shift.alias("shift"), tract.alias("tract"), lo.alias("lo"), hi.alias("hi"))


def mispriming(seq: Column, position: Column, strand: Column, size: int = 50, threshold: float = 0.65, least: int = 20) -> Column:
    """struct<window_size, ag_content, misprimed, confidence> of the downstream window."""
    w = downstream(seq, position, strand, size)
    enough = F.length(w) >= least
    ag = F.when(enough, count_base(w, "AG") / F.length(w))
    confidence = F.when(ag >= 0.75, "high").when(ag >= threshold, "medium").otherwise("low")
    return F.struct(F.length(w).alias("window_size"), ag.alias("ag_content"), F.coalesce(ag >= threshold, F.lit(False)).alias("misprimed"), confidence.alias("confidence"))


def max_richness(seq: Column, base: str = "A", size: int = 10) -> Column:
    """The greatest share of base in a window; the whole share if seq is shorter; 0 if empty.

    One pass: the last ``size`` characters are the bits of a number, so a window costs a
    shift and a bit count, and long sequences are not cut up again and again."""
    n = F.length(seq)
    start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("best"))

    def step(acc: Column, c: Column) -> Column:
        bits = F.shiftleft(acc["bits"], 1).bitwiseAND(F.lit((1 << size) - 1).cast("long")).bitwiseOR((c == base).cast("long"))
        return F.struct(bits.alias("bits"), F.greatest(acc["best"], F.bit_count(bits).cast("int")).alias("best"))

    best = F.aggregate(F.split(seq, ""), start, step)["best"] / size
    return F.when(n == 0, F.lit(0.0)).when(n <= size, count_base(seq, base) / n).otherwise(best)


def has_adapter(seq: Column) -> Column:
    """Six Ts or any TC."""
    return seq.rlike("TTTTTT|TC")


def iupac_regex(motif: str) -> str:
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def motif_penalty(seq: Column, consensus: str, penalties: list[float]) -> Column:
    """Sum of the penalties of positions that miss the consensus; missing bases count too."""
    total = F.lit(0.0)
    for i, (code, p) in enumerate(zip(consensus, penalties)):
        total = total + F.when(F.substring(seq, i + 1, 1).isin(*IUPAC[code]), F.lit(0.0)).otherwise(F.lit(p))
    return total


def splice_class(five: Column, three: Column) -> Column:
    """Class of an intron by its dinucleotides along the strand."""
    return (
        F.when((five == "GT") & (three == "AG"), "GT-AG")
        .when((five == "GC") & (three == "AG"), "GC-AG")
        .when((five == "AT") & (three == "AC"), "AT-AC")
        .otherwise("non-canonical")
    )


def canonical_junction(five: Column, three: Column) -> Column:
    return five.isin("GT", "GC") & (three == "AG")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    pieces = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(F.substring(p, F.length(p), F.lit(1)).alias("op"), F.substring(p, F.lit(1), F.length(p) - 1).cast("long").alias("len")))


def cigar_sum(ops: Column, kinds: str) -> Column:
    """Total length of operations of the given kinds."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("long"), lambda acc, o: acc + o["len"])


def reference_end(start: Column, ops: Column) -> Column:
    return start + cigar_sum(ops, "MDN=X")


def junctions(start: Column, ops: Column) -> Column:
    """array<struct<start, end>> of the skipped stretches; all of M, D, N, = and X advance."""
    ended = F.aggregate(
        ops,
        F.struct(start.cast("long").alias("pos"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("found")),
        lambda acc, o: F.struct(
            (acc["pos"] + F.when(o["op"].isin(*"MDN=X"), o["len"]).otherwise(0)).alias("pos"),
            F.when(o["op"] == "N", F.concat(acc["found"], F.array(F.struct(acc["pos"].alias("start"), (acc["pos"] + o["len"]).alias("end"))))).otherwise(acc["found"]).alias("found"),
        ),
    )
    return ended["found"]


def clip_lengths(ops: Column, strand: Column) -> Column:
    """struct<five, three>: soft-clipped bases at the ends along the strand."""
    left = F.when(ops[0]["op"] == "S", ops[0]["len"]).otherwise(0)
    right = F.when((F.size(ops) > 1) & (F.element_at(ops, -1)["op"] == "S"), F.element_at(ops, -1)["len"]).otherwise(0)
    return F.struct(F.when(strand == "+", left).otherwise(right).alias("five"), F.when(strand == "+", right).otherwise(left).alias("three"))


def three_prime(start: Column, end: Column, strand: Column) -> Column:
    """The 3' end, inclusive."""
    return F.when(strand == "+", end - 1).otherwise(start)


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", start).otherwise(end - 1)


def sliding_edit(needle: Column, text: Column) -> Column:
    """The least Levenshtein distance of needle to any window of text of needle's length;
    to the whole text if that is shorter."""
    n = F.length(needle)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.levenshtein(needle, F.substring(text, i, n)))
    return F.array_min(windows)


def signal_confidence(signal: Column, width: Column) -> Column:
    """high / medium / low by a supporting signal, else by the width of the ambiguity."""
    return F.when(signal > 1, "high").when(signal > 0.5, "medium").when(width == 0, "high").when(width <= 2, "medium").otherwise("low")


def polya_score(seq: Column, threshold: float = 0.8, mean: float = 30.0, spread: float = 15.0, base: str = "A") -> Column:
    """0.5 * richness + 0.3 * fit of the length + 0.2 * share of base; 0 below the threshold."""
    length = F.exp(-F.pow((F.length(seq) - mean) / spread, F.lit(2)) / 2)
    share = F.when(F.length(seq) > 0, count_base(seq, base) / F.length(seq)).otherwise(0.0)
    scored = F.transform(F.array(max_richness(seq, base)), lambda rich: F.when(rich >= threshold, 0.5 * F.least(F.lit(1.0), rich / threshold) + 0.3 * length + 0.2 * share).otherwise(F.lit(0.0)))
    return scored[0]


def full_length(start: Column, end: Column, five_clip: Column, three_clip: Column, tss_distance: Column, most_clip: int = 50, least_fraction: float = 0.8, most_distance: int = 500) -> Column:
    """struct<is_full_length, confidence>: three signs of truncation take from the confidence."""
    aligned = end - start
    total = aligned + five_clip + three_clip
    fraction = F.when(total > 0, aligned / total).otherwise(1.0)
    clip = F.when(five_clip > most_clip, F.least(F.lit(0.4), (five_clip - most_clip) / 100)).otherwise(0.0)
    short = F.when(fraction < least_fraction, F.least(F.lit(0.4), (least_fraction - fraction) / 0.3)).otherwise(0.0)
    far = F.when(tss_distance > most_distance, F.least(F.lit(0.3), (tss_distance - most_distance) / 1000)).otherwise(0.0)
    clean = (five_clip <= most_clip) & (fraction >= least_fraction) & F.coalesce(tss_distance <= most_distance, F.lit(True))
    return F.struct(clean.alias("is_full_length"), F.greatest(F.lit(0.0), 1 - clip - short - far).alias("confidence"))


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key that orders runs of digits as numbers (of up to ``width`` digits)."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def sample_condition(name: Column) -> Column:
    """A sample's name without its replicate suffix."""
    for suffix in ("_rep[0-9]+$", "_r[0-9]+$", "_[0-9]+$", r"\.rep[0-9]+$", r"\.[0-9]+$"):
        name = F.regexp_replace(name, suffix, "")
    return name


def vep_position(field: Column) -> Column:
    """The first _-token of the first comma item, if it is all digits, as a long."""
    token = F.split_part(F.split_part(field, F.lit(","), F.lit(1)), F.lit("_"), F.lit(1))
    return F.when(token.rlike("^[0-9]+$"), token.cast("long"))


def tail_adapter(seq: Column, last: int = 150, peel: int = 15, least_peeled: int = 5) -> Column:
    """struct<tail, adapter, pass> of the strict tail scan (no base but A in the tail), as
    ``kernels.tail_adapter`` gives it, without Python."""

    def of(window: Column) -> Column:
        stub = F.length(F.regexp_extract(window, "T[CT]{0,10}$", 0))
        body = F.substring(window, F.lit(1), F.length(window) - stub)
        run = lambda s: F.length(s) - F.length(F.rtrim(s, F.lit("A")))
        ks = F.filter(
            F.sequence(F.lit(1), F.lit(peel)),
            lambda k: (k < F.length(body)) & F.contains(F.substring(body, F.length(body) - k + 1, k), F.lit("T")) & (run(F.substring(body, F.lit(1), F.length(body) - k)) >= least_peeled),
        )
        k = F.get(ks, F.lit(0))
        row = lambda t, a, p: F.struct(t.cast("int").alias("tail"), a.cast("int").alias("adapter"), p.cast("int").alias("pass"))
        step = (stub > 0).cast("int")
        return F.when(run(body) >= 1, row(run(body), stub, step)).when(k.isNotNull(), row(run(F.substring(body, F.lit(1), F.length(body) - k)), F.least(k + stub, F.lit(last)), F.lit(2))).otherwise(row(F.lit(0), stub, step))

    return F.transform(F.array(F.substring(seq, F.greatest(F.length(seq) - last + 1, F.lit(1)), F.lit(last))), of)[0]


def cigar_events(start: Column, ops: Column, kinds: str) -> Column:
    """array<struct<op, len, read_pos, ref_pos>> of the operations of some kinds: D, I, S, N."""
    each = F.transform(
        ops,
        lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("len"), cigar_sum(F.slice(ops, F.lit(1), i), "MIS=X").alias("read_pos"), (start + cigar_sum(F.slice(ops, F.lit(1), i), "MDN=X")).alias("ref_pos")),
    )
    return F.filter(each, lambda e: e["op"].isin(*kinds))


def soft_clips(ops: Column, seq: Column) -> Column:
    """array<struct<side, len, seq>> of the clipped ends."""
    n = F.length(seq)
    first, last = F.get(ops, F.lit(0)), F.element_at(ops, -1)
    left = F.when(first["op"] == "S", F.struct(F.lit("left").alias("side"), first["len"].alias("len"), window(seq, F.lit(0), first["len"].cast("int")).alias("seq")))
    right = F.when((F.size(ops) > 1) & (last["op"] == "S"), F.struct(F.lit("right").alias("side"), last["len"].alias("len"), window(seq, (n - last["len"]).cast("int"), n).alias("seq")))
    return F.array_compact(F.array(left, right))


# Names of control samples.
CONTROL_PATTERNS = ["^wt$", "^wt_", "_wt$", "_wt_", "^wildtype", "wild_type", "wild-type", "^control", "^ctrl$", "^ctrl_", "_ctrl$", "^untreated", "^mock$", "^dmso$", "^reference", "^ref$"]


def is_control(name: Column, patterns: list[str] = CONTROL_PATTERNS) -> Column:
    return F.lower(name).rlike("|".join(f"(?:{p})" for p in patterns))
