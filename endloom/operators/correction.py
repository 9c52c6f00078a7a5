"""Per-read corrections: artifact junctions, deletions in tails, oligo(A) ends, 5' rescue and
junction refinement. Coordinates are 0-based and half open; reads are in genome orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..functions.udfs import hp_edit_distance, hp_edit_distance_by


def _query_before(ops: Column, n: Column) -> Column:
    """Query bases consumed by the first n operations."""
    return S.cigar_sum(F.slice(ops, F.lit(1), n), "MIS=X")


def junction_contexts(reads: DataFrame) -> DataFrame:
    """One row for each junction of each read, with the 20 query bases on either side (before,
    after). reads: read_id, chrom, strand, start, cigar, seq."""
    r = reads.withColumn("ops", S.cigar_ops(F.col("cigar"))).withColumn("end", S.reference_end(F.col("start"), F.col("ops")))
    at = F.filter(F.transform("ops", lambda o, i: F.when(o["op"] == "N", i)), lambda i: i.isNotNull())
    each = r.withColumn("i", F.explode(at))
    j_start = F.col("start") + S.cigar_sum(F.slice("ops", F.lit(1), F.col("i")), "MDN=X")
    q = _query_before(F.col("ops"), F.col("i"))
    return each.select(
        "read_id", "chrom", "strand", j_start.alias("j_start"), (j_start + F.get("ops", F.col("i"))["len"]).alias("j_end"), S.three_prime(F.col("start"), F.col("end"), F.col("strand")).alias("three_prime"),
        S.window(F.col("seq"), q - 20, q).alias("before"), S.window(F.col("seq"), q, q + 20).alias("after"),
    )


def artifact_junctions(contexts: DataFrame, genome: DataFrame, reach: int = 50, richness: float = 0.8) -> DataFrame:
    """Adds is_artifact: the junction lies within reach of the 3' end, the tail side of the
    read is A-rich along the strand, and the genome beyond is A-rich too or the motif is not
    canonical. Distinct junctions meet the genome once."""
    plus = F.col("strand") == "+"
    share = lambda s, base: F.when(F.length(s) > 0, S.count_base(s, base) / F.length(s)).otherwise(0.0)
    distance = F.when(plus, F.col("three_prime") - F.col("j_end")).otherwise(F.col("j_start") - F.col("three_prime"))
    tail = F.when(plus, share(F.col("after"), "A")).otherwise(share(F.col("before"), "T"))
    sites = contexts.select("chrom", "strand", "j_start", "j_end").distinct().join(genome.select("chrom", "seq"), "chrom", "left")
    target = S.window(F.col("seq"), F.col("j_end"), F.col("j_end") + 20)
    left, right = S.window(F.col("seq"), F.col("j_start"), F.col("j_start") + 2), S.window(F.col("seq"), F.col("j_end") - 2, F.col("j_end"))
    canonical = F.when(plus, (left == "GT") & (right == "AG")).otherwise((left == "CT") & (right == "AC"))
    known = sites.select("chrom", "strand", "j_start", "j_end", F.coalesce(F.when(plus, share(target, "A")).otherwise(share(target, "T")), F.lit(0.0)).alias("target"), F.coalesce(canonical, F.lit(False)).alias("canonical"))
    near = (distance <= reach) & (tail >= richness)
    return contexts.join(known, ["chrom", "strand", "j_start", "j_end"]).withColumn("is_artifact", near & ((F.col("target") >= 0.8) | ~F.col("canonical")))


def deletion_artifact(length: Column, deleted: Column, seq: Column, at: Column, strand: Column, most: int = 3, flank: int = 5, richness: float = 0.7) -> Column:
    """Whether a deletion is an error inside a tail: short, not all As itself, and both
    flanks of the read (where whole) rich in As along the strand."""
    base = F.when(strand == "+", F.lit("A")).otherwise(F.lit("T"))
    count = lambda s: F.length(s) - F.length(F.replace(s, base, F.lit("")))
    left, right = S.window(seq, at - flank, at), S.window(seq, at, at + flank)
    rich = lambda s: (F.length(s) < flank) | (count(s) >= richness * F.length(s))
    return (length <= most) & (F.length(deleted) > 0) & (count(deleted) < F.length(deleted)) & (F.length(seq) >= 2 * flank) & rich(left) & rich(right)


def indel_correction(reads: DataFrame, genome: DataFrame, reach: int = 20, most: int = 3) -> DataFrame:
    """reads (read_id, chrom, strand, start, cigar, seq) with three_prime, corrected,
    correction_bp, n_deletions and n_insertions: each deletion near the 3' end (within reach
    of the read's end) that is an error inside a tail moves the end upstream by its length;
    short insertions there are counted only. The genome is joined by chromosome for reads
    that have a deletion near their end."""
    r = reads.withColumn("__ops", S.cigar_ops(F.col("cigar"))).withColumn("__end", S.reference_end(F.col("start"), F.col("__ops")))
    plus = F.col("strand") == "+"
    n = F.length("seq")
    near = lambda e: F.when(plus, e["read_pos"] >= F.greatest(n - reach, F.lit(0))).otherwise(e["read_pos"] <= F.least(n, F.lit(reach)))
    r = r.withColumn("__del", F.filter(S.cigar_events(F.col("start"), F.col("__ops"), "D"), lambda e: near(e) & (e["len"] <= most)))
    r = r.withColumn("__ins", F.size(F.filter(S.cigar_events(F.col("start"), F.col("__ops"), "I"), lambda e: near(e) & (e["len"] <= most))))
    held = r.where(F.size("__del") > 0).join(genome.select("chrom", F.col("seq").alias("__g")), "chrom", "left")
    bad = F.filter("__del", lambda e: deletion_artifact(e["len"], F.coalesce(S.window(F.col("__g"), e["ref_pos"].cast("int"), (e["ref_pos"] + e["len"]).cast("int")), F.lit("")), F.col("seq"), e["read_pos"].cast("int"), F.col("strand"), most))
    moved = held.withColumn("__bad", bad).drop("__g").unionByName(r.where(F.size("__del") == 0).withColumn("__bad", F.col("__del")))
    size = F.aggregate("__bad", F.lit(0).cast("long"), lambda acc, e: acc + e["len"])
    three = S.three_prime(F.col("start"), F.col("__end"), F.col("strand"))
    step = F.when(plus, -size).otherwise(size)
    return moved.withColumns({"three_prime": three, "corrected": three + step, "correction_bp": step, "n_deletions": F.size("__bad"), "n_insertions": F.col("__ins")}).drop("__ops", "__end", "__del", "__ins", "__bad")


def walk_back_ends(reads: DataFrame, genome: DataFrame) -> DataFrame:
    """reads (read_id, chrom, strand, start, cigar, seq) with the 3' end that the walk back
    along the aligned bases gives (corrected). Reads of a chromosome that the genome lacks
    keep theirs."""
    from ..functions.udfs import walk_back

    r = reads.withColumn("__end", S.reference_end(F.col("start"), S.cigar_ops(F.col("cigar"))))
    r = r.join(genome.select("chrom", F.col("seq").alias("__g")), "chrom", "left").withColumn("__g", S.window(F.col("__g"), F.col("start").cast("int"), F.col("__end").cast("int")))
    three = S.three_prime(F.col("start"), F.col("__end"), F.col("strand"))
    return r.withColumn("corrected", F.coalesce(walk_back("cigar", "seq", "__g", "start", "strand"), three)).drop("__g", "__end")


def oligo_a(ops: Column, seq: Column, strand: Column) -> Column:
    """As of an oligo(A) end that were aligned as explicit mismatches (X) at the 3' end."""
    trimmed = F.when(strand == "+", F.reverse(ops)).otherwise(ops)
    clip = F.when(trimmed[0]["op"] == "S", trimmed[0]["len"]).otherwise(0)
    first = F.when(trimmed[0]["op"] == "S", F.get(trimmed, F.lit(1))).otherwise(F.get(trimmed, F.lit(0)))
    size = F.when(first["op"] == "X", first["len"]).otherwise(0)
    tail = F.when(strand == "+", F.reverse(S.window(seq, F.length(seq) - clip - size, F.length(seq) - clip))).otherwise(S.window(seq, clip, clip + size))
    base = F.when(strand == "+", F.lit("A")).otherwise(F.lit("T"))
    return F.length(tail) - F.length(F.ltrim(tail, base))


def canonical_tier(five: Column, three: Column) -> Column:
    """0 to 3 for usable splice sites, 4 for all others."""
    return F.when((five == "GT") & (three == "AG"), 0).when((five == "GC") & (three == "AG"), 1).when((five == "AT") & (three == "AC"), 2).when((five == "GT") | (three == "AG"), 3).otherwise(4)


def refine_junctions(reads: DataFrame, pool: DataFrame, genome: DataFrame, radius: int = 10, flank: int = 12, penalties: dict[str, dict[int, float]] | None = None) -> DataFrame:
    """The best candidate for each junction of each read: read_id, chrom, strand, j_start,
    j_end, new_start, new_end.

    reads: read_id, chrom, strand, j_start, j_end, before, after (query flanks); pool:
    chrom, strand, p_start, p_end, annotated. Candidates have both ends within radius of the
    read's; the read's own junction is always one. Score: homopolymer-aware distance of the
    query's flanks to the exon ends, with gaps in runs by a table of penalties where one is
    given. Where the current junction is canonical it wins ties,
    else canonical candidates win with a discount of one half.
    """
    own = reads.select("chrom", "strand", F.col("j_start").alias("p_start"), F.col("j_end").alias("p_end"), F.lit(False).alias("annotated"))
    every = pool.unionByName(own).groupBy("chrom", "strand", "p_start", "p_end").agg(F.max("annotated").alias("annotated"))
    g = every.join(genome.select("chrom", "seq"), "chrom")
    left, right = S.window(F.col("seq"), F.col("p_start"), F.col("p_start") + 2), S.window(F.col("seq"), F.col("p_end") - 2, F.col("p_end"))
    plus = F.col("strand") == "+"
    tier = canonical_tier(F.when(plus, left).otherwise(S.revcomp(right)), F.when(plus, right).otherwise(S.revcomp(left)))
    sites = g.select("chrom", "strand", "p_start", "p_end", "annotated", tier.alias("tier"), S.window(F.col("seq"), F.col("p_start") - flank, F.col("p_start")).alias("exon1"), S.window(F.col("seq"), F.col("p_end"), F.col("p_end") + flank).alias("exon2"))
    binned = sites.withColumn("bin", F.explode(F.array(*[F.floor(F.col("p_start") / radius) + k for k in (-1, 0, 1)])))
    q = reads.withColumn("bin", F.floor(F.col("j_start") / radius))
    pairs = q.join(binned, ["chrom", "strand", "bin"]).where((F.abs(F.col("p_start") - F.col("j_start")) <= radius) & (F.abs(F.col("p_end") - F.col("j_end")) <= radius))
    distance = hp_edit_distance if penalties is None else hp_edit_distance_by(penalties)
    scored = pairs.withColumn("score", distance(F.substring("before", -flank, flank), "exon1") + distance(F.substring("after", 1, flank), "exon2"))
    mine = (F.col("p_start") == F.col("j_start")) & (F.col("p_end") == F.col("j_end"))
    w = Window.partitionBy("read_id", "chrom", "strand", "j_start", "j_end")
    current = F.max(F.when(mine, F.col("tier"))).over(w)
    s = scored.withColumn("current", current).withColumn("is_alt", (~mine).cast("int")).withColumn("novel", (~F.col("annotated")).cast("int"))
    weak = F.col("current") >= 4
    key = F.struct(
        (F.col("score") - F.when(weak & (F.col("tier") < 4), 0.5).otherwise(0.0)).alias("score"), F.when(weak, F.col("tier")).otherwise(F.col("is_alt")).alias("a"), F.when(weak, F.col("is_alt")).otherwise(F.col("tier")).alias("b"), "novel",
        (F.abs(F.col("p_start") - F.col("j_start")) + F.abs(F.col("p_end") - F.col("j_end"))).alias("delta"), "p_start", "p_end",
    )
    return s.groupBy("read_id", "chrom", "strand", "j_start", "j_end").agg(F.min(key).alias("k")).select("read_id", "chrom", "strand", "j_start", "j_end", F.col("k.p_start").alias("new_start"), F.col("k.p_end").alias("new_end"))


def rescue_five_prime(reads: DataFrame, known: DataFrame, genome: DataFrame, reach: int = 10, least: int = 4) -> DataFrame:
    """Soft-clipped 5' bases that continue in the exon beyond a known junction: read_id,
    five_prime (rescued), intron_start, intron_end, distance.

    reads: read_id, chrom, strand, start, end, clip (clipped bases at the 5' end, genome
    orientation); known: chrom, strand, k_start, k_end. A junction fits if its exon-side end
    lies within reach of the read's 5' end; it is accepted if the clip matches the far exon
    exactly, or better by three tenths than the intron. Ties: distance, shift, place.
    """
    plus = F.col("strand") == "+"
    r = reads.where(F.length("clip") >= least).withColumn("edge", F.when(plus, F.col("start")).otherwise(F.col("end"))).withColumn("bin", F.floor(F.col("edge") / reach))
    k = known.withColumn("near", F.when(plus, F.col("k_end")).otherwise(F.col("k_start"))).withColumn("bin", F.explode(F.array(*[F.floor(F.col("near") / reach) + i for i in (-1, 0, 1)])))
    pairs = r.join(k, ["chrom", "strand", "bin"]).where(F.abs(F.col("near") - F.col("edge")) <= reach).join(genome.select("chrom", "seq"), "chrom")
    n = F.length("clip")
    exon = F.when(plus, S.window(F.col("seq"), F.col("k_start") - n, F.col("k_start"))).otherwise(S.window(F.col("seq"), F.col("k_end"), F.col("k_end") + n))
    intron = F.when(plus, S.window(F.col("seq"), F.col("edge") - n, F.col("edge"))).otherwise(S.window(F.col("seq"), F.col("edge"), F.col("edge") + n))
    scored = pairs.withColumns({"distance": F.levenshtein("clip", exon), "other": F.levenshtein("clip", intron)}).where((F.col("distance") == 0) | (F.col("distance") < 0.7 * F.col("other")))
    key = F.struct("distance", F.abs(F.col("near") - F.col("edge")).alias("shift"), "k_start", "k_end", F.when(plus, F.col("k_start") - n).otherwise(F.col("k_end") + n - 1).alias("five_prime"))
    return scored.groupBy("read_id").agg(F.min(key).alias("k")).select("read_id", F.col("k.five_prime").alias("five_prime"), F.col("k.k_start").alias("intron_start"), F.col("k.k_end").alias("intron_end"), F.col("k.distance").alias("distance"))


def five_prime_cases(reads: DataFrame, known: DataFrame, genome: DataFrame, reach: int = 10, least: int = 4) -> DataFrame:
    """reads (read_id, chrom, strand, start, end, clip, junctions) with five_prime, the 5' end
    (inclusive), intron_start, intron_end and kind.

    softclip: the clip continues in the exon beyond a known junction (``rescue_five_prime``).
    intronic_snap: else, an end inside a known intron that none of the read's own junctions
    spans moves to the intron's other edge, the last base of the exon before it. proximity:
    else, an end within reach of a known 3' splice site keeps its place, and the junction is
    named. none: all others. Of several introns the lowest start, then end, counts."""
    from .intervals import point_in_interval

    plus = F.col("strand") == "+"
    five = S.five_prime(F.col("start"), F.col("end"), F.col("strand"))
    own = reads.withColumn("__five", five)
    introns = known.select("chrom", "strand", "k_start", "k_end").distinct()
    first = rescue_five_prime(reads.drop("junctions"), introns, genome, reach, least).select("read_id", F.struct("five_prime", "intron_start", "intron_end").alias("__a"))
    least_of = lambda df, name: df.groupBy("read_id").agg(F.min(F.struct("k_start", "k_end")).alias(name))
    spanned = F.exists("junctions", lambda j: (j["start"] <= F.col("__five")) & (F.col("__five") < j["end"]))
    inside = point_in_interval(own.where(~spanned).select("read_id", "chrom", "strand", "__five"), introns, ["chrom", "strand"], "__five", "k_start", "k_end", half_open=True)
    edge = own.withColumn("__edge", F.when(plus, F.col("start")).otherwise(F.col("end"))).withColumn("__bin", F.floor(F.col("__edge") / reach))
    sites = introns.withColumn("__near", F.when(plus, F.col("k_end")).otherwise(F.col("k_start"))).withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__near") / reach) + i for i in (-1, 0, 1)])))
    close = edge.select("read_id", "chrom", "strand", "__edge", "__bin").join(sites, ["chrom", "strand", "__bin"]).where(F.abs(F.col("__near") - F.col("__edge")) <= reach)
    out = own.join(first, "read_id", "left").join(least_of(inside, "__b"), "read_id", "left").join(least_of(close, "__c"), "read_id", "left")
    snapped = F.when(plus, F.col("__b.k_start") - 1).otherwise(F.col("__b.k_end"))
    kind = F.when(F.col("__a").isNotNull(), "softclip").when(F.col("__b").isNotNull(), "intronic_snap").when(F.col("__c").isNotNull(), "proximity").otherwise("none")
    return out.withColumns(
        {"five_prime": F.coalesce(F.col("__a.five_prime").cast("long"), snapped, F.col("__five").cast("long")), "intron_start": F.coalesce("__a.intron_start", "__b.k_start", "__c.k_start"), "intron_end": F.coalesce("__a.intron_end", "__b.k_end", "__c.k_end"), "kind": kind}
    ).drop("__five", "__a", "__b", "__c")


def effective_clip(errors: Column, clip: Column, scan: int = 25, size: int = 8, density: float = 0.4, least: int = 2) -> Column:
    """Clipped bases plus the error-rich stretch behind them. errors: array of 0/1 for the
    first aligned bases from the 5' end. Windows step inwards while so dense; the stretch ends
    with its last error."""
    e = F.slice(errors, 1, scan)
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size(e) - size + 1, F.lit(1))), lambda i: F.aggregate(F.slice(e, i, F.lit(size)), F.lit(0), lambda a, x: a + x))
    run = F.aggregate(sums, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, v: F.struct(F.when(a["on"] & (v >= density * size), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (v >= density * size)).alias("on")))["n"]
    inside = F.slice(e, F.lit(1), F.when(run > 0, run + size - 1).otherwise(0))
    last = F.coalesce(F.array_max(F.transform(inside, lambda x, i: F.when(x == 1, i + 1))), F.lit(0))
    total = F.aggregate(inside, F.lit(0), lambda a, x: a + x)
    return F.when(total >= least, clip + last).otherwise(clip)


def empirical_psf(windows: DataFrame, signal: str = "signal") -> DataFrame:
    """offset, weight: the mean over sites of each site's signal as shares."""
    total = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x)
    shares = windows.withColumn("__t", total).where("__t > 0").select(F.posexplode(F.transform(signal, lambda x: x / F.col("__t"))).alias("offset", "share"))
    return shares.groupBy("offset").agg(F.avg("share").alias("weight"))


def tract_regions(positions: DataFrame, keys: list[str], pos: str, gap: int = 20, least_as: int = 3, least_total: float = 10) -> DataFrame:
    """Single-linkage regions of positions with enough downstream As: keys, start, end, total.
    positions: keys, pos, a_count, count."""
    from .clustering import islands

    marked = islands(positions.where(F.col("a_count") >= least_as), keys, pos, gap, "__i")
    return marked.groupBy(*keys, "__i").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.sum("count").alias("total")).where(F.col("total") >= least_total).drop("__i")


def rescue_mismatches(reads: DataFrame, genome: DataFrame, least: int = 3) -> DataFrame:
    """reads (read_id, chrom, strand, start, cigar, seq) with corrected: where an alignment that
    was forced to its end stops inside a genomic run of at least ``least`` equal bases, the
    read's first other base inwards is its 3' end. Others, and reads of a chromosome that the
    genome lacks, keep theirs."""
    from ..functions.udfs import mismatch_in_run

    plus = F.col("strand") == "+"
    r = reads.withColumn("__end", S.reference_end(F.col("start"), S.cigar_ops(F.col("cigar"))))
    three = S.three_prime(F.col("start"), F.col("__end"), F.col("strand")).cast("int")
    r = r.join(genome.select("chrom", F.upper("seq").alias("__all")), "chrom", "left")
    ahead = F.when(plus, S.window(F.col("__all"), three, three + least)).otherwise(S.revcomp(S.window(F.col("__all"), three - least + 1, three + 1)))
    r = r.withColumns({"__g": S.window(F.col("__all"), F.col("start").cast("int"), F.col("__end").cast("int")), "__out": F.when(F.length(ahead) == least, ahead).otherwise("")})
    return r.withColumn("corrected", F.coalesce(mismatch_in_run("cigar", "seq", "__g", "start", "strand", "__out"), three.cast("long"))).drop("__all", "__g", "__out", "__end")


def _common_prefix(a: Column, b: Column) -> Column:
    """How many first characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    first = F.array_position(same, F.lit(False))
    return F.when(n == 0, F.lit(0)).when(first > 0, first.cast("int") - 1).otherwise(n)


def rescue_clips(reads: DataFrame, genome: DataFrame, end: str = "three_prime", least: int = 3, most_prefix: int = 5) -> DataFrame:
    """reads (read_id, chrom, strand, cigar, seq and the 3' end in ``end``) with rescued (the
    end moved outwards), rescued_bases, extension and rescue (homopolymer, prefix or null).

    homopolymer: the alignment ends in a run of at least ``least`` equal bases; what is left of
    that run in the genome is skipped (extension), and the clip is matched from there until
    it differs or its first run of ``least`` As begins, which is the tail. A rescued end is
    never a genomic A. prefix: else, where a clip of five or more is seven tenths As, up to
    most_prefix As that genome and clip share count to the transcript. All is seen along the
    strand, so both strands have one rule.
    """
    plus = F.col("strand") == "+"
    ops = S.cigar_ops(F.col("cigar"))
    clip = F.filter(S.soft_clips(ops, F.col("seq")), lambda c: c["side"] == F.when(plus, "right").otherwise("left"))
    r = reads.withColumn("__clip", F.coalesce(F.upper(F.get(clip, F.lit(0))["seq"]), F.lit("")))
    held = r.where(F.length("__clip") > 0).join(genome.select("chrom", F.upper("seq").alias("__g")), "chrom", "left")
    at, n = F.col(end).cast("int"), F.length("__clip")
    reach = 2 * n + 10
    out = F.when(plus, S.window(F.col("__g"), at + 1, at + 1 + reach)).otherwise(S.revcomp(S.window(F.col("__g"), at - reach, at)))
    into = F.when(plus, S.window(F.col("__g"), at - least + 1, at + 1)).otherwise(S.revcomp(S.window(F.col("__g"), at, at + least)))
    held = held.withColumns({"__clip": F.when(plus, F.col("__clip")).otherwise(S.revcomp(F.col("__clip"))), "__out": F.coalesce(out, F.lit("")), "__in": F.coalesce(into, F.lit(""))})
    base = F.substring("__in", -1, 1)
    run = (F.length("__in") == least) & (F.length(F.ltrim(F.col("__in"), base)) == 0)
    held = held.withColumn("__ext", F.when(run, F.least(F.length("__out") - F.length(F.ltrim(F.col("__out"), base)), n + 9)).otherwise(0))
    held = held.withColumn("__rest", F.substring(F.col("__out"), F.col("__ext") + 1, F.length("__out")))
    held = held.withColumn("__same", F.when(run, _common_prefix(F.col("__clip"), F.col("__rest"))).otherwise(0)).withColumn("__tail", F.instr(F.col("__clip"), "A" * least) - 1)
    matched = F.when((F.col("__tail") >= 0) & (F.col("__same") >= F.col("__tail") + least - 1), F.col("__tail")).otherwise(F.col("__same"))
    kept = F.length(F.rtrim(F.substring(F.col("__rest"), F.lit(1), matched), F.lit("A")))
    held = held.withColumn("__kept", kept)
    first = lambda c: F.length(c) - F.length(F.ltrim(F.col(c), F.lit("A")))
    tail = (n >= 5) & (S.count_base(F.col("__clip"), "A") >= 0.7 * n)
    prefix = F.when((F.col("__kept") == 0) & tail, F.least(first("__clip"), first("__out"), F.lit(most_prefix))).otherwise(0)
    held = held.withColumn("__prefix", prefix)
    shift = F.when(F.col("__kept") > 0, F.col("__ext") + F.col("__kept")).otherwise(F.col("__prefix"))
    kind = F.when(F.col("__kept") > 0, "homopolymer").when(F.col("__prefix") > 0, "prefix")
    done = held.withColumns({"rescued": (F.col(end) + F.when(plus, shift).otherwise(-shift)).cast("long"), "rescued_bases": shift, "extension": F.when(F.col("__kept") > 0, F.col("__ext")).otherwise(0), "rescue": kind})
    none = r.where(F.length("__clip") == 0).withColumns({"rescued": F.col(end).cast("long"), "rescued_bases": F.lit(0), "extension": F.lit(0), "rescue": F.lit(None).cast("string")})
    columns = [*reads.columns, "rescued", "rescued_bases", "extension", "rescue"]
    return done.select(columns).unionByName(none.select(columns))


def corrected_records(records: DataFrame, ends: DataFrame) -> DataFrame:
    """Alignment records (``sources.alignments.SCHEMA``) whose 3' ends are those of ends
    (read_id, corrected): clipped or extended to them, with the tag cp and the old end in
    op. Of several ends of a read the least counts; records without one stay as they are."""
    from ..functions.udfs import reclip

    one = ends.groupBy(F.col("read_id").alias("name")).agg(F.min("corrected").alias("__c"))
    strand = F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-")
    r = records.join(one, "name", "left").withColumn("__s", strand)
    r = r.withColumn("__old", S.three_prime(F.col("start"), S.reference_end(F.col("start"), S.cigar_ops(F.col("cigar"))), F.col("__s")))
    moved = (F.col("__c").isNotNull()) & (F.col("__c") != F.col("__old"))
    r = r.withColumn("__n", F.when(moved, reclip("cigar", "start", "__s", "__c")))
    tags = F.map_concat(F.map_filter(F.coalesce("tags", F.expr("CAST(map() AS map<string,string>)")), lambda k, _: ~k.isin("cp", "op")), F.create_map(F.lit("cp"), F.col("__c").cast("string"), F.lit("op"), F.col("__old").cast("string")))
    return r.withColumns({"start": F.coalesce("__n.start", "start"), "cigar": F.coalesce("__n.cigar", "cigar"), "tags": F.when(moved, tags).otherwise(F.col("tags"))}).drop("__c", "__s", "__old", "__n")
