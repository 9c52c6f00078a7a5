"""Queries on sequences, signals and text kernels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import udfs as U
from ..operators import clustering as C
from ..operators import evidence as E
from ..operators import genes as G
from ..operators import signal as X
from .analogs import DNA_SQL, GENES_SQL, READS_SQL, dna, genes, reads, table

KEYS = ["chrom", "strand"]
_DNA = "WITH " + DNA_SQL.strip()
_READS = "WITH " + READS_SQL.strip()


def revcomp(s, d) -> DataFrame:
    return dna(s, d).select("doc_id", F.md5(S.revcomp(F.col("seq"))).alias("digest"), S.count_base(F.col("seq"), "GC").cast("long").alias("gc"))


def _sites(s, d) -> DataFrame:
    return dna(s, d).withColumn("position", F.col("doc_id") % 97).withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"))


_SITES = _DNA + """,
sites AS (SELECT *, doc_id % 97 AS position, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM dna),
w AS (
  SELECT *, CASE WHEN strand = '+' THEN substring(seq, position + 2, 50) ELSE reverse(translate(substring(seq, greatest(position - 50, 0) + 1, position - greatest(position - 50, 0)), 'ACGT', 'TGCA')) END AS down50,
         CASE WHEN strand = '+' THEN substring(seq, position + 2, 10) ELSE reverse(translate(substring(seq, greatest(position - 10, 0) + 1, position - greatest(position - 10, 0)), 'ACGT', 'TGCA')) END AS down10,
         CASE WHEN strand = '+' THEN 'A' ELSE 'T' END AS base,
         substring(seq, position + 2, 10) AS after10, reverse(substring(seq, greatest(position - 10, 0) + 1, position - greatest(position - 10, 0))) AS before10
  FROM sites
)
"""


def mispriming(s, d) -> DataFrame:
    return _sites(s, d).select("doc_id", S.mispriming(F.col("seq"), F.col("position"), F.col("strand")).alias("m")).select("doc_id", F.col("m.window_size").cast("long").alias("window_size"), F.round(F.coalesce("m.ag_content", F.lit(-1.0)), 6).alias("ag_content"), "m.misprimed", "m.confidence")


_MISPRIMING = _SITES + """
SELECT doc_id, length(down50) AS window_size, CASE WHEN length(down50) >= 20 THEN round(len(regexp_extract_all(down50, '[AG]')) / length(down50), 6) ELSE -1.0 END AS ag_content,
       coalesce(length(down50) >= 20 AND len(regexp_extract_all(down50, '[AG]')) / length(down50) >= 0.65, false) AS misprimed,
       CASE WHEN length(down50) < 20 THEN 'low' WHEN len(regexp_extract_all(down50, '[AG]')) / length(down50) >= 0.75 THEN 'high' WHEN len(regexp_extract_all(down50, '[AG]')) / length(down50) >= 0.65 THEN 'medium' ELSE 'low' END AS confidence
FROM w
"""


def ambiguity(s, d) -> DataFrame:
    a = _sites(s, d).where(F.col("position") < F.length("seq")).select("doc_id", S.tract_ambiguity(F.col("seq"), F.col("position"), F.col("strand")).alias("t"))
    return a.select("doc_id", F.col("t.a_count").cast("long").alias("a_count"), F.col("t.tract").cast("long").alias("tract"), "t.lo", "t.hi")


_AMBIGUITY = _SITES + """,
t AS (
  SELECT *, len(regexp_extract_all(down10, 'A')) AS a_count,
         CASE WHEN substring(seq, position + 1, 1) = base THEN 1 + length(after10) - length(ltrim(after10, base)) + length(before10) - length(ltrim(before10, base)) ELSE 0 END AS tract
  FROM w WHERE position < length(seq)
),
v AS (SELECT *, CASE WHEN tract = 0 THEN 0.0 ELSE [0.0, 0.2, 0.3, 0.4, 1.0, 1.3, 1.7, 2.6, 2.8, 2.9, 3.8][least(a_count, 10) + 1] END AS shift FROM t)
SELECT doc_id, a_count, tract,
       CASE WHEN tract > 0 AND strand = '+' THEN greatest(0, least(CAST(trunc(position - shift) AS BIGINT), length(seq) - 1)) ELSE position END AS lo,
       CASE WHEN tract > 0 AND strand = '-' THEN greatest(0, least(CAST(ceil(position + shift) AS BIGINT), length(seq) - 1)) ELSE position END AS hi
FROM v
"""


def richness(s, d) -> DataFrame:
    return dna(s, d).select("doc_id", F.round(U.max_richness("seq"), 6).alias("richness"), S.has_adapter(F.col("seq")).alias("adapter"))


_RICH = _DNA + """
SELECT doc_id, round(CASE WHEN length(seq) = 0 THEN 0.0 WHEN length(seq) <= 10 THEN len(regexp_extract_all(seq, 'A')) / length(seq)
       ELSE list_max(list_transform(range(1, length(seq) - 8), lambda i: length(seq[i:i + 9]) - length(replace(seq[i:i + 9], 'A', '')))) / 10 END, 6) AS richness,
       regexp_matches(seq, 'TTTTTT|TC') AS adapter FROM dna
"""


def polya_score(s, d) -> DataFrame:
    return dna(s, d).select("doc_id", F.round(S.polya_score(F.col("seq"), threshold=0.5, mean=1500.0, spread=900.0), 6).alias("score"))


_POLYA = _DNA + """,
r AS (SELECT doc_id, seq, CASE WHEN length(seq) = 0 THEN 0.0 WHEN length(seq) <= 10 THEN len(regexp_extract_all(seq, 'A')) / length(seq)
       ELSE list_max(list_transform(range(1, length(seq) - 8), lambda i: length(seq[i:i + 9]) - length(replace(seq[i:i + 9], 'A', '')))) / 10 END AS rich FROM dna)
SELECT doc_id, round(CASE WHEN rich >= 0.5 THEN 0.5 * least(1.0, rich / 0.5) + 0.3 * exp(-pow((length(seq) - 1500.0) / 900.0, 2) / 2) + 0.2 * CASE WHEN length(seq) > 0 THEN len(regexp_extract_all(seq, 'A')) / length(seq) ELSE 0 END ELSE 0 END, 6) AS score FROM r
"""


def motif_scan(s, d) -> DataFrame:
    hits = dna(s, d).select("doc_id", F.explode(U.motif_scan("seq", F.lit("TATAWR"))).alias("h"))
    return hits.select("doc_id", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), F.col("h.strand").alias("strand"))


def tail_scan(s, d) -> DataFrame:
    return dna(s, d).select("doc_id", S.tail_adapter(F.col("seq")).alias("t")).select("doc_id", "t.tail", "t.adapter", "t.pass")


_TAIL = _DNA + """,
w AS (SELECT doc_id, right(seq, 150) AS w, length(regexp_extract(right(seq, 150), 'T[CT]{0,10}$')) AS stub FROM dna),
b AS (SELECT doc_id, stub, left(w, length(w) - stub) AS body FROM w),
t AS (
  SELECT doc_id, stub, body, length(body) - length(rtrim(body, 'A')) AS own,
         list_filter(range(1, 16), lambda k: k < length(body) AND contains(right(body, k), 'T') AND length(left(body, length(body) - k)) - length(rtrim(left(body, length(body) - k), 'A')) >= 5)[1] AS k FROM b
)
SELECT doc_id, CAST(CASE WHEN own > 0 THEN own WHEN k IS NOT NULL THEN length(left(body, length(body) - k)) - length(rtrim(left(body, length(body) - k), 'A')) ELSE 0 END AS INT) AS tail,
       CAST(CASE WHEN own = 0 AND k IS NOT NULL THEN least(k + stub, 150) ELSE stub END AS INT) AS adapter,
       CAST(CASE WHEN own = 0 AND k IS NOT NULL THEN 2 WHEN stub > 0 THEN 1 ELSE 0 END AS INT) AS pass FROM t
"""


def splice_motifs(s, d) -> DataFrame:
    five, three = S.SPLICE_SITES["yeast"]["five"], S.SPLICE_SITES["yeast"]["three"]
    q = dna(s, d).where(F.length("seq") >= 20)
    last = F.substring("seq", F.length("seq") - 4, F.lit(5))
    out = q.select("doc_id", S.motif_penalty(F.col("seq"), *five).alias("five"), S.motif_penalty(last, *three).alias("three"), S.splice_class(F.substring("seq", 1, 2), F.substring("seq", F.length("seq") - 1, F.lit(2))).alias("kind"))
    return out


_SPLICE = _DNA + " SELECT doc_id, " + " + ".join(f"CASE WHEN seq[{i + 1}] = '{c}' THEN 0.0 ELSE {p} END" for i, (c, p) in enumerate(zip("GTATGT", [4.0, 3.0, 1.0, 1.0, 2.0, 1.0]))) + " AS five, " + " + ".join(f"CASE WHEN seq[length(seq) - {4 - i}] IN ({c}) THEN 0.0 ELSE {p} END" for i, (c, p) in enumerate(zip(["'C','T'"] * 3 + ["'A'", "'G'"], [1.0, 1.0, 1.0, 3.0, 4.0]))) + ", CASE WHEN seq[1:2] = 'GT' AND seq[-2:] = 'AG' THEN 'GT-AG' WHEN seq[1:2] = 'GC' AND seq[-2:] = 'AG' THEN 'GC-AG' WHEN seq[1:2] = 'AT' AND seq[-2:] = 'AC' THEN 'AT-AC' ELSE 'non-canonical' END AS kind FROM dna WHERE length(seq) >= 20"
_SPLICE = _SPLICE.replace(", CASE WHEN seq[1:2]", " AS three, CASE WHEN seq[1:2]", 1)


def levenshtein(s, d) -> DataFrame:
    part = table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))
    return part


def sliding_edit(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", S.sliding_edit(F.lit("brass"), F.lower("p_type")).cast("long").alias("distance"))


def hp_edit(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.round(U.hp_edit_distance("p_name", "p_brand"), 6).alias("distance"))


def affine(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", U.affine_cigar("p_brand", "p_type").alias("a")).select("p_partkey", F.col("a.score").cast("long").alias("score"), "a.cigar")


def walk_back(s, d) -> DataFrame:
    """Whole sequences with a tail of 20 As, aligned to a genome that goes on with As; a
    sequence without a base other than A (an empty one too) keeps the mapped end."""
    read = F.concat("seq", F.rpad(F.lit(""), 20, "A"))
    cigar = F.concat(F.length(read).cast("string"), F.lit("M"))
    return dna(s, d).select("doc_id", U.walk_back(cigar, read, read, F.lit(0).cast("long"), F.lit("+")).alias("position"))


def confidence_flags(s, d) -> DataFrame:
    r = reads(s, d).select(S.signal_confidence(F.col("weight") * 15, F.col("span") % 5).alias("confidence"))
    return r.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def full_length(s, d) -> DataFrame:
    r = reads(s, d).select(S.full_length(F.col("position"), F.col("position") + 10 * F.col("span"), F.col("span") * 2, F.col("line"), F.col("span") * 15).alias("f"))
    return r.groupBy("f.is_full_length").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f.confidence"), 6).alias("confidence"))


_FULL = _READS + """,
v AS (SELECT span * 2 AS c5, 10.0 * span / (10 * span + 2 * span + line) AS frac, span * 15 AS dist FROM reads),
f AS (SELECT c5 <= 50 AND frac >= 0.8 AND dist <= 500 AS is_full_length,
      greatest(0.0, 1 - CASE WHEN c5 > 50 THEN least(0.4, (c5 - 50) / 100) ELSE 0 END - CASE WHEN frac < 0.8 THEN least(0.4, (0.8 - frac) / 0.3) ELSE 0 END - CASE WHEN dist > 500 THEN least(0.3, (dist - 500) / 1000) ELSE 0 END) AS c FROM v)
SELECT is_full_length, count(*) AS n, round(avg(c), 6) AS confidence FROM f GROUP BY is_full_length
"""


def tail_training(s, d) -> DataFrame:
    q = dna(s, d).select(U.max_richness("seq").alias("richness"), F.length("seq").alias("length"))
    t = G.tail_training(q)
    return t.select("n", *[F.round(c, 6).alias(c) for c in ("mean_richness", "sd_richness", "mean_length", "threshold")])


_TRAIN = _DNA + """,
r AS (SELECT length(seq) AS n, CASE WHEN length(seq) = 0 THEN 0.0 WHEN length(seq) <= 10 THEN len(regexp_extract_all(seq, 'A')) / length(seq)
       ELSE list_max(list_transform(range(1, length(seq) - 8), lambda i: length(seq[i:i + 9]) - length(replace(seq[i:i + 9], 'A', '')))) / 10 END AS rich FROM dna)
SELECT count(*) AS n, round(avg(rich), 6) AS mean_richness, round(stddev_samp(rich), 6) AS sd_richness, round(avg(n), 6) AS mean_length, round(greatest(0.6, least(0.95, quantile_cont(rich, 0.1) - 0.05)), 6) AS threshold FROM r
"""


def _counted(s, d) -> DataFrame:
    return C.position_counts(reads(s, d), [*KEYS, "position"], name="n")


def local_maxima(s, d) -> DataFrame:
    c = _counted(s, d).withColumn("locus", F.floor(F.col("position") / 370))
    return X.local_maxima(c, [*KEYS, "locus"], "position", "n").drop("locus")


_PEAKS = _READS + """,
c AS (SELECT chrom, strand, position, position // 370 AS locus, count(*) AS n FROM reads GROUP BY ALL),
m AS (SELECT *, lag(n) OVER w AS l, lead(n) OVER w AS r, min(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ml, min(n) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS mr, max(n) OVER (PARTITION BY chrom, strand, locus) AS t FROM c WINDOW w AS (PARTITION BY chrom, strand, locus ORDER BY position)),
peaks AS (SELECT chrom, strand, locus, position, n, n - least(ml, mr) AS prominence FROM m WHERE n > l AND n > r AND n >= 0.5 * t)
"""


def best_peak(s, d) -> DataFrame:
    c = _counted(s, d).withColumn("locus", F.floor(F.col("position") / 370))
    return X.best_peak(X.local_maxima(c, [*KEYS, "locus"], "position", "n"), [*KEYS, "locus"], "position", "n").drop("locus")


def _loci(s, d) -> DataFrame:
    return genes(s, d).select(*KEYS, F.col("gene_3prime").alias("center")).distinct()


def metagene_center(s, d) -> DataFrame:
    m = X.metagene(_loci(s, d), _counted(s, d), KEYS, "center", "position", "n", 20)
    return m.select("offset", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


def metagene_capped(s, d) -> DataFrame:
    m = X.metagene(_loci(s, d), _counted(s, d), KEYS, "center", "position", "n", 20, cap=0.9)
    return m.select("offset", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


def _metagene_sql(value: str, cap: str) -> str:
    return _READS + "," + GENES_SQL + f""",
c AS (SELECT chrom, strand, position, count(*) AS n FROM reads GROUP BY ALL),
loci AS (SELECT DISTINCT chrom, strand, gene_3prime AS center FROM genes),
e AS (SELECT *, unnest(range(-20, 21)) AS o FROM loci),
h AS (SELECT o, coalesce(CAST(c.n AS DOUBLE), 0.0) AS v FROM e LEFT JOIN c ON c.chrom = e.chrom AND c.strand = e.strand AND c.position = center + CASE WHEN e.strand = '+' THEN o ELSE -o END){cap}
SELECT CAST(o AS INT) AS "offset", round(avg({value}), 6) AS mean, round(stddev_pop({value}) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM h GROUP BY o
"""


def trimmed_mean(s, d) -> DataFrame:
    return X.trimmed_mean(reads(s, d), ["chrom", "sample"], "weight", 0.1).withColumn("trimmed_mean", F.round("trimmed_mean", 6))


def replicate_sem(s, d) -> DataFrame:
    return X.replicate_sem(reads(s, d), ["chrom", "sample"], "span").select("chrom", "sample", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


def nnls(s, d) -> DataFrame:
    """Clusters' modal positions split over the ends that their read counts point to."""
    sites = C.cluster_fixed(reads(s, d), KEYS).select(*KEYS, F.col("modal_position").alias("site")).distinct()
    w = X.windows(sites, _counted(s, d), KEYS, "site", "position", "n", 10)
    return X.refine(w, KEYS, "site", 10, [0.54, 0.26, 0.12, 0.08]).withColumn("fraction", F.round("fraction", 6))


_CORES = (["ACGTAC", "TTGCAG", "GTACGT", "AAAGTT"], ["CATACG", "GGTACC", "TACGTA", "CCGGAA"])


def spikein_vote(s, d) -> DataFrame:
    """Documents by votes of two sets of 6-mers: at least two hits of one and fewer of the other."""
    v = dna(s, d).select("doc_id", E.spikein_votes(F.col("seq"), *_CORES).alias("v"))
    return v.select("doc_id", F.col("v.spikein").alias("x"), F.col("v.genomic").alias("y"), "v.kind")


def _votes(cores: list[str]) -> str:
    return " + ".join(f"CAST(contains(seq, '{c}') AS BIGINT)" for c in cores)


_SPIKE = _DNA + f", v AS (SELECT doc_id, {_votes(['ACGTAC', 'TTGCAG', 'GTACGT', 'AAAGTT'])} AS x, {_votes(['CATACG', 'GGTACC', 'TACGTA', 'CCGGAA'])} AS y FROM dna) SELECT *, CASE WHEN x >= 2 AND y < 2 THEN 'spikein' WHEN x < 2 AND y >= 2 THEN 'genomic' WHEN x < 2 AND y < 2 THEN 'none' WHEN x > y THEN 'spikein' WHEN y > x THEN 'genomic' ELSE 'ambiguous' END AS kind FROM v"


def spikein_infer(s, d) -> DataFrame:
    """The most frequent 12 bases after an anchor, with their support (ties: the first)."""
    return E.spikein_signature(dna(s, d), "seq", "GTACG")


def adapter_regex(s, d) -> DataFrame:
    return dna(s, d).select("doc_id", S.has_adapter(F.col("seq")).alias("adapter"), F.length(F.regexp_extract("seq", "T[CT]{0,10}$", 0)).cast("long").alias("stub"))


def hp_calibration(s, d) -> DataFrame:
    """Share of runs of each length and base that the next document's run of the same place
    makes shorter: deletions in homopolymers."""
    runs = dna(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit("(A+|C+|G+|T+)"), F.lit(1))).alias("place", "run"))
    r = runs.select("doc_id", "place", F.substring("run", 1, 1).alias("base"), F.length("run").alias("n"))
    pairs = r.join(r.select((F.col("doc_id") - 1).alias("doc_id"), "place", F.col("base").alias("other"), F.col("n").alias("m")), ["doc_id", "place"]).where("base = other")
    return G.homopolymer_penalties(pairs.select("base", F.least("n", F.lit(8)).alias("length"), (F.col("m") < F.col("n")).alias("deleted"))).select("base", F.col("length").cast("long").alias("length"), "n", F.round("rate", 6).alias("rate"), F.round("penalty", 6).alias("penalty"))


_HP = _DNA + """,
l AS (SELECT doc_id, regexp_extract_all(seq, '(A+|C+|G+|T+)') AS a FROM dna),
r AS (SELECT doc_id, unnest(range(len(a))) AS place, unnest(a) AS run FROM l),
p AS (
  SELECT x.run[1] AS base, least(length(x.run), 8) AS length, length(y.run) < length(x.run) AS deleted
  FROM r x JOIN r y ON y.doc_id = x.doc_id + 1 AND y.place = x.place AND y.run[1] = x.run[1]
),
g AS (SELECT base, length, count(*) AS n, (count(*) FILTER (deleted) + 1.0) / (count(*) + 2.0) AS rate FROM p GROUP BY ALL)
SELECT base, length, n, round(rate, 6) AS rate, round(-ln(rate) / -ln(0.01), 6) AS penalty FROM g
"""


def proportional_split(s, d) -> DataFrame:
    """Counts of ambiguous positions split over the cluster sites of their locus by share."""
    c = _counted(s, d).withColumn("locus", F.floor(F.col("position") / 370))
    unsure = c.where("n < 3").groupBy(*KEYS, "locus").agg(F.sum("n").alias("ambiguous"))
    sites = c.where("n >= 3")
    return X.proportional_split(sites, unsure, [*KEYS, "locus"], "n", "ambiguous").select(*KEYS, "position", F.round("assigned", 6).alias("assigned"))


_SPLIT = _READS + """,
c AS (SELECT chrom, strand, position, position // 370 AS locus, count(*) AS n FROM reads GROUP BY ALL),
u AS (SELECT chrom, strand, locus, sum(n) AS ambiguous FROM c WHERE n < 3 GROUP BY ALL)
SELECT s.chrom, s.strand, s.position, round(s.n + coalesce(u.ambiguous, 0) * s.n / sum(s.n) OVER (PARTITION BY s.chrom, s.strand, s.locus), 6) AS assigned
FROM (SELECT * FROM c WHERE n >= 3) s LEFT JOIN u ON s.chrom = u.chrom AND s.strand = u.strand AND s.locus = u.locus
"""


QUERIES = {
    "revcomp": (revcomp, _DNA + " SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest, CAST(len(regexp_extract_all(seq, '[GC]')) AS BIGINT) AS gc FROM dna"),
    "ag_mispriming": (mispriming, _MISPRIMING),
    "atract_ambiguity": (ambiguity, _AMBIGUITY),
    "a_richness_max": (richness, _RICH),
    "polya_score": (polya_score, _POLYA),
    "splice_motifs": (splice_motifs, _SPLICE),
    "motif_scan": (motif_scan, None),
    "polya_tail_scan": (tail_scan, _TAIL),
    "adapter_regex": (adapter_regex, _DNA + " SELECT doc_id, regexp_matches(seq, 'TTTTTT|TC') AS adapter, length(regexp_extract(seq, 'T[CT]{0,10}$')) AS stub FROM dna"),
    "hp_calibration": (hp_calibration, _HP),
    "proportional_split": (proportional_split, _SPLIT),
    "levenshtein_names": (levenshtein, "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part"),
    "sliding_edit": (sliding_edit, "SELECT p_partkey, list_min(list_transform(range(1, greatest(length(p_type) - 4, 1) + 1), lambda i: levenshtein('brass', substring(lower(p_type), i, 5)))) AS distance FROM part"),
    "hp_edit": (hp_edit, None),
    "affine_cigar": (affine, None),
    "walkback": (walk_back, _DNA + " SELECT doc_id, CAST(CASE WHEN length(rtrim(seq, 'A')) > 0 THEN length(rtrim(seq, 'A')) - 1 ELSE length(seq) + 19 END AS BIGINT) AS position FROM dna"),
    "confidence_flags": (confidence_flags, _READS + " SELECT CASE WHEN weight * 15 > 1 THEN 'high' WHEN weight * 15 > 0.5 THEN 'medium' WHEN span % 5 = 0 THEN 'high' WHEN span % 5 <= 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM reads GROUP BY 1"),
    "full_length": (full_length, _FULL),
    "tail_training": (tail_training, _TRAIN),
    "local_maxima": (local_maxima, _PEAKS + " SELECT chrom, strand, position, n, prominence FROM peaks"),
    "best_peak": (best_peak, _PEAKS + ", b AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, locus ORDER BY n DESC, prominence DESC, position) AS k FROM peaks) SELECT chrom, strand, position, n, prominence FROM b WHERE k = 1"),
    "metagene_center": (metagene_center, _metagene_sql("v", "")),
    "metagene_capped": (metagene_capped, _metagene_sql("least(v, (SELECT quantile_cont(v, 0.9) FROM h WHERE v > 0))", "")),
    "trimmed_mean": (trimmed_mean, _READS + ", r AS (SELECT chrom, sample, weight, row_number() OVER (PARTITION BY chrom, sample ORDER BY weight) AS k, count(*) OVER (PARTITION BY chrom, sample) AS n FROM reads) SELECT chrom, sample, round(avg(weight), 6) AS trimmed_mean FROM r WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY ALL"),
    "replicate_sem": (replicate_sem, _READS + " SELECT chrom, sample, round(avg(span), 6) AS mean, round(stddev_samp(span) / sqrt(count(*)), 6) AS sem FROM reads GROUP BY ALL"),
    "nnls_deconvolve": (nnls, None),
    "spikein_vote": (spikein_vote, _SPIKE),
    "spikein_infer": (spikein_infer, _DNA + ", h AS (SELECT unnest(regexp_extract_all(seq, 'GTACG([ACGT]{12})', 1)) AS tail FROM dna) SELECT tail, count(*) AS n FROM h GROUP BY tail ORDER BY n DESC, tail LIMIT 1"),
}
