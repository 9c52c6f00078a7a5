"""Queries on evidence, summaries, cascaded matches and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import chimeric as H
from ..operators import clustering as C
from ..operators import correction as R
from ..operators import evidence as E
from ..operators import genes as G
from ..operators import intervals as I
from ..operators import junctions as J
from ..operators import netseq as N
from ..operators import signal as X
from ..operators import stats as T
from ..sources.references import normalise_yeast
from .analogs import DNA_SQL, GENES_SQL, genes, reads, table
from .gene_queries import _COUNTS, _J, _KNOWN, _SHIFT, _WITH, KEYS, _counts, junctions, known, shift_jsd, support


def evidence(s, d) -> DataFrame:
    """Junctions with their reads, a mean of qualities and whether they are annotated."""
    j = junctions(s, d).withColumn("mapq", (F.col("read_id") % 61).cast("long"))
    k = j.where("read_id % 97 = 0").select(*KEYS, F.col("j_start").alias("k_start"), F.col("j_end").alias("k_end"))
    found = E.junction_evidence(j, k).withColumn("is_canonical", F.col("j_start") % 3 == 0)
    return E.valid_evidence(found).select(*J.JKEYS, "n_reads", F.round("mean_mapq", 6).alias("mean_mapq"), "annotated")


_EVIDENCE = _J + """,
e AS (SELECT chrom, strand, j_start, j_end, count(*) AS n_reads, round(avg(read_id % 61), 6) AS mean_mapq, count(*) FILTER (read_id % 97 = 0) > 0 AS annotated FROM junctions GROUP BY ALL)
SELECT * FROM e WHERE annotated OR (n_reads >= 2 AND j_start % 3 = 0)
"""


def _unsure(s, d) -> DataFrame:
    """Reads on introns of groups of three; those of lines over 4 fit all three."""
    r = reads(s, d).select("read_id", "line", (F.col("position") % 300).alias("intron"))
    name = lambda i: F.concat(F.lit("i"), F.lpad(i.cast("string"), 4, "0"))
    base = F.floor(F.col("intron") / 3) * 3
    group = F.array(name(base), name(base + 1), name(base + 2))
    return r.select("read_id", name(F.col("intron")).alias("intron_id"), F.when(F.col("line") > 4, F.filter(group, lambda g: g != name(F.col("intron")))).alias("alternatives"))


def ambiguous(s, d) -> DataFrame:
    out = E.ambiguous_counts(_unsure(s, d))
    return out.select("intron_id", "confident", "ambiguous", F.round("attributed", 6).alias("attributed"), F.round("total", 6).alias("total"))


_AMBIGUOUS = _WITH + """,
e AS (SELECT position % 300 AS intron, count(*) FILTER (line <= 4) AS confident, count(*) FILTER (line > 4) AS ambiguous FROM reads GROUP BY ALL),
g AS (SELECT *, sum(confident) OVER (PARTITION BY intron // 3) AS c, sum(ambiguous) OVER (PARTITION BY intron // 3) AS a FROM e)
SELECT 'i' || lpad(CAST(intron AS VARCHAR), 4, '0') AS intron_id, confident, ambiguous,
       round(ambiguous * CASE WHEN c > 0 THEN confident / c ELSE 1 / 3 END, 6) AS attributed, round(confident + ambiguous * CASE WHEN c > 0 THEN confident / c ELSE 1 / 3 END, 6) AS total FROM g
"""


def read_lists(s, d) -> DataFrame:
    r = reads(s, d).withColumn("place", F.col("position") % 5000)
    return E.ordered_list(r, ["chrom", "place"], "read_id", "reads", distinct=True).select("chrom", "place", F.md5(F.array_join(F.col("reads").cast("array<string>"), ",")).alias("digest"), F.size("reads").cast("long").alias("n"))


def enough(s, d) -> DataFrame:
    return E.enough_counts(_counts(s, d), 45, 4)


def categories(s, d) -> DataFrame:
    c = E.category_summary(reads(s, d).withColumn("span", F.col("span").cast("double")), "span", "aligner")
    return c.select("category", "n", F.round("mean", 6).alias("mean"), "median", "max")


def exclusion_shares(s, d) -> DataFrame:
    r = reads(s, d).withColumn("reason", F.when(F.col("position") % 11 == 0, "mito").when(F.col("position") % 7 == 0, "rdna").otherwise("kept"))
    return E.shares(r, "reason").withColumn("percent", F.round("percent", 6))


def _ends(s, d) -> DataFrame:
    return reads(s, d).select(*KEYS, "position").distinct()


def _sites(s, d) -> DataFrame:
    return genes(s, d).select(*KEYS, F.col("gene_3prime").alias("site")).distinct()


_ENDS = _WITH + "," + GENES_SQL + ", ends AS (SELECT DISTINCT chrom, strand, position FROM reads), sites AS (SELECT DISTINCT chrom, strand, gene_3prime AS site FROM genes)"


def nearest_site(s, d) -> DataFrame:
    n = E.nearest_site(_ends(s, d), _sites(s, d), KEYS, [*KEYS, "position"], 50)
    return n.groupBy(F.coalesce(F.col("distance").cast("long"), F.lit(9999)).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


_NEAREST = _ENDS + """,
n AS (SELECT e.chrom, e.strand, position, position - site AS distance, row_number() OVER (PARTITION BY e.chrom, e.strand, position ORDER BY abs(position - site), site) AS k FROM ends e LEFT JOIN sites s ON e.chrom = s.chrom AND e.strand = s.strand AND abs(position - site) <= 50)
SELECT coalesce(CAST(distance AS BIGINT), 9999) AS distance, count(*) AS n FROM n WHERE k = 1 GROUP BY 1
"""


def truth_cascade(s, d) -> DataFrame:
    """Ends against known places, then a signal, then annotated ends."""
    e = _ends(s, d)
    k = e.where("position % 13 = 0").select(*KEYS, F.col("position").alias("site"))
    sig = e.where("position % 5 = 0").select(*KEYS, F.col("position").alias("site"), ((F.col("position") % 17) / 8.0).alias("value"))
    out = E.truth_cascade(e, k, sig, _sites(s, d), KEYS, [*KEYS, "position"])
    return out.groupBy("source", F.coalesce(F.col("position") - F.col("truth"), F.lit(9999)).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


_CASCADE = _ENDS + """,
k AS (SELECT chrom, strand, position AS site FROM ends WHERE position % 13 = 0),
g AS (SELECT chrom, strand, position AS site, (position % 17) / 8.0 AS value FROM ends WHERE position % 5 = 0),
a AS (SELECT e.*, coalesce(min(site) FILTER (site = position), min(site)) AS k FROM ends e LEFT JOIN k ON e.chrom = k.chrom AND e.strand = k.strand AND abs(site - position) <= 10 GROUP BY ALL),
b AS (SELECT e.*, arg_min(site, struct_pack(v := -value, p := site)) AS g FROM ends e LEFT JOIN g ON e.chrom = g.chrom AND e.strand = g.strand AND abs(site - position) <= 10 AND value >= 0.5 GROUP BY ALL),
c AS (SELECT e.*, arg_min(site, struct_pack(v := abs(site - position), p := site)) AS s FROM ends e LEFT JOIN sites ON e.chrom = sites.chrom AND e.strand = sites.strand AND abs(site - position) <= 50 GROUP BY ALL),
t AS (SELECT position, CASE WHEN k = position THEN 'known_exact' WHEN k IS NOT NULL THEN 'known_positions' WHEN g IS NOT NULL THEN 'signal' WHEN s IS NOT NULL THEN 'annotation' ELSE 'none' END AS source, coalesce(k, g, s) AS truth FROM a JOIN b USING (chrom, strand, position) JOIN c USING (chrom, strand, position))
SELECT source, coalesce(position - truth, 9999) AS distance, count(*) AS n FROM t GROUP BY ALL
"""


def splice_boundary(s, d) -> DataFrame:
    r = reads(s, d).select("read_id", *KEYS, F.col("position").alias("boundary"), F.col("line").alias("clip")).distinct()
    g = genes(s, d).select(*KEYS, F.col("gene_id").alias("intron_id"), F.col("g_start").alias("three_ss"), F.col("g_end").alias("five_ss"))
    return E.splice_boundary(r, g, 5, 2).groupBy("intron_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("boundary") - F.col("three_ss"))).alias("off"))


_BOUNDARY = _WITH + "," + GENES_SQL + """,
r AS (SELECT DISTINCT read_id, chrom, strand, position AS boundary, line AS clip FROM reads WHERE line >= 2)
SELECT gene_id AS intron_id, count(*) AS n, CAST(sum(abs(boundary - g_start)) AS BIGINT) AS off FROM r JOIN genes g ON r.chrom = g.chrom AND r.strand = g.strand AND abs(boundary - g_start) <= 5 GROUP BY gene_id
"""


def result_tables(s, d) -> DataFrame:
    """Up and down lists with the annotation of their features."""
    line = table(s, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"))
    results = line.select("feature", F.round(F.log2((F.col("r") + 0.5) / (F.col("n") - F.col("r") + 0.5)) + 1, 9).alias("log2fc"), ((F.col("feature") % 100) / 1000.0).alias("padj"))
    names = table(s, d, "part").where("p_partkey < 450").select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("gene_name"))
    shown = E.annotate_results(E.result_tables(results, 0.05, 0.1), names)
    return shown.select("feature", "direction", "gene_name", "unannotated", F.round("log2fc", 6).alias("log2fc"))


_RESULTS = """
WITH r AS (SELECT l_partkey % 500 AS feature, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
t AS (SELECT feature, round(log2((r + 0.5) / (n - r + 0.5)) + 1, 9) AS l, (feature % 100) / 1000.0 AS padj FROM r)
SELECT feature, CASE WHEN l > 0 THEN 'up' ELSE 'down' END AS direction, p_brand AS gene_name, p_partkey IS NULL AS unannotated, round(l, 6) AS log2fc
FROM t LEFT JOIN (SELECT * FROM part WHERE p_partkey < 450) ON p_partkey = feature WHERE padj < 0.05 AND abs(l) > 0.1
"""


def complete_variants(s, d) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 3 == 0).alias("is_sub_variant"), (F.col("p_size") % 5 == 0).alias("is_filtered"))
    return E.complete_variants(p).select("p_partkey")


def restored_tails(s, d) -> DataFrame:
    """Reads with their trimmed tails put back."""
    q = dna_reads(s, d)
    trim = q.where("doc_id % 3 > 0").select("doc_id", F.substring("seq", 5, 12).alias("trimmed_seq"))
    out = E.restored(E.with_trim(q, trim, "doc_id"))
    return out.select("doc_id", F.md5("seq").alias("digest"), "cigar")


def dna_reads(s, d) -> DataFrame:
    from .analogs import dna

    n = F.length("seq")
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.greatest(n - 5, F.lit(0)).cast("string"), F.lit("M5S"))).otherwise(F.concat(n.cast("string"), F.lit("M")))
    return dna(s, d).select("doc_id", "seq", tail.alias("cigar"), F.when(F.col("doc_id") % 4 < 2, "+").otherwise("-").alias("strand"))


_RESTORED = "WITH " + DNA_SQL.strip() + """,
q AS (SELECT doc_id, seq, doc_id % 4 < 2 AS plus, CASE WHEN doc_id % 2 = 0 THEN greatest(length(seq) - 5, 0) || 'M5S' ELSE length(seq) || 'M' END AS cigar, CASE WHEN doc_id % 3 > 0 THEN substring(seq, 5, 12) ELSE '' END AS t FROM dna),
r AS (SELECT *, length(t) AS n, doc_id % 2 = 0 AS clipped FROM q)
SELECT doc_id, md5(CASE WHEN plus THEN seq || t ELSE reverse(translate(t, 'ACGT', 'TGCA')) || seq END) AS digest,
       CASE WHEN n = 0 THEN cigar WHEN plus AND clipped THEN regexp_replace(cigar, '5S$', '') || (n + 5) || 'S' WHEN plus THEN cigar || n || 'S' ELSE n || 'S' || cigar END AS cigar FROM r
"""


def band_match(s, d) -> DataFrame:
    m = I.band_match(support(s, d), known(s, d), KEYS, ("j_start", "j_end"), ("k_start", "k_end"), 10, J.JKEYS)
    far = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(9999)).alias(c)
    return m.groupBy(far("d_start"), far("d_end")).agg(F.count(F.lit(1)).alias("n"))


_BAND = _J + "," + GENES_SQL + "," + _KNOWN + """,
near AS (
  SELECT x.*, j_start - k_start AS ds, j_end - k_end AS de, row_number() OVER (PARTITION BY x.chrom, x.strand, j_start, j_end ORDER BY abs(j_start - k_start) + abs(j_end - k_end), k_start, k_end) AS r
  FROM support x LEFT JOIN known k ON x.chrom = k.chrom AND x.strand = k.strand AND abs(j_start - k_start) <= 10 AND abs(j_end - k_end) <= 10
)
SELECT coalesce(CAST(ds AS BIGINT), 9999) AS d_start, coalesce(CAST(de AS BIGINT), 9999) AS d_end, count(*) AS n FROM near WHERE r = 1 GROUP BY ALL
"""


def signatures(s, d) -> DataFrame:
    """Reads by their junctions, relative to their start."""
    r = reads(s, d).select("read_id", "line", *KEYS, "position", F.lit(1).cast("long").alias("count"), S.junctions(F.col("position") % 3, S.cigar_ops(F.col("cigar"))).alias("junctions"))
    from .commands import junction_signatures

    out = junction_signatures(r)
    text = F.array_join(F.transform("junctions", lambda j: F.concat_ws("-", j["start"].cast("string"), j["end"].cast("string"))), ";")
    return out.select(*KEYS, text.alias("signature"), "n_reads")


_SIGNATURES = _J + """,
q AS (SELECT chrom, strand, position % 3 AS o, position AS p, s1, e1, m2, m3, n2 FROM two)
SELECT chrom, strand, (s1 - p + o) || '-' || (e1 - p + o) || ';' || (e1 + m2 + 2 + m3 - p + o) || '-' || (e1 + m2 + 2 + m3 + n2 - p + o) AS signature, count(*) AS n_reads FROM q GROUP BY ALL
"""


def bh_adjust(s, d) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("feature"), F.round(((F.col("p_partkey") * 7919) % 1009) / 1009.0, 9).alias("p"))
    return T.benjamini_hochberg(p).select("feature", F.round("padj", 6).alias("padj"))


_BH = """
WITH t AS (SELECT p_partkey AS feature, round(((p_partkey * 7919) % 1009) / 1009.0, 9) AS p FROM part),
r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM t)
SELECT feature, round(least(1.0, min(p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS padj FROM r
"""


def control_samples(s, d) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in ("WT_1", "mut_rep1", "ctrl_a", "x_ctrl", "Mock", "dmso2", "my_wt_3", "reference7", "wildtypeA", "controls", "awt")]), (F.col("s_suppkey") % 11 + 1).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", names.alias("sample")).withColumn("control", S.is_control(F.col("sample")))


_CONTROLS = "WITH n AS (SELECT s_suppkey, ['WT_1', 'mut_rep1', 'ctrl_a', 'x_ctrl', 'Mock', 'dmso2', 'my_wt_3', 'reference7', 'wildtypeA', 'controls', 'awt'][s_suppkey % 11 + 1] AS sample FROM supplier) SELECT *, regexp_matches(lower(sample), '" + "|".join(S.CONTROL_PATTERNS) + "') AS control FROM n"


def top_shifted(s, d) -> DataFrame:
    """The five genes of greatest divergence."""
    return shift_jsd(s, d).orderBy(F.col("divergence").desc(), "gene").limit(5)


def zscore_top_var(s, d) -> DataFrame:
    c = _counts(s, d)
    top = T.top_variance(c, 10).select("feature")
    return T.zscores(c.join(top, "feature", "left_semi")).withColumn("z", F.round("z", 6))


def union_samples(s, d) -> DataFrame:
    """Position counts of two samples, kept apart and together."""
    r = reads(s, d)
    parts = [C.position_counts(r.where(F.col("sample") == n), [*KEYS, "position"], name="n").withColumn("sample", F.lit(n)) for n in ("s0", "s1")]
    both = parts[0].unionByName(parts[1])
    return both.groupBy(*KEYS, "position").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_samples"))


def set_difference(s, d) -> DataFrame:
    """Positions of one sample that another does not have."""
    r = reads(s, d)
    place = lambda n: r.where(F.col("sample") == n).select(*KEYS, "position")
    return place("s0").exceptAll(place("s1")).distinct().join(place("s1").distinct(), [*KEYS, "position"], "left_anti")


def indel_correction(s, d) -> DataFrame:
    """Ends of the stand-in reads: their deletions lie too far from the end or in bases that
    are no tail, except where the sequence is all A."""
    r = reads(s, d)
    n = S.cigar_sum(S.cigar_ops(F.col("cigar")), "MIS=X").cast("int")
    rich = F.col("position") % 2 == 0
    seq = F.when(rich, F.rpad(F.lit(""), 400, "A")).otherwise(F.rpad(F.lit(""), 400, "ACGT"))
    q = r.select("read_id", "line", "chrom", F.lit("+").alias("strand"), F.lit(0).cast("long").alias("start"), F.concat((F.col("span") + 20).cast("string"), F.lit("M"), (F.col("line") % 5 + 1).cast("string"), F.lit("D"), (F.col("read_id") % 30 + 1).cast("string"), F.lit("M")).alias("cigar"), seq.alias("seq"))
    q = q.withColumn("seq", F.substring("seq", F.lit(1), S.cigar_sum(S.cigar_ops(F.col("cigar")), "MIS=X").cast("int")))
    genome = s.createDataFrame([(c, "CG" * 200) for c in ("A", "N", "R")], "chrom string, seq string")
    return R.indel_correction(q, genome).groupBy("correction_bp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_deletions").alias("n_deletions"))


_INDEL = _WITH + """,
q AS (SELECT position % 2 = 0 AS rich, line % 5 + 1 AS del, read_id % 30 + 1 AS tail FROM reads),
b AS (SELECT CASE WHEN rich AND del <= 3 AND tail <= 20 THEN del ELSE 0 END AS moved FROM q)
SELECT CAST(-moved AS BIGINT) AS correction_bp, count(*) AS n, count(*) FILTER (moved > 0) AS n_deletions FROM b GROUP BY moved
"""


def _site_windows(s, d) -> DataFrame:
    counted = C.position_counts(reads(s, d), [*KEYS, "position"], name="n")
    return X.windows(_sites(s, d), counted, KEYS, "site", "position", "n", 10)


def reference_refine(s, d) -> DataFrame:
    """Ends by the peaks of the signal round the nearest annotated end."""
    out = N.refine_by_reference(_ends(s, d), _site_windows(s, d), KEYS, [*KEYS, "position"], reach=20)
    return out.select(*KEYS, "position", "refined", F.round("fraction", 6).alias("fraction"), "shift", "method")


_REFINE = _ENDS + """,
c AS (SELECT chrom, strand, position, count(*) AS n FROM reads GROUP BY ALL),
near AS (SELECT * FROM (SELECT e.chrom, e.strand, position, site, row_number() OVER (PARTITION BY e.chrom, e.strand, position ORDER BY abs(position - site), site) AS k FROM ends e LEFT JOIN sites s ON e.chrom = s.chrom AND e.strand = s.strand AND abs(position - site) <= 20) WHERE k = 1),
w AS (SELECT n.chrom, n.strand, n.position, site + o AS refined, coalesce(c.n, 0) AS v FROM (SELECT *, unnest(range(-10, 11)) AS o FROM near WHERE site IS NOT NULL) n LEFT JOIN c ON c.chrom = n.chrom AND c.strand = n.strand AND c.position = site + o),
p AS (SELECT *, max(v) OVER (PARTITION BY chrom, strand, position) AS m FROM w),
q AS (SELECT *, sum(v) OVER (PARTITION BY chrom, strand, position) AS t FROM p WHERE v >= 0.1 * m)
SELECT chrom, strand, position, refined, round(CASE WHEN t > 0 THEN v / t ELSE 0.0 END, 6) AS fraction, refined - position AS shift, 'raw' AS method FROM q
UNION ALL SELECT chrom, strand, position, position, 1.0, 0, 'no_reference' FROM near WHERE site IS NULL
"""


def region_deconvolution(s, d) -> DataFrame:
    """Regions of tracts with their deconvolved peaks."""
    regions = C.cluster_fixed(reads(s, d), KEYS, distance=5, min_reads=5).select(*KEYS, F.col("start"), (F.col("end") + 1).alias("end"))
    counted = C.position_counts(reads(s, d), [*KEYS, "position"], name="n")
    out = N.deconvolve_regions(N.region_signal(regions, counted, KEYS, "start", "end", "position", "n"), [0.54, 0.26, 0.12, 0.08], "start")
    return out.select(*KEYS, "start", "end", "position", F.round("fraction", 6).alias("fraction"), F.round("r_squared", 6).alias("r_squared"), "flag")


def sampled_assignment(s, d) -> DataFrame:
    """Reads dealt to the peaks of their locus by share: how many each peak gets."""
    r = reads(s, d).withColumn("locus", F.floor(F.col("position") / 370)).withColumn("read", F.concat_ws("/", "read_id", "line"))
    c = C.position_counts(r, [*KEYS, "locus", "position"], name="n")
    peaks = c.where("n >= 3").withColumn("fraction", F.col("n").cast("double"))
    out = N.sampled(r.select(*KEYS, "locus", "read"), peaks, [*KEYS, "locus"], "read")
    return out.groupBy(*KEYS, "locus", "assigned").agg(F.count(F.lit(1)).alias("n"))


def chromosome_names(s, d) -> DataFrame:
    """Names of yeast chromosomes in three forms, brought to one."""
    n = table(s, d, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in ("chrIV", "IV", "ref|NC_001136|", "BK006938.2", "chrM", "ref|NC_001224|", "scaffold_7")]), (F.col("s_suppkey") % 7 + 1).cast("int")).alias("chrom"))
    return normalise_yeast(n)


def chimeric_stitch(s, d) -> DataFrame:
    """Each read in two versions, one of which clips the last exon: the stitched one has it."""
    name = F.concat_ws("/", "read_id", "line", "position", "cigar")
    r = reads(s, d).select(name.alias("read_id"), *KEYS, F.col("position").alias("start"), "cigar").distinct().withColumn("known", F.expr("CAST(array() AS array<string>)"))
    tail = F.regexp_extract("cigar", "N8M([0-9]+)S$", 1).cast("int") + 8
    short = r.withColumn("cigar", F.concat(F.regexp_replace("cigar", "[0-9]+N8M[0-9]+S$", ""), tail.cast("string"), F.lit("S")))
    both = r.withColumn("aligner", F.lit("a")).unionByName(short.withColumn("aligner", F.lit("b")))
    return H.stitch_reads(both).select("read_id", F.concat("chrom", "strand").alias("place"), "start", "cigar", "aligners", "n_segments")


def junction_refine(s, d) -> DataFrame:
    """Junctions that were read off by up to two bases, brought back by the bases beside them.
    Documents of 200 letters or more are the chromosomes."""
    g = dna_reads(s, d).select(F.col("doc_id").cast("string").alias("chrom"), "seq", "doc_id").where(F.length("seq") >= 200)
    off = (F.col("doc_id") % 5 - 2).cast("long")
    r = g.select(F.col("chrom").alias("read_id"), "chrom", F.lit("+").alias("strand"), (60 + off).alias("j_start"), (140 + off).alias("j_end"), F.substring("seq", 41, 20).alias("before"), F.substring("seq", 141, 20).alias("after"))
    pool = g.select("chrom", F.lit("+").alias("strand"), F.lit(60).cast("long").alias("p_start"), F.lit(140).cast("long").alias("p_end"), F.lit(True).alias("annotated"))
    return R.refine_junctions(r, pool, g).select("read_id", "j_start", "new_start", "new_end")


QUERIES = {
    "chimeric_stitch": (chimeric_stitch, _WITH + " SELECT DISTINCT read_id || '/' || line || '/' || position || '/' || cigar AS read_id, chrom || strand AS place, position AS start, regexp_replace(cigar, 'M0S$', 'M') AS cigar, 'a' AS aligners, CAST(1 AS INT) AS n_segments FROM reads"),
    "junction_refine": (junction_refine, None),
    "reference_refine": (reference_refine, _REFINE),
    "region_deconvolution": (region_deconvolution, None),
    "sampled_assignment": (sampled_assignment, None),
    "chromosome_names": (chromosome_names, "SELECT s_suppkey, ['chrIV', 'chrIV', 'chrIV', 'chrIV', 'chrM', 'chrMito', 'scaffold_7'][s_suppkey % 7 + 1] AS chrom FROM supplier"),
    "junction_evidence": (evidence, _EVIDENCE),
    "ambiguous_counts": (ambiguous, _AMBIGUOUS),
    "read_lists": (read_lists, _WITH + " SELECT chrom, position % 5000 AS place, md5(string_agg(DISTINCT CAST(read_id AS VARCHAR), ',' ORDER BY read_id)) AS digest, count(DISTINCT read_id) AS n FROM reads GROUP BY ALL".replace("string_agg(DISTINCT CAST(read_id AS VARCHAR), ',' ORDER BY read_id)", "array_to_string(list_sort(list_distinct(list(read_id))), ',')")),
    "enough_counts": (enough, "WITH " + _COUNTS + " SELECT * FROM counts WHERE feature IN (SELECT feature FROM counts WHERE count >= 45 GROUP BY feature HAVING count(*) >= 4)"),
    "category_summary": (categories, _WITH + " SELECT coalesce(aligner, 'all') AS category, count(*) AS n, round(avg(span), 6) AS mean, median(CAST(span AS DOUBLE)) AS median, max(CAST(span AS DOUBLE)) AS max FROM reads GROUP BY GROUPING SETS ((aligner), ())"),
    "exclusion_shares": (exclusion_shares, _WITH + ", r AS (SELECT CASE WHEN position % 11 = 0 THEN 'mito' WHEN position % 7 = 0 THEN 'rdna' ELSE 'kept' END AS reason FROM reads) SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 6) AS percent FROM r GROUP BY reason"),
    "nearest_site": (nearest_site, _NEAREST),
    "truth_cascade": (truth_cascade, _CASCADE),
    "splice_boundary": (splice_boundary, _BOUNDARY),
    "result_tables": (result_tables, _RESULTS),
    "complete_variants": (complete_variants, "SELECT p_partkey FROM part WHERE NOT coalesce(CASE WHEN p_size % 4 <> 0 THEN p_size % 3 = 0 END, false) AND p_size % 5 <> 0"),
    "restored_tails": (restored_tails, _RESTORED),
    "junction_band_match": (band_match, _BAND),
    "junction_signatures": (signatures, _SIGNATURES),
    "bh_adjust": (bh_adjust, _BH),
    "control_samples": (control_samples, _CONTROLS),
    "top_shifted": (top_shifted, _SHIFT + " ORDER BY divergence DESC, gene LIMIT 5"),
    "zscore_top_var": (zscore_top_var, "WITH " + _COUNTS + ", t AS (SELECT feature FROM counts GROUP BY feature ORDER BY round(var_samp(count), 9) DESC, feature LIMIT 10) SELECT feature, sample, count, round((count - avg(count) OVER w) / stddev_samp(count) OVER w, 6) AS z FROM counts SEMI JOIN t USING (feature) WINDOW w AS (PARTITION BY feature)"),
    "union_samples": (union_samples, _WITH + " SELECT chrom, strand, position, count(*) AS n, count(DISTINCT sample) AS n_samples FROM reads WHERE sample IN ('s0', 's1') GROUP BY ALL"),
    "set_difference": (set_difference, _WITH + " SELECT chrom, strand, position FROM reads WHERE sample = 's0' EXCEPT SELECT chrom, strand, position FROM reads WHERE sample = 's1'"),
    "indel_correction": (indel_correction, _INDEL),
}
