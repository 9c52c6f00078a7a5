"""Queries on junctions, aligners, isoforms and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import clustering as C
from ..operators import consensus as K
from ..operators import differential as D
from ..operators import genes as G
from ..operators import intervals as I
from ..operators import junctions as J
from ..operators import stats as T
from .analogs import GENES_SQL, READS_SQL, genes, reads, table

KEYS = ["chrom", "strand"]
_WITH = "WITH " + READS_SQL.strip()


def junctions(s, d) -> DataFrame:
    return J.read_junctions(reads(s, d), keep=["read_id", "line", "sample"])


# The three-part CIGAR of the analog reads, followed by hand.
_J = _WITH + """,
two AS (
  SELECT *, position + span AS s1, position + span + CAST(regexp_extract(cigar, 'M([0-9]+)N', 1) AS BIGINT) AS e1,
         CAST(regexp_extract(cigar, 'N([0-9]+)M2D', 1) AS BIGINT) AS m2, CAST(regexp_extract(cigar, 'D([0-9]+)M', 1) AS BIGINT) AS m3, CAST(regexp_extract(cigar, 'M([0-9]+)N8M[0-9]+S$', 1) AS BIGINT) AS n2 FROM reads
),
junctions AS (
  SELECT chrom, strand, read_id, line, sample, s1 AS j_start, e1 AS j_end FROM two
  UNION ALL SELECT chrom, strand, read_id, line, sample, e1 + m2 + 2 + m3, e1 + m2 + 2 + m3 + n2 FROM two
),
support AS (SELECT chrom, strand, j_start, j_end, count(*) AS n_reads, count(DISTINCT sample) AS n_samples FROM junctions GROUP BY ALL)
"""


def support(s, d) -> DataFrame:
    return J.support(junctions(s, d))


def known(s, d) -> DataFrame:
    g = genes(s, d)
    return g.select(*KEYS, F.col("g_start").alias("k_start"), (F.col("g_start") + 20 + F.col("g_end") % 5).alias("k_end"))


_KNOWN = "known AS (SELECT chrom, strand, g_start AS k_start, g_start + 20 + g_end % 5 AS k_end FROM genes)"


def annotation_status(s, d) -> DataFrame:
    return J.annotation_status(support(s, d), known(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_reads").alias("n_reads"))


def _closest(limit: str) -> str:
    return _J + "," + GENES_SQL + "," + _KNOWN + f""",
near AS (
  SELECT x.*, k_start, k_end, j_start - k_start AS ds, j_end - k_end AS de,
         row_number() OVER (PARTITION BY x.chrom, x.strand, j_start, j_end ORDER BY abs(j_start - k_start) + abs(j_end - k_end), k_start, k_end) AS r
  FROM support x LEFT JOIN known k ON x.chrom = k.chrom AND x.strand = k.strand AND {limit}
)
"""


def splice_site_class(s, d) -> DataFrame:
    return J.splice_site_class(support(s, d), known(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_reads").alias("n_reads"))


def validated_retention(s, d) -> DataFrame:
    return J.retained(junctions(s, d), J.validated(support(s, d)), ["read_id", "line"]).groupBy("kept", "dropped").agg(F.count(F.lit(1)).alias("n"))


_VALID = _J + ", valid AS (SELECT * FROM support WHERE n_samples >= 2 AND n_reads >= 3 AND j_end - j_start <= 10000)"


def _exons(s, d) -> DataFrame:
    r = reads(s, d)
    return r.select(F.col("read_id").alias("transcript"), "chrom", F.col("position").alias("start"), (F.col("position") + F.col("span")).alias("end"))


def gtf_introns(s, d) -> DataFrame:
    return J.introns_from_exons(_exons(s, d), "transcript", ["chrom"], "start", "end")


def _alignments(s, d) -> DataFrame:
    r = reads(s, d)
    a = r.groupBy("read_id", "aligner").agg(F.min("position").alias("three_prime"), F.max("strand").alias("strand"), F.max("span").alias("span"), F.array_sort(F.collect_set(F.col("position") % 7)).alias("junctions"), F.max("weight").alias("fraction"))
    score = K.alignment_score(F.col("span") % 7, F.col("span") % 11 == 0, F.col("span") % 13, F.col("span") % 3, F.col("span") % 5)
    return a.withColumns({"score": score, "n_annotated": F.col("span") % 2, "n_canonical": F.size("junctions").cast("long"), "rescued": F.col("span") % 11 == 0, "n_junctions": F.size("junctions").cast("long"), "confidence": F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("span") % 3 + 1).cast("int"))})


_ALIGN = _WITH + """,
base AS (SELECT read_id, aligner, min(position) AS three_prime, max(strand) AS strand, max(span) AS span, list_sort(list_distinct(list(position % 7))) AS junctions, max(weight) AS fraction FROM reads GROUP BY ALL),
alignments AS (
  SELECT *, -2 * CASE WHEN span % 11 = 0 THEN 0 ELSE span % 7 END - least(span % 13, 10) - least(2 * (span % 3), 10) - least(span % 5, 10) AS score,
         span % 2 AS n_annotated, len(junctions) AS n_canonical, span % 11 = 0 AS rescued, len(junctions) AS n_junctions, ['high', 'medium', 'low'][span % 3 + 1] AS confidence FROM base
)
"""


def consensus_best(s, d) -> DataFrame:
    return K.best_aligner(_alignments(s, d), ["read_id"]).select("read_id", "aligner", "score", "n_tied")


def consensus_confidence(s, d) -> DataFrame:
    return K.consensus_confidence(_alignments(s, d), ["read_id"]).select("read_id", "confidence")


def agreement_count(s, d) -> DataFrame:
    return K.agreement(_alignments(s, d), ["read_id"], "three_prime").select("read_id", "aligner", "n_agree")


def corrected_winner(s, d) -> DataFrame:
    return K.winners(K.agreement(_alignments(s, d), ["read_id"], "three_prime"), ["read_id"]).select("read_id", "aligner", "n_agree")


def complementary_pairs(s, d) -> DataFrame:
    return K.complementary_pairs(_alignments(s, d), ["read_id"])


def _gene_reads(s, d) -> DataFrame:
    """Distinct read ends with the first gene that holds them."""
    r = reads(s, d).groupBy(*KEYS, "position").agg(F.count(F.lit(1)).alias("n"))
    return I.first_containing(r, genes(s, d).select(*KEYS, "gene_id", "g_start", "g_end"), KEYS, "position", "g_start", "g_end", "gene_id", [*KEYS, "position"], how="inner")


_GENE_READS = _WITH + "," + GENES_SQL + """,
gr AS (
  SELECT * FROM (
    SELECT r.chrom, r.strand, r.position, n, gene_id, row_number() OVER (PARTITION BY r.chrom, r.strand, r.position ORDER BY g_start, gene_id) AS k
    FROM (SELECT chrom, strand, position, count(*) AS n FROM reads GROUP BY ALL) r JOIN genes g ON r.chrom = g.chrom AND r.strand = g.strand AND r.position BETWEEN g_start AND g_end
  ) WHERE k = 1
),
iso AS (
  SELECT gene_id AS gene, strand, position % 3 AS jn, CAST(round_even(position / 50, 0) * 50 AS BIGINT) AS tes_bin, CAST(sum(n) AS BIGINT) AS n_reads, CAST(floor(median(position)) AS BIGINT) AS tes
  FROM (SELECT *, unnest(range(n)) FROM gr) GROUP BY gene_id, strand, position % 3, round_even(position / 50, 0) HAVING count(*) >= 3
)
"""
# Rows of gr are repeated n times above, so that sums count every row n times; undo it.
_GENE_READS = _GENE_READS.replace("CAST(sum(n) AS BIGINT) AS n_reads, CAST(floor", "count(*) AS n_reads, CAST(floor")


def _isoforms(s, d) -> DataFrame:
    g = _gene_reads(s, d).select(F.struct("gene_id", "strand").alias("gene"), F.array(F.col("position") % 3).alias("junctions"), F.col("position").alias("tes"), "n")
    return G.isoforms(g).select(F.col("gene.gene_id").alias("gene"), F.col("gene.strand").alias("strand"), F.col("junctions")[0].alias("jn"), "tes_bin", "n_reads", F.col("tes").cast("long").alias("tes"))


def apa_usage(s, d) -> DataFrame:
    return G.isoform_usage(_isoforms(s, d)).select("gene", "jn", "tes_bin", F.round("usage", 6).alias("usage"))


def proximal_distal(s, d) -> DataFrame:
    return G.proximal_distal(_isoforms(s, d), 30)


def attribution(s, d) -> DataFrame:
    g = _gene_reads(s, d).select(F.concat(F.col("chrom"), (F.col("position") % 50).cast("string")).alias("cluster"), F.array(F.substring("gene_id", 7, 2)).alias("genes"), "n")
    return G.attribution_string(g, "cluster")


_ATTRIBUTION = _GENE_READS + """,
a AS (SELECT chrom || CAST(position % 50 AS VARCHAR) AS cluster, substring(gene_id, 7, 2) AS genes, sum(n) AS n FROM gr GROUP BY ALL),
b AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS share FROM a)
SELECT cluster, string_agg(genes || ',' || CAST(CAST(round_even(share * 100, 0) AS BIGINT) AS VARCHAR) || '%', ';' ORDER BY n DESC, genes) AS attribution FROM b WHERE share >= 0.01 GROUP BY cluster
"""
_PRIORITY = ["UTR3", "UTR5", "CDS", "ncRNA"]


def _categorised(s, d) -> DataFrame:
    r = reads(s, d).groupBy(*KEYS, F.col("position").alias("r_start"), (F.col("position") + F.col("span")).alias("r_end")).agg(F.count(F.lit(1)).alias("n"))
    g = genes(s, d).select(*KEYS, "g_start", "g_end", F.element_at(F.array(*[F.lit(p) for p in _PRIORITY]), (F.col("g_end") % 4 + 1).cast("int")).alias("category"))
    o = I.overlaps(r, g, KEYS, ("r_start", "r_end"), ("g_start", "g_end"))
    return G.body_category(o, [*KEYS, "r_start", "r_end", "n"], _PRIORITY)


def body_category(s, d) -> DataFrame:
    return _categorised(s, d).groupBy("category").agg(F.sum("n").alias("n_reads"))


def region_distribution(s, d) -> DataFrame:
    return G.region_distribution(_categorised(s, d)).withColumn("percent", F.round("percent", 6))


_CATEGORY = _WITH + "," + GENES_SQL + """,
bodies AS (SELECT chrom, strand, position, span, count(*) AS n FROM reads GROUP BY ALL),
sums AS (
  SELECT b.chrom, b.strand, position, span, n, ['UTR3', 'UTR5', 'CDS', 'ncRNA'][g_end % 4 + 1] AS category, sum(least(position + span, g_end) - greatest(position, g_start)) AS bp
  FROM bodies b JOIN genes g ON b.chrom = g.chrom AND b.strand = g.strand AND position < g_end AND g_start < position + span GROUP BY ALL
),
best AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, position, span ORDER BY bp DESC, list_position(['UTR3', 'UTR5', 'CDS', 'ncRNA'], category)) AS r FROM sums)
"""


def _counts(s, d) -> DataFrame:
    """feature, sample, count: reads by part bin and sample."""
    line = table(s, d, "lineitem")
    return line.groupBy((F.col("l_partkey") % 200).alias("feature"), F.concat(F.lit("s"), (F.col("l_suppkey") % 6).cast("string")).alias("sample")).agg(F.count(F.lit(1)).alias("count"))


_COUNTS = "counts AS (SELECT l_partkey % 200 AS feature, 's' || CAST(l_suppkey % 6 AS VARCHAR) AS sample, count(*) AS count FROM lineitem GROUP BY ALL)"


def size_factors(s, d) -> DataFrame:
    return T.size_factors(_counts(s, d)).withColumn("factor", F.round("factor", 6))


def shift_jsd(s, d) -> DataFrame:
    c = _counts(s, d)
    wide = c.groupBy((F.col("feature") % 20).alias("gene"), F.floor(F.col("feature") / 20).alias("position")).agg(F.sum(F.when(F.col("sample") < "s3", F.col("count")).otherwise(0)).alias("a"), F.sum(F.when(F.col("sample") >= "s3", F.col("count")).otherwise(0)).alias("b"))
    js = T.jensen_shannon(wide, "gene", "position", "a", "b").withColumn("divergence", F.round("divergence", 9))
    sh = T.cluster_shift(wide.withColumn("strand", F.when(F.col("gene") % 2 == 0, "+").otherwise("-")), "gene", "position", "a", "b")
    return js.join(sh.select("gene", "shift", "direction"), "gene")


_SHIFT = "WITH " + _COUNTS + """,
w AS (SELECT feature % 20 AS gene, feature // 20 AS position, sum(CASE WHEN sample < 's3' THEN count ELSE 0 END) AS a, sum(CASE WHEN sample >= 's3' THEN count ELSE 0 END) AS b FROM counts GROUP BY ALL),
p AS (SELECT *, a / sum(a) OVER (PARTITION BY gene) AS x, b / sum(b) OVER (PARTITION BY gene) AS y FROM w),
js AS (SELECT gene, round(sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2, 9) AS divergence FROM p GROUP BY gene),
m AS (SELECT gene, sum(a + b) AS total, arg_max(position, a * 100000 - position) AS ma, arg_max(position, b * 100000 - position) AS mb FROM w GROUP BY gene),
sh AS (SELECT gene, CAST((mb - ma) * CASE WHEN gene % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS shift FROM m WHERE total >= 20)
SELECT gene, divergence, shift, CASE WHEN shift > 2 THEN 'downstream' WHEN shift < -2 THEN 'upstream' ELSE 'none' END AS direction FROM js JOIN sh USING (gene)
"""


def top_variance(s, d) -> DataFrame:
    return T.top_variance(_counts(s, d), 25).withColumn("variance", F.round("variance", 6))


def zscore(s, d) -> DataFrame:
    return T.zscores(_counts(s, d)).withColumn("z", F.round("z", 6))


def sample_corr(s, d) -> DataFrame:
    return T.sample_correlation(_counts(s, d)).withColumn("r", F.round("r", 6))


def fisher_enrichment(s, d) -> DataFrame:
    """Brands among the parts of large size: one-sided tests with adjusted p-values."""
    part = table(s, d, "part")
    marked = part.withColumn("drawn", F.col("p_size") > 35)
    total = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if("drawn").alias("drawn"))
    sets = marked.groupBy("p_brand").agg(F.count(F.lit(1)).alias("marked"), F.count_if("drawn").alias("hit")).crossJoin(F.broadcast(total))
    tested = T.benjamini_hochberg(T.fisher_greater(sets, "hit", "drawn", "marked", "total").withColumn("p", F.round("p", 10)))
    return tested.select("p_brand", "hit", "marked", F.round("p", 6).alias("p"), F.round("padj", 6).alias("padj"))


_FISHER = """
WITH m AS (SELECT p_brand, p_size > 35 AS big FROM part),
t AS (SELECT count(*) AS total, count(*) FILTER (big) AS drawn FROM m),
g AS (SELECT p_brand, count(*) AS marked, count(*) FILTER (big) AS hit, any_value(t.total) AS total, any_value(t.drawn) AS drawn FROM m, t GROUP BY p_brand),
x AS (SELECT *, unnest(range(hit, least(drawn, marked) + 1)) AS i FROM g),
p AS (SELECT p_brand, hit, marked, round(least(1.0, sum(exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1) - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)))), 10) AS p FROM x GROUP BY ALL),
r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM p)
SELECT p_brand, hit, marked, round(p, 6) AS p, round(least(1.0, min(p * n / k) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS padj FROM r
"""


def pca(s, d) -> DataFrame:
    return T.pca_samples(_counts(s, d))


def differential(s, d) -> DataFrame:
    names = [(f"s{i}", "a" if i < 3 else "b") for i in range(6)]
    return D.differential(_counts(s, d), s.createDataFrame(names, "sample string, condition string"), "a")


def rpm(s, d) -> DataFrame:
    return T.rpm(C.position_counts(reads(s, d), [*KEYS, "position"]), "count", [*KEYS, "position"]).withColumn("rpm", F.round("rpm", 6))


def _qc_rows(s, d) -> DataFrame:
    r = reads(s, d)
    return r.select((F.col("line") == 1).alias("is_primary"), (F.col("position") % 5 == 0).alias("ambiguous"), (F.col("span") % 4 == 0).alias("corrected"), (F.col("span") % 9).alias("shift"), F.when(F.col("span") % 2 == 0, "indel").otherwise("clip").alias("correction"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("span") % 3 + 1).cast("int")).alias("confidence"), F.when(F.col("position") % 4 != 0, F.col("span") % 7).alias("error"), (F.col("span") % 6).alias("before"))


_QC = _WITH + """,
q AS (SELECT line = 1 AS is_primary, position % 5 = 0 AS ambiguous, span % 4 = 0 AS corrected, span % 9 AS shift, CASE WHEN span % 2 = 0 THEN 'indel' ELSE 'clip' END AS correction,
      ['high', 'medium', 'low'][span % 3 + 1] AS confidence, CASE WHEN position % 4 <> 0 THEN span % 7 END AS error, span % 6 AS before FROM reads)
"""


def qc_stats(s, d) -> DataFrame:
    return G.qc_stats(_qc_rows(s, d))


def validation_metrics(s, d) -> DataFrame:
    return G.validation_metrics(_qc_rows(s, d))


def variant_frequency(s, d) -> DataFrame:
    r = reads(s, d)
    mism = r.where("line <= 5").select("chrom", "position", F.substring("aligner", 8, 1).alias("base"))
    return G.variant_frequency(mism, r.groupBy("chrom", "position").agg(F.count(F.lit(1)).alias("depth")), ["chrom", "position"], 3, 0.5).withColumn("fraction", F.round("fraction", 6))


_VARIANT = _WITH + """,
m AS (SELECT chrom, position, substring(aligner, 8, 1) AS base, count(*) AS n FROM reads WHERE line <= 5 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY chrom, position ORDER BY n DESC, base DESC) AS k FROM m)
SELECT t.chrom, t.position, base, n AS n_mismatch, depth, round(n / depth, 6) AS fraction
FROM t JOIN (SELECT chrom, position, count(*) AS depth FROM reads GROUP BY ALL) c USING (chrom, position) WHERE k = 1 AND depth >= 3 AND n / depth >= 0.5
"""


def shift_calibration(s, d) -> DataFrame:
    r = reads(s, d).select((F.col("position") % 11).alias("a_count"), F.col("sample").alias("replicate"), F.col("span").cast("double").alias("tail"))
    return G.shift_calibration(r).select("a_count", F.round("mean_tail", 6).alias("mean_tail"), F.round("shift", 6).alias("shift"))


def sync_points(s, d) -> DataFrame:
    m = reads(s, d).select("read_id", "aligner", (F.col("line") + F.col("span") % 2).alias("qpos"), (F.col("line") * 2 + F.col("span") % 2).alias("rpos"))
    return K.sync_points(m, ["read_id"])


def sample_conditions(s, d) -> DataFrame:
    name = F.concat(F.substring("s_name", 1, 4), F.lit("_rep"), (F.col("s_suppkey") % 10).cast("string"))
    return table(s, d, "supplier").select(S.sample_condition(name).alias("condition")).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


def natural_sort(s, d) -> DataFrame:
    part = table(s, d, "part").select(F.concat(F.lit("chr"), (F.col("p_partkey") % 30).cast("string"), F.lit("_"), F.col("p_size").cast("string")).alias("name")).distinct()
    return part.select("name", S.natural_key(F.col("name"), 4).alias("key"))


QUERIES = {
    "junctions_from_cigar": (lambda s, d: junctions(s, d).groupBy(*KEYS, "j_start", "j_end").agg(F.count(F.lit(1)).alias("n")), _J + " SELECT chrom, strand, j_start, j_end, count(*) AS n FROM junctions GROUP BY ALL"),
    "junction_support": (support, _J + " SELECT * FROM support"),
    "junction_filter": (lambda s, d: J.filter_junctions(support(s, d), 2, 2), _J + " SELECT * FROM support WHERE n_reads >= 2 AND n_samples >= 2"),
    "junction_cross_sample": (lambda s, d: J.validated(support(s, d)), _VALID + " SELECT * FROM valid"),
    "junction_annotation_status": (annotation_status, _closest("abs(j_start - k_start) + abs(j_end - k_end) <= 10") + " SELECT CASE WHEN k_start IS NULL THEN 'novel' WHEN ds = 0 AND de = 0 THEN 'annotated' ELSE 'near' END AS status, count(*) AS n, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM near WHERE r = 1 GROUP BY 1"),
    "alt_splice_class": (splice_site_class, _closest("abs(j_start - k_start) <= 10 AND abs(j_end - k_end) <= 10") + " SELECT CASE WHEN k_start IS NULL THEN 'novel' WHEN ds = 0 AND de = 0 THEN 'exact' WHEN de = 0 THEN 'alt_5ss' WHEN ds = 0 THEN 'alt_3ss' ELSE 'alt_both' END AS kind, count(*) AS n, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM near WHERE r = 1 GROUP BY 1"),
    "validated_retention": (validated_retention, _VALID + ", k AS (SELECT j.read_id, j.line, count(v.n_reads) AS kept, count(*) - count(v.n_reads) AS dropped FROM junctions j LEFT JOIN valid v USING (chrom, strand, j_start, j_end) GROUP BY j.read_id, j.line) SELECT kept, dropped, count(*) AS n FROM k GROUP BY ALL"),
    "gtf_introns": (gtf_introns, _WITH + ", e AS (SELECT chrom, position + span AS intron_start, lead(position) OVER (PARTITION BY read_id ORDER BY position, position + span) AS intron_end FROM reads) SELECT DISTINCT chrom, intron_start, intron_end FROM e WHERE intron_end > intron_start"),
    "consensus_best": (consensus_best, _ALIGN + ", n AS (SELECT *, count(*) OVER (PARTITION BY read_id, three_prime) AS same, max(score) OVER (PARTITION BY read_id) AS top FROM alignments), t AS (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY read_id) AS n_tied, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, same DESC, n_annotated DESC, n_canonical DESC, aligner) AS r FROM n) SELECT read_id, aligner, score, n_tied FROM t WHERE r = 1"),
    "consensus_confidence": (consensus_confidence, _ALIGN + ", v AS (SELECT read_id, strand, junctions, count(DISTINCT aligner) AS n FROM alignments GROUP BY ALL) SELECT read_id, CASE WHEN max(n) = sum(n) THEN 'high' WHEN max(n) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM v GROUP BY read_id"),
    "agreement_count": (agreement_count, _ALIGN + " SELECT read_id, aligner, count(*) OVER (PARTITION BY read_id, three_prime) AS n_agree FROM alignments"),
    "corrected_winner": (corrected_winner, _ALIGN + ", n AS (SELECT *, count(*) OVER (PARTITION BY read_id, three_prime) AS n_agree FROM alignments), r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY rescued DESC, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, n_agree DESC, span DESC, n_junctions DESC, aligner) AS k FROM n) SELECT read_id, aligner, n_agree FROM r WHERE k = 1"),
    "complementary_pairs": (complementary_pairs, _ALIGN + ', p AS (SELECT a.read_id, a.aligner AS "first", b.aligner AS "second", len(list_filter(a.junctions, lambda x: NOT list_contains(b.junctions, x))) AS only_first, len(list_filter(b.junctions, lambda x: NOT list_contains(a.junctions, x))) AS only_second FROM alignments a JOIN alignments b ON a.read_id = b.read_id AND a.aligner < b.aligner) SELECT read_id, "first", "second", CAST(only_first AS INT) AS only_first, CAST(only_second AS INT) AS only_second FROM p WHERE only_first > 0 AND only_second > 0'),
    "apa_isoforms": (_isoforms, _GENE_READS + " SELECT * FROM iso"),
    "apa_usage": (apa_usage, _GENE_READS + " SELECT gene, jn, tes_bin, round(n_reads / sum(n_reads) OVER (PARTITION BY gene), 6) AS usage FROM iso"),
    "proximal_distal": (proximal_distal, _GENE_READS + " SELECT gene, strand, CASE WHEN strand = '+' THEN min(tes) ELSE max(tes) END AS proximal, CASE WHEN strand = '+' THEN max(tes) ELSE min(tes) END AS distal FROM iso GROUP BY gene, strand HAVING max(tes) - min(tes) >= 30"),
    "attribution_string": (attribution, _ATTRIBUTION),
    "body_category": (body_category, _CATEGORY + " SELECT category, CAST(sum(n) AS BIGINT) AS n_reads FROM best WHERE r = 1 GROUP BY category"),
    "region_distribution": (region_distribution, _CATEGORY + ", c AS (SELECT category, CAST(sum(n) AS BIGINT) AS n_reads, count(*) AS n_positions FROM best WHERE r = 1 GROUP BY category) SELECT *, round(100.0 * n_reads / sum(n_reads) OVER (), 6) AS percent FROM c"),
    "size_factors": (size_factors, "WITH " + _COUNTS + ", l AS (SELECT feature, sample, ln(count) AS lc FROM counts), g AS (SELECT feature, avg(lc) AS g FROM l GROUP BY feature HAVING count(*) = (SELECT count(DISTINCT sample) FROM counts)) SELECT sample, round(exp(quantile_cont(lc - g, 0.5)), 6) AS factor FROM l JOIN g USING (feature) GROUP BY sample"),
    "shift_jsd": (shift_jsd, _SHIFT),
    "topk_features": (top_variance, "WITH " + _COUNTS + " SELECT feature, round(var_samp(count), 6) AS variance FROM counts GROUP BY feature ORDER BY round(var_samp(count), 9) DESC, feature LIMIT 25"),
    "zscore": (zscore, "WITH " + _COUNTS + " SELECT feature, sample, count, round((count - avg(count) OVER w) / stddev_samp(count) OVER w, 6) AS z FROM counts WINDOW w AS (PARTITION BY feature)"),
    "sample_corr": (sample_corr, "WITH " + _COUNTS + " SELECT x.sample AS a, y.sample AS b, round(corr(x.count, y.count), 6) AS r FROM counts x JOIN counts y ON x.feature = y.feature AND x.sample < y.sample GROUP BY ALL"),
    "fisher_enrichment": (fisher_enrichment, _FISHER),
    "pca_samples": (pca, None),
    "differential": (differential, None),
    "rpm": (rpm, _WITH + " SELECT chrom, strand, position, round(count(*) * 1e6 / (SELECT count(*) FROM reads), 6) AS rpm FROM reads GROUP BY ALL"),
    "qc_stats": (qc_stats, _QC + " SELECT count(*) AS n_reads, count(*) FILTER (is_primary) AS n_primary, count(*) FILTER (ambiguous) AS n_ambiguous, count(*) FILTER (corrected) AS n_corrected, max(shift) AS max_shift, CAST(sum(shift) AS BIGINT) AS total_shift FROM q"),
    "validation_metrics": (validation_metrics, _QC + " SELECT coalesce(correction, 'all') AS correction, coalesce(confidence, 'all') AS confidence, count(*) AS n_rows, count(error) AS n_truth, count(*) FILTER (error = 0) AS within_0, count(*) FILTER (error <= 1) AS within_1, count(*) FILTER (error <= 2) AS within_2, count(*) FILTER (error <= 5) AS within_5, count(*) FILTER (error < before) AS improved, count(*) FILTER (error > before) AS worsened FROM q GROUP BY GROUPING SETS ((), (correction), (confidence))"),
    "variant_frequency": (variant_frequency, _VARIANT),
    "shift_calibration": (shift_calibration, _WITH + ", r AS (SELECT position % 11 AS a_count, sample, avg(CAST(span AS DOUBLE)) AS m FROM reads GROUP BY ALL), g AS (SELECT a_count, avg(m) AS mt FROM r GROUP BY a_count) SELECT a_count, round(mt, 6) AS mean_tail, round(greatest(0.0, (SELECT mt FROM g WHERE a_count = 0) - mt), 6) AS shift FROM g"),
    "sync_points": (sync_points, _WITH + ", m AS (SELECT read_id, aligner, line + span % 2 AS qpos, line * 2 + span % 2 AS rpos FROM reads), t AS (SELECT read_id, count(DISTINCT aligner) AS k FROM m GROUP BY read_id), s AS (SELECT m.read_id, qpos, rpos FROM m JOIN t USING (read_id) GROUP BY m.read_id, qpos, rpos, k HAVING count(DISTINCT aligner) = k), f AS (SELECT *, CASE WHEN qpos - lag(qpos) OVER w = 1 AND rpos - lag(rpos) OVER w = 1 THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY read_id ORDER BY qpos, rpos)), g AS (SELECT *, sum(n) OVER (PARTITION BY read_id ORDER BY qpos, rpos ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT read_id, min(qpos) AS q_start, max(qpos) AS q_end, min(rpos) AS r_start FROM g GROUP BY read_id, run"),
    "sample_condition_regex": (sample_conditions, "SELECT regexp_replace(substring(s_name, 1, 4) || '_rep' || CAST(s_suppkey % 10 AS VARCHAR), '_rep[0-9]+$', '') AS condition, count(*) AS n FROM supplier GROUP BY 1"),
    "natural_sort": (natural_sort, "SELECT DISTINCT 'chr' || CAST(p_partkey % 30 AS VARCHAR) || '_' || CAST(p_size AS VARCHAR) AS name, 'chr' || lpad(CAST(p_partkey % 30 AS VARCHAR), 4, '0') || '_' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS key FROM part"),
}
