"""Queries on positions, clusters, intervals and coverage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import intervals as I
from .analogs import GENES_SQL, READS_SQL, genes, reads, table

KEYS = ["chrom", "strand"]
_WITH = "WITH " + READS_SQL.strip()


def position_counts(s, d) -> DataFrame:
    return C.position_counts(reads(s, d), [*KEYS, "position"])


def weighted_position_index(s, d) -> DataFrame:
    return C.position_counts(reads(s, d), [*KEYS, "position"], "weight", "total").withColumn("total", F.round("total", 6))


_ISLANDS = _WITH + """,
steps AS (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY chrom, strand ORDER BY position, read_id, line, cigar) > 25 THEN 1 ELSE 0 END AS step FROM reads),
marked AS (SELECT *, sum(step) OVER (PARTITION BY chrom, strand ORDER BY position, read_id, line, cigar ROWS UNBOUNDED PRECEDING) AS island FROM steps),
kept AS (
  SELECT chrom, strand, min(position) AS "start", max(position) AS "end", CAST(floor(median(position)) AS BIGINT) AS modal_position, count(*) AS n_positions
  FROM marked GROUP BY chrom, strand, island HAVING count(*) >= 5
),
clusters AS (SELECT *, 'cluster_' || lpad(CAST(row_number() OVER (ORDER BY chrom, strand, "start") - 1 AS VARCHAR), 6, '0') AS cluster_id FROM kept)
"""


def clusters(s, d) -> DataFrame:
    return C.cluster_fixed(reads(s, d), KEYS)


def assigned(s, d) -> DataFrame:
    """Reads with the cluster that holds them; distinct positions are matched, not reads."""
    r = reads(s, d)
    found = clusters(s, d).select(*KEYS, F.col("start").alias("c_start"), F.col("end").alias("c_end"), "cluster_id")
    places = C.position_counts(r, [*KEYS, "position", "sample"], "weight", "weight")
    return I.first_containing(places, found, KEYS, "position", "c_start", "c_end", "cluster_id", [*KEYS, "position", "sample"], how="inner")


def count_matrix(s, d) -> DataFrame:
    long = C.count_matrix(assigned(s, d), clusters(s, d), reads(s, d).select("sample"))
    return long.withColumn("total", F.round("total", 6))


_MATRIX = _ISLANDS + """,
sums AS (SELECT cluster_id, sample, sum(weight) AS total FROM reads r JOIN clusters c ON r.chrom = c.chrom AND r.strand = c.strand AND r.position BETWEEN c."start" AND c."end" GROUP BY ALL),
matrix AS (SELECT c.cluster_id, n.sample, round(coalesce(total, 0.0), 6) AS total FROM clusters c CROSS JOIN (SELECT DISTINCT sample FROM reads) n LEFT JOIN sums s ON s.cluster_id = c.cluster_id AND s.sample = n.sample)
"""


def count_matrix_wide(s, d) -> DataFrame:
    return C.wide_matrix(count_matrix(s, d), "cluster_id", "sample", [f"s{i}" for i in range(6)])


def nearest_gene(s, d) -> DataFrame:
    found = clusters(s, d).select("cluster_id", *KEYS, "modal_position")
    g = genes(s, d).select(*KEYS, "gene_id", "gene_3prime")
    sign = F.when(F.col("strand") == "+", 1).otherwise(-1)
    return I.nearest_bounded(found, g, KEYS, "modal_position", "gene_3prime", -500, 100, sign, "gene_id", ["cluster_id"]).where("gene_id IS NOT NULL").select("cluster_id", "gene_id", "distance")


_NEAREST = _ISLANDS + "," + GENES_SQL + """,
near AS (
  SELECT c.cluster_id, g.gene_id, (c.modal_position - g.gene_3prime) * CASE WHEN c.strand = '+' THEN 1 ELSE -1 END AS distance,
         row_number() OVER (PARTITION BY c.cluster_id ORDER BY abs(c.modal_position - g.gene_3prime), g.gene_3prime, g.gene_id) AS r
  FROM clusters c JOIN genes g ON g.chrom = c.chrom AND g.strand = c.strand AND (c.modal_position - g.gene_3prime) * CASE WHEN c.strand = '+' THEN 1 ELSE -1 END BETWEEN -500 AND 100
)
SELECT cluster_id, gene_id, distance FROM near WHERE r = 1
"""


def cluster_anchored(s, d) -> DataFrame:
    return C.cluster_anchored(reads(s, d), KEYS)


_ANCHORED = "WITH RECURSIVE " + READS_SQL.strip() + """,
q AS (SELECT chrom, strand, position, count(*) AS c FROM reads GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand ORDER BY position) AS i FROM q),
walk AS (
  SELECT chrom, strand, position, c, i, position AS anchor FROM p WHERE i = 1
  UNION ALL
  SELECT p.chrom, p.strand, p.position, p.c, p.i, CASE WHEN p.position - w.anchor <= 10 THEN w.anchor ELSE p.position END
  FROM walk w JOIN p ON p.chrom = w.chrom AND p.strand = w.strand AND p.i = w.i + 1
)
SELECT chrom, strand, anchor AS "start", max(position) AS "end", arg_min(position, (-c) * 1000000000 + position) AS mode, CAST(sum(c) AS BIGINT) AS n_reads FROM walk GROUP BY chrom, strand, anchor
"""


def cluster_adaptive(s, d) -> DataFrame:
    return C.cluster_adaptive(reads(s, d), KEYS)


def read_genes(s, d) -> DataFrame:
    """Read bodies and the genes that they overlap. Equal bodies are matched once."""
    bodies = reads(s, d).select(*KEYS, F.col("position").alias("r_start"), (F.col("position") + F.col("span")).alias("r_end"))
    bodies = bodies.groupBy(*KEYS, "r_start", "r_end").agg(F.count(F.lit(1)).alias("n"))
    return I.overlaps(bodies, genes(s, d).select(*KEYS, "gene_id", "g_start", "g_end"), KEYS, ("r_start", "r_end"), ("g_start", "g_end"))


def read_gene_overlap(s, d) -> DataFrame:
    return read_genes(s, d).groupBy("gene_id").agg(F.sum("n").alias("n_reads"), F.sum(F.col("n") * F.col("overlap_bp")).alias("overlap_bp"))


_OVERLAP = _WITH + "," + GENES_SQL + """,
bodies AS (SELECT chrom, strand, position, span, count(*) AS n FROM reads GROUP BY ALL),
pairs AS (
  SELECT r.*, gene_id, least(position + span, g_end) - greatest(position, g_start) AS bp
  FROM bodies r JOIN genes g ON r.chrom = g.chrom AND r.strand = g.strand AND position < g_end AND g_start < position + span
)
"""


def primary_gene(s, d) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(*KEYS, "r_start", "r_end").orderBy(F.col("overlap_bp").desc(), "gene_id")
    best = read_genes(s, d).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.groupBy("gene_id").agg(F.sum("n").alias("n_reads"))


def intron_containment(s, d) -> DataFrame:
    """The innermost boundary of the gene intervals that hold a 5' end."""
    ends = C.position_counts(reads(s, d), [*KEYS, "position"], name="n")
    hits = I.point_in_interval(ends, genes(s, d).select(*KEYS, "g_start", "g_end"), KEYS, "position", "g_start", "g_end", half_open=True)
    return hits.groupBy(*KEYS, "position", "n").agg(F.when(F.col("strand") == "+", F.min("g_start")).otherwise(F.max("g_end")).alias("boundary"))


_CONTAIN = _WITH + "," + GENES_SQL + """
SELECT r.chrom, r.strand, position, n, CASE WHEN r.strand = '+' THEN min(g_start) ELSE max(g_end) END AS boundary
FROM (SELECT chrom, strand, position, count(*) AS n FROM reads GROUP BY ALL) r JOIN genes g ON r.chrom = g.chrom AND r.strand = g.strand AND position >= g_start AND position < g_end
GROUP BY r.chrom, r.strand, position, n
"""


def _regions(s, d) -> DataFrame:
    sup = table(s, d, "supplier")
    chrom = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return sup.select(chrom.alias("chrom"), (F.col("s_suppkey") * 700).alias("x_start"), (F.col("s_suppkey") * 700 + 150 + F.col("s_nationkey") * 3).alias("x_end"), F.concat(F.lit("region"), F.col("s_suppkey")).alias("reason"))


_REGIONS = "regions AS (SELECT ['A', 'N', 'R'][s_nationkey % 3 + 1] AS chrom, s_suppkey * 700 AS x_start, s_suppkey * 700 + 150 + s_nationkey * 3 AS x_end, 'region' || s_suppkey AS reason FROM supplier)"


def exclusion_anti(s, d) -> DataFrame:
    return I.exclude(C.position_counts(reads(s, d), [*KEYS, "position"]), _regions(s, d), ["chrom"], "position", "x_start", "x_end")


def exclusion_reason(s, d) -> DataFrame:
    places = C.position_counts(reads(s, d), ["chrom", "position"])
    hits = I.point_in_interval(places, _regions(s, d), ["chrom"], "position", "x_start", "x_end", half_open=True, how="left")
    return hits.groupBy("chrom", "position", "count").agg(F.coalesce(F.min("reason"), F.lit("none")).alias("reason"))


def merged_intervals(s, d) -> DataFrame:
    ev = table(s, d, "events").select("event_type", F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + 5 + F.col("user_id") % 40).alias("end"))
    return I.merge_intervals(ev, ["event_type"], "start", "end")


_EVENTS = "ev AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS \"start\", CAST(floor(epoch(ts)) AS BIGINT) + 5 + user_id % 40 AS \"end\" FROM events)"
_MERGED = "WITH " + _EVENTS + """,
f AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY event_type ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM ev),
g AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS i FROM f),
m AS (SELECT event_type, min("start") AS "start", max("end") AS "end", count(*) AS n FROM g GROUP BY event_type, i)
"""


def coverage_gaps(s, d) -> DataFrame:
    return I.gaps(merged_intervals(s, d), ["event_type"], "start", "end", 60)


def coverage_depth(s, d) -> DataFrame:
    r = reads(s, d).select("chrom", F.col("position").alias("start"), (F.col("position") + F.col("span")).alias("end"))
    return I.depth(r, ["chrom"], "start", "end")


_DEPTH = _WITH + """,
e AS (SELECT chrom, pos, sum(x) AS x FROM (SELECT chrom, position AS pos, 1 AS x FROM reads UNION ALL SELECT chrom, position + span, -1 FROM reads) GROUP BY ALL),
r AS (SELECT chrom, pos AS "start", lead(pos) OVER w AS "end", CAST(sum(x) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM e WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT * FROM r WHERE depth > 0
"""


def session_clusters(s, d) -> DataFrame:
    """Single-linkage clusters over time: events of a type at most 30 seconds apart."""
    from ..streaming.sessions import session_clusters as op

    return op(table(s, d, "events"), "event_type", "ts", 30)


_SESSIONS = """
WITH f AS (SELECT event_type, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) >= 30 THEN 1 ELSE 0 END AS n FROM events),
g AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT event_type AS key, CAST(round(epoch(min(ts)) * 1000000) AS BIGINT) AS start_us, CAST(round(epoch(max(ts)) * 1000000) AS BIGINT) AS end_us, count(*) AS n FROM g GROUP BY event_type, i
"""


def centroid_dedup(s, d) -> DataFrame:
    j = reads(s, d).select(*KEYS, F.col("position").alias("start"), (F.col("position") + F.col("span")).alias("end")).distinct()
    return C.centroid_dedup(j, KEYS, "start", "end")


QUERIES = {
    "position_counts": (position_counts, _WITH + " SELECT chrom, strand, position, count(*) AS count FROM reads GROUP BY ALL"),
    "weighted_position_index": (weighted_position_index, _WITH + " SELECT chrom, strand, position, round(sum(weight), 6) AS total FROM reads GROUP BY ALL"),
    "cluster_fixed": (clusters, _ISLANDS + " SELECT * FROM clusters"),
    "cluster_count_matrix": (count_matrix, _MATRIX + " SELECT * FROM matrix"),
    "cluster_count_matrix_wide": (count_matrix_wide, _MATRIX + " SELECT cluster_id, " + ", ".join(f"sum(CASE WHEN sample = 's{i}' THEN total END) AS s{i}" for i in range(6)) + " FROM matrix GROUP BY cluster_id"),
    "cluster_nearest_gene": (nearest_gene, _NEAREST),
    "cluster_anchored": (cluster_anchored, _ANCHORED),
    "cluster_adaptive": (cluster_adaptive, None),
    "centroid_dedup": (centroid_dedup, None),
    "read_gene_overlap": (read_gene_overlap, _OVERLAP + " SELECT gene_id, CAST(sum(n) AS BIGINT) AS n_reads, CAST(sum(n * bp) AS BIGINT) AS overlap_bp FROM pairs GROUP BY gene_id"),
    "primary_gene": (primary_gene, _OVERLAP + " SELECT gene_id, CAST(sum(n) AS BIGINT) AS n_reads FROM (SELECT gene_id, n, row_number() OVER (PARTITION BY chrom, strand, position, span ORDER BY bp DESC, gene_id) AS r FROM pairs) WHERE r = 1 GROUP BY gene_id"),
    "intron_containment": (intron_containment, _CONTAIN),
    "exclusion_anti": (exclusion_anti, _WITH + ", " + _REGIONS + " SELECT chrom, strand, position, count(*) AS count FROM reads r WHERE NOT EXISTS (SELECT 1 FROM regions x WHERE x.chrom = r.chrom AND r.position >= x_start AND r.position < x_end) GROUP BY ALL"),
    "exclusion_reason": (exclusion_reason, _WITH + ", " + _REGIONS + ", p AS (SELECT chrom, position, count(*) AS count FROM reads GROUP BY ALL) SELECT p.chrom, position, count, coalesce(min(reason), 'none') AS reason FROM p LEFT JOIN regions x ON x.chrom = p.chrom AND position >= x_start AND position < x_end GROUP BY ALL"),
    "merge_intervals": (merged_intervals, _MERGED + " SELECT * FROM m"),
    "coverage_gaps": (coverage_gaps, _MERGED + ', l AS (SELECT event_type, "end" AS gap_start, lead("start") OVER (PARTITION BY event_type ORDER BY "start") AS gap_end FROM m) SELECT * FROM l WHERE gap_end - gap_start >= 60'),
    "coverage_depth": (coverage_depth, _DEPTH),
    "session_clusters": (session_clusters, _SESSIONS),
}
