"""Choosing among aligners: scores, confidence, winners, agreement, complementary pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def alignment_score(clip: Column, rescued: Column, a_depth: Column, three_clip: Column, junction_errors: Column) -> Column:
    """0 is best: clipped 5' bases (unless rescued), As at the 3' end, clipped 3' bases and
    errors near junctions count against an alignment."""
    return -2 * F.when(rescued, 0).otherwise(clip) - F.least(a_depth, F.lit(10)) - F.least(2 * three_clip, F.lit(10)) - F.least(junction_errors, F.lit(10))


def best_aligner(alignments: DataFrame, read: list[str]) -> DataFrame:
    """One row for each read: the alignment of the best score; ties go to more aligners with
    its 3' end, more annotated junctions, more canonical ones, then the aligner's name.
    Adds n_tied (alignments with the best score) and n_aligners."""
    r, end = Window.partitionBy(*read), Window.partitionBy(*read, "three_prime")
    a = alignments.withColumn("n_same_end", F.count(F.lit(1)).over(end)).withColumn("n_tied", F.sum((F.col("score") == F.max("score").over(r)).cast("int")).over(r))
    a = a.withColumn("n_aligners", F.count(F.lit(1)).over(r))
    order = [F.col(c).desc() for c in ("score", "n_same_end", "n_annotated", "n_canonical")] + [F.col("aligner").asc()]
    return a.withColumn("__r", F.row_number().over(r.orderBy(*order))).where("__r = 1").drop("__r")


def consensus_confidence(alignments: DataFrame, read: list[str]) -> DataFrame:
    """high if all aligners agree on strand and junctions, medium if two do, else low."""
    votes = alignments.groupBy(*read, "strand", F.array_sort("junctions").alias("junctions")).agg(F.countDistinct("aligner").alias("n"))
    best = votes.groupBy(*read).agg(F.max("n").alias("agree"), F.sum("n").alias("total"))
    return best.withColumn("confidence", F.when(F.col("agree") == F.col("total"), "high").when(F.col("agree") >= 2, "medium").otherwise("low"))


def agreement(rows: DataFrame, read: list[str], end: str) -> DataFrame:
    return rows.withColumn("n_agree", F.count(F.lit(1)).over(Window.partitionBy(*read, end)))


def winners(rows: DataFrame, read: list[str]) -> DataFrame:
    """All rows of each read's winning aligner. rows: aligner, rescued, confidence, n_agree,
    span, n_junctions. Each aligner is represented by its row of largest fraction."""
    rank = F.element_at(F.create_map(F.lit("high"), F.lit(2), F.lit("medium"), F.lit(1), F.lit("low"), F.lit(0)), F.col("confidence"))
    best_row = Window.partitionBy(*read, "aligner").orderBy(F.col("fraction").desc(), "three_prime")
    first = rows.withColumn("__r", F.row_number().over(best_row)).where("__r = 1")
    key = F.struct(F.col("rescued").cast("int"), F.coalesce(rank, F.lit(0)), "n_agree", "span", "n_junctions")
    order = Window.partitionBy(*read).orderBy(key.desc(), "aligner")
    won = first.withColumn("__w", F.row_number().over(order)).where("__w = 1").select(*read, "aligner")
    return rows.join(won, [*read, "aligner"], "left_semi")


def complementary_pairs(alignments: DataFrame, read: list[str]) -> DataFrame:
    """Pairs of aligners of a read that each found junctions the other has not."""
    a = alignments.select(*read, F.col("aligner").alias("first"), F.col("junctions").alias("j1"))
    b = alignments.select(*read, F.col("aligner").alias("second"), F.col("junctions").alias("j2"))
    pairs = a.join(b, read).where("first < second")
    return pairs.withColumns({"only_first": F.size(F.array_except("j1", "j2")), "only_second": F.size(F.array_except("j2", "j1"))}).where("only_first > 0 AND only_second > 0").drop("j1", "j2")


def sync_points(matches: DataFrame, read: list[str]) -> DataFrame:
    """(qpos, rpos) on which all aligners of a read agree, cut into runs of one diagonal.
    matches: read, aligner, qpos, rpos."""
    total = matches.groupBy(*read).agg(F.countDistinct("aligner").alias("k"))
    same = matches.groupBy(*read, "qpos", "rpos").agg(F.countDistinct("aligner").alias("n")).join(total, read).where("n = k")
    w = Window.partitionBy(*read).orderBy("qpos", "rpos")
    step = F.when((F.col("qpos") - F.lag("qpos").over(w) == 1) & (F.col("rpos") - F.lag("rpos").over(w) == 1), 0).otherwise(1)
    runs = same.withColumn("step", step).withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*read, "run").agg(F.min("qpos").alias("q_start"), F.max("qpos").alias("q_end"), F.min("rpos").alias("r_start")).drop("run")
