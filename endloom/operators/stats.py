"""Statistics on long count tables (feature, sample, count)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def jensen_shannon(counts: DataFrame, key: str, item: str, a: str, b: str) -> DataFrame:
    """key, divergence (base 2) between the shares of columns a and b over items; null if a
    side is empty."""
    w = Window.partitionBy(key)
    c = counts.withColumn("p", F.col(a) / F.nullif(F.sum(a).over(w), F.lit(0))).withColumn("q", F.col(b) / F.nullif(F.sum(b).over(w), F.lit(0)))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return c.groupBy(key).agg(F.when(F.max(F.col("p").isNull() | F.col("q").isNull()), F.lit(None)).otherwise(F.sum(part("p") + part("q")) / 2).alias("divergence"))


def cluster_shift(counts: DataFrame, gene: str, position: str, a: str, b: str, least: float = 20) -> DataFrame:
    """The step from the major cluster of a to that of b along the strand. counts: gene,
    strand, position, a, b (means by condition). Ties: lowest position."""
    total = counts.groupBy(gene, "strand").agg(F.sum(F.col(a) + F.col(b)).alias("total"), F.max_by(position, F.struct(F.col(a), -F.col(position))).alias("major_a"), F.max_by(position, F.struct(F.col(b), -F.col(position))).alias("major_b"))
    shift = (F.col("major_b") - F.col("major_a")) * F.when(F.col("strand") == "+", 1).otherwise(-1)
    out = total.where(F.col("total") >= least).withColumn("shift", shift)
    return out.withColumn("direction", F.when(F.col("shift") > 2, "downstream").when(F.col("shift") < -2, "upstream").otherwise("none"))


def size_factors(counts: DataFrame) -> DataFrame:
    """sample, factor: the median over features with no zero of the ratio to the geometric
    mean (median of ratios)."""
    n = counts.select("sample").distinct().count()
    logs = counts.where("count > 0").select("feature", "sample", F.ln("count").alias("lc"))
    full = logs.groupBy("feature").agg(F.avg("lc").alias("g"), F.count(F.lit(1)).alias("k")).where(F.col("k") == n)
    return logs.join(full.select("feature", "g"), "feature").groupBy("sample").agg(F.exp(F.expr("percentile(lc - g, 0.5)")).alias("factor"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "feature") -> DataFrame:
    """Adds padj: the least of p * m / rank over this and all higher ranks, at most 1.

    Equal p-values share the result, so counts of distinct p-values suffice: the running
    minimum goes over distinct values and is joined back."""
    d = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("c"))
    m = d.agg(F.sum("c").alias("m"))
    up = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = d.withColumn("rank", F.sum("c").over(up)).crossJoin(F.broadcast(m)).withColumn("raw", F.col(p) * F.col("m") / F.col("rank"))
    adj = ranked.withColumn("padj", F.least(F.lit(1.0), F.min("raw").over(down))).select(p, "padj")
    return tests.join(adj, p, "left")


def log_factorials(spark, n: int) -> list[float]:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))]).tolist()


def fisher_greater(tables: DataFrame, hit: str, drawn: str, marked: str, total: str) -> DataFrame:
    """Adds p: the chance of at least ``hit`` marked among ``drawn`` of ``total`` of which
    ``marked`` are (hypergeometric upper tail)."""
    lf = lambda c: _log_factorial(c)
    choose = lambda n, k: lf(n) - lf(k) - lf(n - k)
    i_max = F.least(F.col(drawn), F.col(marked))
    terms = F.transform(F.when(i_max >= F.col(hit), F.sequence(F.col(hit), i_max)).otherwise(F.array()), lambda i: F.exp(choose(F.col(marked), i) + choose(F.col(total) - F.col(marked), F.col(drawn) - i) - choose(F.col(total), F.col(drawn))))
    return tables.withColumn("p", F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def _log_factorial(c):
    """ln(n!) by Stirling's series, exact to ten digits from the recurrence up to n + 8."""
    x = c.cast("double") + 9
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    for k in range(1, 9):
        series = series - F.ln(c.cast("double") + k)
    return series


def top_variance(counts: DataFrame, k: int) -> DataFrame:
    """The k features of largest sample variance; ties (to nine decimals, as the last digits
    depend on the order of summing) by name."""
    return counts.groupBy("feature").agg(F.var_samp("count").alias("variance")).orderBy(F.round("variance", 9).desc_nulls_last(), "feature").limit(k)


def zscores(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature")
    sd = F.stddev_samp("count").over(w)
    return counts.withColumn("z", F.when(sd > 0, (F.col("count") - F.avg("count").over(w)) / sd).otherwise(0.0))


def sample_correlation(counts: DataFrame) -> DataFrame:
    """Pearson correlation of all pairs of samples, on features that both have."""
    a = counts.select("feature", F.col("sample").alias("a"), F.col("count").alias("x"))
    b = counts.select("feature", F.col("sample").alias("b"), F.col("count").alias("y"))
    return a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def rpm(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    total = counts.agg(F.sum(value).alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(*keys, (F.col(value) * 1e6 / F.col("__t")).alias("rpm"))


def pca_samples(counts: DataFrame, components: int = 2) -> DataFrame:
    """sample, pc1, ... of log2(count + 1), standardised by feature. Features stay
    distributed: only the samples' Gram matrix, whose size is the square of the number of
    samples, reaches the driver. Signs make each component's largest entry positive."""
    w = Window.partitionBy("feature")
    x = counts.withColumn("v", F.log2(F.col("count") + 1))
    sd = F.stddev_pop("v").over(w)
    z = x.withColumn("z", F.when(sd > 0, (F.col("v") - F.avg("v").over(w)) / sd).otherwise(0.0)).select("feature", "sample", "z")
    names = [r["sample"] for r in z.select("sample").distinct().orderBy("sample").limit(5001).collect()]
    if len(names) > 5000:
        raise ValueError("too many samples for a dense Gram matrix")
    other = z.select("feature", F.col("sample").alias("other"), F.col("z").alias("y"))
    rows = z.join(other, "feature").groupBy("sample", "other").agg(F.sum(F.col("z") * F.col("y")).alias("g")).collect()
    at = {n: i for i, n in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in rows:
        gram[at[r["sample"]], at[r["other"]]] = r["g"]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:components]
    scores = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    scores *= np.where(scores[np.abs(scores).argmax(axis=0), range(scores.shape[1])] < 0, -1, 1)
    schema = "sample string, " + ", ".join(f"pc{i + 1} double" for i in range(scores.shape[1]))
    return counts.sparkSession.createDataFrame([(n, *map(float, s)) for n, s in zip(names, scores)], schema)


def _two_sided(z):
    """2 * (1 - normal cdf(|z|)) by a rational approximation with relative error 1.2e-7."""
    x = F.abs(z) / float(np.sqrt(2))
    t = 1 / (1 + 0.5 * x)
    # The coefficients of the approximation of erfc.
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def log2_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("v", F.log2(F.col("count") + 1))


def kmer_enrichment(sequences: DataFrame, k: int = 6, seq: str = "seq", chosen: str = "chosen") -> DataFrame:
    """sequences: seq, chosen (boolean). kmer, hit (chosen sequences that hold it), marked (all
    that do), p (one-sided) and padj. A sequence counts once for each of its k-mers."""
    kmers = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k))))
    each = sequences.where(F.length(seq) >= k).select(F.explode(kmers).alias("kmer"), chosen)
    total = sequences.agg(F.count(F.lit(1)).alias("total"), F.count_if(chosen).alias("drawn"))
    sets = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("marked"), F.count_if(chosen).alias("hit")).crossJoin(F.broadcast(total))
    tested = fisher_greater(sets, "hit", "drawn", "marked", "total").withColumn("p", F.round("p", 10))
    return benjamini_hochberg(tested, "p", "kmer").select("kmer", "hit", "marked", "p", "padj")


def flanks(sites: DataFrame, genome: DataFrame, upstream: int = 100, downstream: int = 50, least: float = 0.8) -> DataFrame:
    """sites (chrom, strand, position) with flank: the bases from upstream before to downstream
    after the position, along the strand; sites with less than a share of them go."""
    from ..functions import sequence as S

    j = sites.join(genome.select("chrom", F.col("seq").alias("__g")), "chrom")
    plus = F.col("strand") == "+"
    left = S.window(F.col("__g"), (F.col("position") - upstream).cast("int"), (F.col("position") + downstream).cast("int"))
    right = S.revcomp(S.window(F.col("__g"), (F.col("position") - downstream + 1).cast("int"), (F.col("position") + upstream + 1).cast("int")))
    return j.withColumn("flank", F.when(plus, left).otherwise(right)).where(F.length("flank") >= least * (upstream + downstream)).drop("__g")


def set_enrichment(chosen: DataFrame, universe: DataFrame, sets: DataFrame, gene: str = "gene_id", term: str = "go_id", smallest: int = 3, largest: int = 500) -> DataFrame:
    """term, hit, marked, expected, fold, p, padj (one-sided Fisher tests) of the sets (term,
    gene) that have smallest to largest genes of the universe. Sets without a hit are tested,
    as they count for padj, but not shown."""
    genes = universe.select(gene).distinct()
    picked = chosen.select(gene).distinct().join(genes, gene, "left_semi").withColumn("__in", F.lit(1))
    total = genes.join(picked, gene, "left").agg(F.count(F.lit(1)).alias("total"), F.count("__in").alias("drawn"))
    members = sets.select(term, gene).distinct().join(genes, gene, "left_semi").join(picked, gene, "left")
    sizes = members.groupBy(term).agg(F.count(F.lit(1)).alias("marked"), F.count("__in").alias("hit")).where(F.col("marked").between(smallest, largest))
    tested = fisher_greater(sizes.crossJoin(F.broadcast(total)), "hit", "drawn", "marked", "total").withColumn("p", F.round("p", 10))
    expected = F.col("drawn") * F.col("marked") / F.col("total")
    out = benjamini_hochberg(tested, "p", term).withColumns({"expected": expected, "fold": F.when(expected > 0, F.col("hit") / expected)})
    return out.where("hit > 0").select(term, "hit", "marked", "expected", "fold", "p", "padj")


def sample_linkage(counts: DataFrame, most: int = 2000) -> DataFrame:
    """step, a, b, height, size: the merges of samples by average linkage of one less their
    correlation. Clusters are named by their first sample. Of at most ``most`` samples, the
    matrix of pairs reaches the driver."""
    names = [r["sample"] for r in counts.select("sample").distinct().orderBy("sample").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError("too many samples for a dense matrix of distances")
    at = {n: i for i, n in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for r in sample_correlation(counts).collect():
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = 1.0 if r["r"] is None else 1 - r["r"]
    size, rows = np.ones(len(names)), []
    for step in range(len(names) - 1):
        a, b = divmod(int(np.argmin(d)), len(names))
        a, b = min(a, b), max(a, b)
        height = float(d[a, b])
        rows.append((step, names[a], names[b], height, int(size[a] + size[b])))
        d[a] = np.where(np.isinf(d[a]) | np.isinf(d[b]), np.inf, (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b]))
        d[:, a] = d[a]
        d[a, a] = d[b] = d[:, b] = np.inf
        size[a] += size[b]
    return counts.sparkSession.createDataFrame(rows, "step int, a string, b string, height double, size int")
