"""Every query with SQL against DuckDB, streaming against batch, and invariants."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from endloom.operators import clustering as C
from endloom.operators import intervals as I
from endloom.operators import junctions as J
from endloom.operators import signal as X
from endloom.operators import stats as T
from endloom.plans import all_queries
from endloom.streaming import sessions

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITH_SQL = sorted(n for n, (_, sql) in all_queries().items() if sql)
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    f, sql = all_queries()[name]
    a, b = f(spark, DATA).toPandas(), duck.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    number = lambda df: df.apply(lambda c: c.astype(float) if c.dtype.kind in "iufb" or str(c.dtype) in ("Int64", "Int32") else c)
    assert rows(number(a)) == rows(number(b))


@needs_data
@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in all_queries().items() if not sql))
def test_query_without_sql_runs(spark, name):
    assert all_queries()[name][0](spark, DATA).count() > 0


@needs_data
def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@needs_data
def test_adaptive_clusters_do_not_depend_on_partitions(spark):
    from endloom.plans.analogs import reads

    r = reads(spark, DATA)
    a, b = (sorted(map(tuple, C.cluster_adaptive(r.repartition(n), ["chrom", "strand"]).collect())) for n in (1, 7))
    assert a == b and a


def test_joins_handle_nulls_and_empty(spark):
    p = spark.createDataFrame([("c", 5), ("c", None), (None, 5)], "chrom string, pos long")
    i = spark.createDataFrame([("c", 0, 5, "a"), ("c", 5, 9000, "b"), ("c", None, 9, "x")], "chrom string, s long, e long, id string")
    assert sorted(r["id"] for r in I.point_in_interval(p, i, ["chrom"], "pos", "s", "e").collect()) == ["a", "b"]
    assert [r["id"] for r in I.point_in_interval(p, i, ["chrom"], "pos", "s", "e", half_open=True).collect()] == ["b"]
    assert I.exclude(p, i.limit(0), ["chrom"], "pos", "s", "e").count() == 3
    assert C.cluster_fixed(p.limit(0), ["chrom"], "pos").collect() == []


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([("c", 0, 20_000)], "chrom string, s long, e long")
    b = spark.createDataFrame([("c", 100, 15_000, 1), ("c", 19_999, 30_000, 2), ("c", 20_000, 20_001, 3)], "chrom string, s2 long, e2 long, id int")
    assert sorted((r["id"], r["overlap_bp"]) for r in I.overlaps(a, b, ["chrom"], ("s", "e"), ("s2", "e2"), width=512).collect()) == [(1, 14_900), (2, 1)]


def test_partial_evidence(spark):
    full = spark.createDataFrame([("c", "+", 1, 9, 3), ("c", "+", 2, 9, 1)], "chrom string, strand string, j_start long, j_end long, n_reads long")
    part = spark.createDataFrame([("c", "+", 1, 9, 7, 4), ("c", "+", 2, 9, 7, 4), ("c", "+", 5, 9, 8, 2)], "chrom string, strand string, j_start long, j_end long, group_id long, n_partial long")
    assert sorted((r["j_start"], r["n_reads"]) for r in J.with_partial_evidence(full, part).collect()) == [(1, 6.0), (2, 2.0), (5, 2.0)]
    assert sorted((r["j_start"], r["n_reads"]) for r in J.with_partial_evidence(full, part, "holdout").collect()) == [(1, 3.0), (2, 1.0), (5, 2.0)]


def test_motifs_and_ambiguous_junctions(spark):
    genome = spark.createDataFrame([("c", "CCAAGTCCCCAGAATT")], "chrom string, seq string")
    j = spark.createDataFrame([("c", "+", 4, 12, 5), ("c", "-", 4, 12, 1)], "chrom string, strand string, j_start long, j_end long, n_reads long")
    assert {r["strand"]: r["motif"] for r in J.with_motif(j, genome).collect()} == {"+": "GT-AG", "-": "non-canonical"}
    slid = spark.createDataFrame([("c", "+", 2, 12, 2), ("c", "+", 3, 13, 3), ("c", "+", 4, 14, 1)], j.schema)
    merged = J.merge_ambiguous(slid, genome).collect()
    assert sum(r["n_reads"] for r in merged) == 6 and len(merged) < 3


def test_fractions_sum_to_one(spark):
    sites = spark.createDataFrame([("c", "+", 10, [0.0] * 3 + [5.0, 9.0, 2.0] + [0.0] * 5), ("c", "+", 50, [0.0] * 11)], "chrom string, strand string, site long, signal array<double>")
    out = X.refine(sites, ["chrom", "strand"], "site", 5, [0.6, 0.4]).groupBy("site").agg(F.sum("fraction").alias("f"), F.min("refined").alias("r")).collect()
    assert all(abs(r["f"] - 1) < 1e-9 for r in out) and {r["site"]: r["r"] for r in out}[50] == 50


def test_adjusted_p_values_and_pca(spark):
    t = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.04, None])], "feature long, p double")
    got = {r["feature"]: r["padj"] for r in T.benjamini_hochberg(t).collect()}
    assert got[4] is None and all(abs(got[i] - v) < 1e-12 for i, v in {0: 0.04, 1: 0.04, 2: 0.04, 3: 0.04}.items())
    counts = spark.createDataFrame([(f, s, (10 if (s < "c") == (f % 2 == 0) else 100) + f) for f in range(20) for s in "abcd"], "feature long, sample string, count long")
    pc = {r["sample"]: r["pc1"] for r in T.pca_samples(counts).collect()}
    assert pc["a"] * pc["b"] > 0 and pc["c"] * pc["d"] > 0 and pc["a"] * pc["c"] < 0


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 2}", 1_700_000_000 + (i * 37) % 500 * 7) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, t long").select("key", F.timestamp_seconds("t").alias("ts"), F.lit(1.5).alias("w"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.session_clusters(stream, "key", "ts", 30, "1 hour").writeStream.outputMode("complete").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    batch = sessions.session_clusters(df, "key", "ts", 30)
    assert sorted(map(tuple, spark.table("sess").collect())) == sorted(map(tuple, batch.collect()))
    w = sessions.merge_partial_sums(str(tmp_path / "sums"), ["key"], "w")
    q = stream.writeStream.foreachBatch(w).option("checkpointLocation", str(tmp_path / "cp")).option("maxFilesPerTrigger", 1).start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: r["w"] for r in sessions.read_sums(spark, str(tmp_path / "sums"), ["key"], "w").collect()} == {"k0": 60.0, "k1": 60.0}


def test_walkback_uses_whole_sequences(spark, tmp_path):
    from endloom.plans.sequence_queries import walk_back

    texts = ["c" * 60 + "a" * 5, "c" * 30, "c", "a" * 50, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r["position"] for r in walk_back(spark, str(tmp_path)).collect()}
    assert out == {0: 59, 1: 29, 2: 0, 3: 69, 4: 19, 5: 19}


def test_affine_cigar_aligns_whole_types(spark, tmp_path):
    from endloom.plans.sequence_queries import affine

    spark.createDataFrame([(1, "Brand#1", "STANDARD BRUSHED Brand#1")], "p_partkey long, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in affine(spark, str(tmp_path)).collect()] == [(1, 2 * 7 - 4 - 17, "17D7M")]


def _runs(rows, gap):
    """Island numbers of sorted (key, position) rows, by a loop."""
    out, last = {}, {}
    for k, p in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        number, before = last.get(k, (0, None))
        number += before is not None and p - before > gap
        last[k] = (number, p)
        out[k, p] = number
    return out


@pytest.mark.parametrize("wide", [7, 50, 1 << 20])
def test_stretches_are_stitched(spark, monkeypatch, wide):
    """What runs along a chromosome does not depend on where it is cut."""
    monkeypatch.setattr(I, "WIDE", wide)
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-40, 400)) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, p long")
    assert {(r["k"], r["p"]): r["n"] for r in C.islands(df, ["k"], "p", 6, "n").collect()} == _runs(rows, 6)

    spans = [(k, p, p + rng.randint(0, 30)) for k, p in rows]
    frame = spark.createDataFrame(spans, "k string, s long, e long")
    want = []
    for k in {k for k, _ in rows}:
        for s, e in sorted((s, e) for x, s, e in spans if x == k):
            if want and want[-1][0] == k and s <= want[-1][2] + 2:
                want[-1][2], want[-1][3] = max(want[-1][2], e), want[-1][3] + 1
            else:
                want.append([k, s, e, 1])
    merged = I.merge_intervals(frame, ["k"], "s", "e", 2)
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted((list(r) for r in merged.collect()), key=key) == sorted(want, key=key)
    holes = [(a[0], a[2], b[1]) for a, b in zip(sorted(want, key=key), sorted(want, key=key)[1:]) if a[0] == b[0] and b[1] - a[2] >= 4]
    assert sorted((tuple(r) for r in I.gaps(merged, ["k"], "s", "e", 4).collect()), key=key) == sorted(holes, key=key)

    covered = {}
    for k, s, e in spans:
        for x in range(s, e):
            covered[k, x] = covered.get((k, x), 0) + 1
    got = {}
    for k, s, e, d in I.depth(frame, ["k"], "s", "e").collect():
        got |= {(k, x): d for x in range(s, e)}
    assert got == covered


@pytest.mark.parametrize("wide", [64, 1 << 20])
def test_equal_intervals_stay_together(spark, monkeypatch, wide):
    """Merged intervals do not depend on the order in which a join gives equal rows."""
    monkeypatch.setattr(I, "WIDE", wide)
    carried = I.carried
    monkeypatch.setattr(I, "carried", lambda *a: carried(*a).repartition(5, F.rand(3)))
    rng = random.Random(17)
    spans = [(k, s, s + rng.randint(-3, 6)) for k in ("a", None) for s in rng.choices(range(0, 3000, 7), k=300) for _ in range(rng.choice([1, 4, 9]))]
    want = []
    for k in ("a", None):
        for s, e in sorted((s, e) for x, s, e in spans if x == k):
            reach = max([x[4] for x in want if x[0] == k], default=s)
            if want and want[-1][0] == k and s <= reach:
                want[-1][2:] = [max(want[-1][2], e), want[-1][3] + 1, max(reach, e)]
            else:
                want.append([k, s, e, 1, max(reach, e) if want and want[-1][0] == k else e])
    merged = I.merge_intervals(spark.createDataFrame(spans, "k string, s long, e long"), ["k"], "s", "e")
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted((list(r) for r in merged.collect()), key=key) == sorted((x[:4] for x in want), key=key)


def test_anchored_clusters_against_a_loop(spark):
    rng = random.Random(14)
    rows = [(rng.choice(["a", None]), rng.choice("+-"), rng.randint(0, 300)) for _ in range(400)]
    want = []
    for k, s in {(k, s) for k, s, _ in rows}:
        counts = {}
        for x in (p for a, b, p in rows if (a, b) == (k, s)):
            counts[x] = counts.get(x, 0) + 1
        for p in sorted(counts):
            if want and want[-1][0] == (k, s) and p - want[-1][1][0] <= 4:
                want[-1][1].append(p)
            else:
                want.append(((k, s), [p], counts))
    key = lambda r: str(r)
    shown = [(*g, m[0], m[-1], min(m, key=lambda p: (-c[p], p)), sum(c[p] for p in m)) for g, m, c in want]
    out = C.cluster_anchored(spark.createDataFrame(rows, "chrom string, strand string, position long"), ["chrom", "strand"], window=4)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(shown, key=key)
    # Batches may end anywhere.
    pos, count, group = np.array([1, 3, 5, 9, 2, 4]), np.array([2, 9, 1, 1, 5, 5]), np.array([0, 0, 0, 0, 1, 1])
    whole = list(C.anchored(iter([(["x", "y"], group, pos, count)]), 4))
    assert whole == [("x", 1, 5, 3, 12), ("x", 9, 9, 9, 1), ("y", 2, 4, 2, 10)]
    single = [([["x", "y"][g]], np.array([0]), pos[i : i + 1], count[i : i + 1]) for i, g in enumerate(group)]
    assert list(C.anchored(iter(single), 4)) == whole


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 5)), min_size=1, max_size=25, unique_by=lambda x: x[0]), st.integers(1, 9))
@settings(deadline=None, max_examples=80)
def test_greedy_kernels_against_loops(rows, reach):
    rows.sort()
    pos, count = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    taken = []
    for i in np.lexsort((-pos, -count)):
        if all(abs(int(pos[i]) - int(pos[j])) >= reach for j in taken):
            taken.append(int(i))
    assert C.greedy_peaks(pos, count, reach) == sorted(taken)
    sums, want = [], []
    for s, e in zip(pos.tolist(), (pos + count).tolist()):
        g = next((g for g, (a, b, n) in enumerate(sums) if abs(s - a / n) <= reach and abs(e - b / n) <= reach), len(sums))
        if g == len(sums):
            sums.append((0.0, 0.0, 0))
        sums[g] = (sums[g][0] + s, sums[g][1] + e, sums[g][2] + 1)
        want.append(g)
    assert C.centroid_groups(pos, pos + count, reach).tolist() == want
