"""Exact dedup, decontamination, n-gram join, URL filter: against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from endloom.llm import common, components, decontaminate, exact_dedup, ngram_join, url_filter

DOCS = "doc_id long, text string, kind string, size long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def test_exact_dedup_against_brute_force(spark):
    texts = ["a b", "ab", " a\tb\n", None, "", " \r\n", "xy", "x y", "é ü", "éü", "ab", "longer  text", "long er text"] + ["same"] * 30
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(1, "ab", "x", 1), (None, "ab", "x", 1), (99, "ab  ", "x", 1)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        want += [(m[2], best, len(members), m[2] == best, hashlib.sha256(key.encode()).hexdigest()) for m in members]
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, out), key=order) == sorted(want, key=order)


def test_runs_are_merged_evenly_and_each_digest_on_one_node(spark):
    rows = exact_dedup.digests(frame(spark, [f"t{i % 700}" for i in range(2100)])).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(64)))
    leaves = exact_dedup.merged(rows.select("run", "sha", "chk", F.struct("n", "id").alias("best"), F.lit(1).cast("long").alias("size")))
    level = leaves
    for r in range(1, 4):
        level = exact_dedup.merge_runs(leaves, 4, r)
        assert level.agg(F.sum("size")).first()[0] == 2100
    assert level.count() == 700
    plan = exact_dedup.merge_runs(leaves, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(run") == 4 and plan.count("SortAggregate") >= 4 and "hashpartitioning(sha" not in plan
    nodes = {}

    def seen(entries):
        out = keep(entries)
        nodes.setdefault(len(nodes), [r["count"] for r in out.groupBy("run").count().collect()])
        return out

    keep, exact_dedup.merged = exact_dedup.merged, seen
    try:
        exact_dedup.merge_runs(leaves, 4, 3)
    finally:
        exact_dedup.merged = keep
    for counts in nodes.values():
        assert len(counts) == 64 and max(counts) <= 4 * min(counts) + 20


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, ngram_join.classes])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).collect() == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items, k):
    w, hit, found = words(doc), set(), set()
    for key, text in items:
        v = words(text)
        n = min(k, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if n else []:
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard_words", [10_000, 15])
def test_decontamination_against_brute_force(spark, shard_words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randint(1, 12))) for i in range(8)] + [(50, None), (None, "a b c d a b"), (51, "..."), (52, "É b, C-d a")]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", "é b c d A!", "a"]
    docs += docs[:3]
    out = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=4, shard_words=shard_words)
    rows = {r["doc_id"]: r for r in decontaminate.judged(out).collect()}
    assert len(rows) == len(docs)
    for i, d in enumerate(docs):
        n, hit, found = brute(d, [x for x in items if x[0] is not None], 4)
        assert (rows[i]["n_words"], rows[i]["n_hit"], sorted(rows[i]["items"])) == (n, hit, found), d
        assert rows[i]["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert rows[i]["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_remove_spans_keeps_clean_texts(spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = ["Start, one two; THREE four five end.", "nothing  here \n", None]
    out = [r["text"] for r in decontaminate.remove_spans(frame(spark, docs), bench, window=4).orderBy("doc_id").collect()]
    assert out == ["Start, end.", "nothing  here \n", None]


def test_remove_spans_is_the_same_over_shards(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6"), (2, "b1 b2 b3 b4 b5 b6"), (3, "a5 a6 b1 b2 b3")], "item_id long, text string")
    rest = [f"w{i}" for i in range(160)]
    apart = " ".join(["s", "a1 a2 a3 a4 a5 a6", *rest[:80], "b1 b2 b3 b4 b5 b6", *rest[80:]])  # 3.5 % each, 7 % together
    long = " ".join(["s", "a1 a2 a3 a4 a5 a6 b1 b2 b3 b4 b5 b6", *rest, *rest])  # one span of 12 words
    want = [" ".join(["s", *rest]), " ".join(["s", *rest, *rest]), None]

    def cleaned():
        return [r["text"] and " ".join(r["text"].split()) for r in decontaminate.remove_spans(frame(spark, [apart, long, None]), bench, max_span=8, window=4).orderBy("doc_id").collect()]

    assert cleaned() == want
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 6)
    assert cleaned() == want


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i][1] & sets[j][1])
            if both and 100 * both >= 80 * (len(sets[i][1]) + len(sets[j][1]) - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("frequent_from,max_match", [(16, 8), (2, 3), (3, 1)])
def test_ngram_join_against_brute_force(spark, frequent_from, max_match):
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randint(0, 400)
    texts = []
    passage = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 60))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["A b", "a  B", "a b c", None, "", " \n", "one two three four five", "one two three four five six", *texts[:2]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    out = ngram_join.classes(df, frequent_from=frequent_from, max_match=max_match).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute_classes(rows)


@pytest.mark.parametrize("max_frequent", [0, 1])
def test_long_postings_make_no_pairs(spark, monkeypatch, max_frequent):
    """300 documents with one passage: their postings stay rows, whether listed or not."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [passage + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 40))) for _ in range(300)]
    made, seen = [], ngram_join.rare_pairs

    def counted(*args):
        pairs, long = seen(*args)
        made.append((pairs.count(), long.groupBy("token").count().agg({"count": "min"}).first()[0]))
        return pairs, long

    monkeypatch.setattr(ngram_join, "rare_pairs", counted)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    out = ngram_join.classes(df, max_frequent=max_frequent).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute_classes(rows)
    assert made[0][0] < 300 and (made[0][1] or 16) >= 16


@pytest.mark.parametrize("max_frequent,block", [(0, (4, 500)), (3, (2, 10**6)), (2_000_000, (4, 60))])
def test_blocks_and_lists_do_not_change_the_classes(spark, monkeypatch, max_frequent, block):
    rng = random.Random(17)
    passages = [[f"p{k}x{i}" for i in range(25)] for k in range(3)]
    texts = []
    for _ in range(90):
        words = [w for k in rng.sample(range(3), rng.randint(0, 2)) for w in passages[k]] + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "z%d" % rng.randint(0, 30)
        texts.append(" ".join(words))
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    links = ngram_join.block_links
    monkeypatch.setattr(ngram_join, "block_links", lambda *args: links(*args, *block))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    out = ngram_join.classes(df, frequent_from=3, max_frequent=max_frequent).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute_classes(rows)


def test_a_set_is_one_row_whatever_tasks_meet_it(spark):
    texts = ["a b c d e f g", "a b c d e f h"] * 20
    rows = ngram_join._text_rows(frame(spark, texts).repartition(7), "doc_id", "text")
    fps = ngram_join.document_sets(frame(spark, texts)).select("fp").distinct()
    for most in (0, 100):  # by a join, by a broadcast list
        assert ngram_join.wanted_sets(rows, fps, 5, most).count() == 2


def test_sets_of_long_texts_in_parts():
    rng = random.Random(2)
    for text in (" ".join(rng.choice(["Alpha", "beta", "x", "y", "Gamma,", "日本"]) + rng.choice(["", "\n", "\t "]) for _ in range(3000)), "one two three", "abc " * 50 + "xyz"):
        whole, _ = ngram_join.shingle_sets(pa.array([text]))
        for part in (20, 300):
            keys, bounds = ngram_join.shingle_sets(pa.array([text]), part=part)
            assert keys.tolist() == whole.tolist() and bounds.tolist() == [0, len(whole)]


def test_spread_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 1000)
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("warm", 1), ("none", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", 40, "h"), ("warm", 1, "w"), ("other", 0, "o")], "k string, n_left long, x string")
    inner = sorted((r["k"], r["v"], r["x"]) for r in common.spread_join(left, right, "k", 43).collect())
    assert inner == sorted([("hot", i, "h") for i in range(40)] + [("warm", 1, "w")])
    outer = common.spread_join(left, right, "k", 43, "left").collect()
    assert len(outer) == 43 and {r["v"]: r["x"] for r in outer if r["k"] not in ("hot", "warm")} == {2: None, 3: None}


def test_decontamination_of_empty_tables(spark):
    docs, none = frame(spark, ["a b", None, ""]), spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.judged(decontaminate.contamination(docs, none)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out) == [(0, 2, 0, 0, False), (1, 0, 0, 0, False), (2, 0, 0, 0, False)]
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert [r["text"] for r in decontaminate.remove_spans(docs, none).orderBy("doc_id").collect()] == ["a b", None, ""]


def test_scanning_in_parts(monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["ab", "b", "cd", "é"]) for _ in range(n))
    items = [(str(i), decontaminate.words(text(rng.randint(1, 9)))) for i in range(12)]
    automaton = decontaminate.SuffixAutomaton(items, 4)
    for _ in range(20):
        long = text(200)
        whole = automaton.scan_parts([decontaminate.words(long)])
        for part in (1, 7, 50):
            monkeypatch.setattr(decontaminate, "PART", part)
            assert automaton.scan_parts(decontaminate.word_parts(long)) == whole


def test_multi_match_prefixes_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        a = rng.choice(1000, n, replace=False)
        b = a.copy()
        b[: int(rng.integers(0, n // 9 + 1))] += 5000
        df = {int(t): int(rng.integers(1, 50)) for t in np.union1d(a, b)}
        order = lambda s: sorted(map(int, s), key=lambda t: (df[t], t))
        both = len(set(a.tolist()) & set(b.tolist()))
        if 100 * both < 80 * (2 * n - both):
            continue
        (la, pa), (lb, pb) = (ngram_join.choose_prefix(np.array([df[t] for t in order(s)]), n, 80, 8, 60.0) for s in (a, b))
        assert len(set(order(a)[:pa]) & set(order(b)[:pb])) >= min(la, lb)


def test_components_both_ways(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = {tuple(r) for r in components.components(df).collect() if r[0] != r[1] or True}
    many = {tuple(r) for r in components.components(df, few=0).collect()}
    assert many <= few and {r for r in few if r not in many} <= {(x, x) for x in range(61)}


def test_policy_and_mined_rules(spark):
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://b.org/fr/", "http://x.com/fr/9#t", "http://com/de/", "no scheme", None, "http://", "ftp://q.net/de/1", "http://notexample.org.net/es/"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([(["h:q"], "h:q", 0.9, 0.1)], "tokens array<string>, rarest string, confidence double, support double")
    out = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules).collect()}
    got = [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(len(urls))]
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("b.org", "/fr/", "org/", "allow"), ("x.com", "/fr/9", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("q.net", "/de/1", None, "block"), ("notexample.org.net", "/es/", None, "allow"),
    ]


def test_mined_rules_are_telling_and_not_redundant(spark):
    rows = [(["h:ok", f"p:{i % 7}"], i % 10 == 0) for i in range(200)] + [(["h:spam", f"p:{i % 7}"], i % 10 != 0) for i in range(60)]
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert [r["tokens"] for r in rules if len(r["tokens"]) == 1] == [["h:spam"]]
    assert all("h:ok" not in r["tokens"] for r in rules)
    assert url_filter.mine_rules(spark.createDataFrame([], "tokens array<string>, blocked boolean")).collect() == []


def brute_rules(rows, base, least, confidence, lift):
    """All token sets that pass the limits for the label block, by enumeration."""
    n, out = len(rows), {}
    items = sorted({t for tokens, _ in rows for t in tokens})
    sets = [frozenset(c) for k in (1, 2, 3) for c in itertools.combinations(items, k)]
    for s in sets:
        fit = [b for tokens, b in rows if s <= set(tokens)]
        if sum(fit) >= least:
            out[s] = (sum(fit) / len(fit), len(fit))
    rules = {s: c for s, c in out.items() if c[0] >= confidence}
    bar = (2 * math.log(max(len(rules), 2))) ** 0.5
    good = {s for s, (c, k) in rules.items() if c >= lift * base and (c - base) * (k / (base * (1 - base))) ** 0.5 >= bar}
    return {s for s in good if not any(s - {t} in rules and rules[s - {t}][0] >= rules[s][0] for t in s if len(s) > 1)}


def test_rules_against_enumeration(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = sorted({f"h:{rng.choice('abc')}", f"p:{rng.choice('xyz')}", *rng.sample(["q:u", "q:v"], rng.randint(0, 2))})
        rows.append((tokens, rng.random() < (0.9 if "h:a" in tokens and "p:x" in tokens else 0.5 if "q:u" in tokens else 0.1)))
    got = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_support=0.01, min_rows=4, min_confidence=0.3).collect()
    want = brute_rules(rows, sum(b for _, b in rows) / len(rows), 4, 0.3, url_filter.MIN_LIFT)
    assert {frozenset(r["tokens"]) for r in got} == want and len(want) > 2
    rules = [(frozenset(r["tokens"]), r["confidence"]) for r in got]
    pages = spark.createDataFrame([(t,) for t, _ in rows], "tokens array<string>")
    found = {tuple(r["tokens"]): r["confidence"] for r in url_filter.match_rules(pages, spark.createDataFrame(got)).collect()}
    for t, _ in rows:
        assert found.get(tuple(t)) == max((c for s, c in rules if s <= set(t)), default=None)


def test_rules_of_both_labels_decide(spark):
    rows = [(f"http://a{i % 9}.com/{'bad' if i % 3 == 0 else 'good'}/{i}", i) for i in range(300)]
    pages = spark.createDataFrame([(i, u) for u, i in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for _, i in rows], "doc_id long, quality int, toxic int")
    labelled = url_filter.page_labels(pages, labels, [])
    rules = url_filter.mine_rules(labelled, verdicts=("block", "allow"))
    new = spark.createDataFrame([(1, "http://new.org/bad/900"), (2, "http://new.org/good/901"), (3, "http://new.org/x"), (4, None)], "page_id long, url string")
    out = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in url_filter.filter_urls(new, rules, []).collect()}
    assert out == {1: ("block", "p:bad"), 2: ("allow", "p:good"), 3: ("allow", None), 4: ("allow", None)}
    figures = url_filter.held_out_figures(labelled, F.crc32(F.col("page_id").cast("string")) % 4 == 2).first()
    assert figures["denied"] == figures["hits"] == figures["blocked"] > 0
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_policy_labels_pages_before_documents_do(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/5"), (2, "http://x.net/de/5"), (3, "http://x.net/de/6"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, None), (6, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["blocked"] for r in url_filter.page_labels(pages, labels, url_filter.POLICY).collect()}
    assert got == {1: True, 2: False, 3: True}
