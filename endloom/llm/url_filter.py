"""URL filtering: policy rules first, then mined association rules (DataFrame operations and
Spark's own FP-growth only).

URLs become sets of tokens (scheme, host labels, path segments with digits folded, file
extension, names of query parameters). FP-growth mines the token combinations that come
with a label, ``block`` or ``allow``, among labelled pages. Rules are pruned by support, by
confidence against the label's base rate (they must lift it, by more than chance among so
many rules would) and by redundancy (a rule goes if a part of it is at least as confident).
Each rule is posted under its rarest token in an inverted index; a distinct token set
fetches the rules of its tokens, keeps those it holds whole, and the most confident one
decides.

A page is labelled by the policy where a policy rule fits, else by the document that it
shows, where that document has labels.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: What the items that stand for labels begin with; no token has this form.
LABEL = "label="
MIN_SUPPORT = 0.004
MIN_CONFIDENCE = 0.8
#: The least ratio of a rule's confidence to its label's base rate.
MIN_LIFT = 1.1
#: No rule is kept that fewer labelled pages bear out.
MIN_ROWS = 20

# The policy of the registered query, as (host, path, verdict).
POLICY = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; '' for null or no ://."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The sorted set of a URL's tokens; empty for null."""
    host, path = host_of(url), path_of(url)
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), fold(x)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), fold(x)))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1))))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    some = F.array(F.when(scheme != "", F.concat(F.lit("s:"), F.lower(scheme))), F.when(extension != "", F.concat(F.lit("x:"), extension)), F.when(F.instr(url, "#") > 0, F.lit("f:")))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.concat(labels, segments, names, some)))), F.expr("CAST(array() AS array<string>)"))


def policy_rule(host: Column, path: Column, policy: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. The policy is a list
    in the program and so of bounded size."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(policy, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


_NO_RULES = "tokens array<string>, rarest string, verdict string, confidence double, support double"


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS, min_lift: float = MIN_LIFT, verdicts: tuple[str, ...] = ("block",)) -> DataFrame:
    """labelled: tokens array<string> (distinct), blocked boolean. Result: tokens (sorted),
    rarest, verdict, confidence, support. Rows without tokens or label are left out; no
    labelled rows, or none of a label, give no rules for it. Runs jobs.

    A rule that n pages fit beats chance if its confidence is over the base rate by
    sqrt(2 ln(rules)) standard deviations of a share of n pages."""
    known = labelled.where("tokens IS NOT NULL AND blocked IS NOT NULL")
    verdict = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    transactions = cut(known.select(F.array_append("tokens", F.concat(F.lit(LABEL), verdict)).alias("items"), verdict.alias("verdict")))
    shares = {r["verdict"]: r["n"] for r in transactions.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(shares.values())
    if len(shares) < 2:
        return labelled.sparkSession.createDataFrame([], _NO_RULES)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), minConfidence=min_confidence).fit(transactions.select("items"))
    wanted = F.array(*[F.lit(LABEL + v) for v in verdicts])
    rules = cut(model.associationRules.where(F.arrays_overlap("consequent", wanted)).select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 9).alias("verdict"), "confidence", "support"))
    base = F.when(F.col("verdict") == "block", F.lit(shares["block"] / n)).otherwise(F.lit(shares["allow"] / n))
    fits = F.col("support") * n / F.col("confidence")
    above = (F.col("confidence") - base) * F.sqrt(fits / (base * (1 - base)))
    telling = rules.where((F.col("confidence") >= min_lift * base) & (above >= F.lit(2 * math.log(max(rules.count(), 2))) ** 0.5))
    # A rule is redundant if one of its parts, a token fewer, is at least as confident. Each
    # part of a frequent set is frequent, so chains of single steps find all of them.
    parts = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("without")).select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("without")).alias("part"))
    redundant = parts.join(rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c")), ["part", "verdict"]).where("c >= confidence").select("tokens", "verdict").distinct()
    kept = telling.join(redundant, ["tokens", "verdict"], "left_anti")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    posted = kept.select("tokens", "verdict", "confidence", "support", F.explode("tokens").alias("token")).join(counts, "token")
    return cut(posted.groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest")).select("tokens", "rarest", "verdict", "confidence", "support"))


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct token sets that hold a rule, with the most confident one (ties: the
    higher support, then the first in order): tokens, mined_rule, mined_verdict, confidence.
    Rules without a verdict block."""
    sets = token_sets.select("tokens").distinct()
    verdict = F.col("verdict") if "verdict" in rules.columns else F.lit("block")
    index = rules.select(F.col("rarest").alias("token"), F.col("tokens").alias("rule"), verdict.alias("mined_verdict"), "confidence", "support")
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0)
    name = F.array_join("rule", " & ")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), name.alias("name"), "mined_verdict"))
    return found.groupBy("tokens").agg(best.alias("b")).select("tokens", F.col("b.name").alias("mined_rule"), "b.mined_verdict", (-F.col("b.c")).alias("confidence"))


def page_labels(pages: DataFrame, labels: DataFrame, policy: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """tokens, blocked (and the columns of pages) for the pages that have a label. Where a
    rule of policy fits, its verdict is the label. Else a page shows the document whose number
    is in its path, and counts as blocked if that document is of low quality or toxic.
    Documents with several labels count as blocked if one says so."""
    url = F.col("url").cast("string")
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)")
    own = pages.withColumns({"tokens": url_tokens(url), "__doc": number, "__policy": policy_rule(host_of(url), path_of(url), policy or [])["verdict"]})
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("__bad"))
    asked = own.where("__doc IS NOT NULL").groupBy("__doc").agg(F.count(F.lit(1)).alias("n_left"))
    found = spread_join(own.where("__doc IS NOT NULL"), asked.join(judged, "__doc"), "__doc", pages.count(), "left")
    both = found.unionByName(own.where("__doc IS NULL").withColumn("__bad", F.lit(None).cast("int")))
    blocked = F.when(F.col("__policy").isNotNull(), F.col("__policy") == "block").otherwise(F.col("__bad") == 1)
    return both.withColumn("blocked", blocked).where("blocked IS NOT NULL").drop("__doc", "__policy", "__bad")


def filter_urls(pages: DataFrame, rules: DataFrame, policy: list[tuple[str, str, str]] = POLICY) -> DataFrame:
    """pages with host, path, rule, verdict, mined_rule and confidence added.

    One row for every input row; columns of these names in pages are replaced, others stay.
    Null URLs have empty host and path and no rule, and are allowed. The policy's longest
    fitting rule decides; else the most confident mined rule; else a page is allowed. Mined
    rules are matched once for each distinct token set; a set that many pages share meets
    them without a shuffle. An empty table gives an empty frame.
    """
    url = F.col("url").cast("string")
    out = pages.withColumn("__tokens", url_tokens(url)).withColumn("host", host_of(url)).withColumn("path", path_of(url))
    sets = out.groupBy(F.col("__tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("n_left"))
    hits = match_rules(sets, rules).join(sets, "tokens")
    hits = cut(hits.select(F.col("tokens").alias("__tokens"), F.col("mined_rule").alias("__rule"), F.col("mined_verdict").alias("__verdict"), F.col("confidence").alias("__confidence"), "n_left"))
    out = spread_join(out, hits, "__tokens", pages.count(), "left").withColumn("__policy", policy_rule(F.col("host"), F.col("path"), policy))
    return (
        out.withColumns({"rule": F.col("__policy.rule"), "verdict": F.coalesce("__policy.verdict", "__verdict", F.lit("allow")), "mined_rule": F.col("__rule"), "confidence": F.col("__confidence")})
        .drop("__tokens", "__policy", "__rule", "__verdict", "__confidence")
    )


def held_out_figures(labelled: DataFrame, held_out: Column, **limits) -> DataFrame:
    """One row about rules mined from the labelled pages that are not held out, judged on
    those that are: pages, blocked (by label), decided (a mined rule fits), denied (a mined
    rule blocks), hits (denied and blocked by label). Precision is hits / denied, recall
    hits / blocked."""
    marked = cut(labelled.select("tokens", "blocked", held_out.alias("held")))
    rules = mine_rules(marked.where("NOT held"), **limits)
    rest = marked.where("held")
    seen = rest.join(match_rules(rest, rules), "tokens", "left")
    denies = F.coalesce(F.col("mined_verdict") == "block", F.lit(False))
    return seen.agg(F.count(F.lit(1)).alias("pages"), F.count_if("blocked").alias("blocked"), F.count("mined_rule").alias("decided"), F.count_if(denies).alias("denied"), F.count_if(denies & F.col("blocked")).alias("hits"))
