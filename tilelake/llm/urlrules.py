"""URL filtering by association rules that FP-growth mines from labels.

A URL is the set of its tokens: scheme, labels of the host, its two last labels together, words of the path, names and
values of the query. The labelled pages are transactions of these tokens and the label; rules say that a set of tokens
implies the label ``block``. They are kept by support, count and confidence, and without those whose antecedent has a
smaller one that is at least as sure. They are matched by an inverted index: a rule is filed under its rarest token,
joined to the pages with that token, and holds if the page has all its tokens.

A rule has at most ``max_tokens`` tokens; FP-growth would list every frequent set, which for n tokens that keep coming
together is 2^n of them. So it gets transactions in pieces: the tokens of one are dealt into groups of ``GROUP``, and each
max_tokens groups are a piece. Any set of at most max_tokens tokens is whole in a piece, so FP-growth proposes it, and no
token is left out of any transaction. A piece's sets come more often than they are, so all counts are made over the whole
transactions afterwards.

Before FP-growth runs, tokens that too few blocked pages have are taken out, as are those that all pages have. Tokens that
the same transactions have are one class while rules are mined. Pages may have one of them without the others, so each
stands for its class when rules are matched.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.shared import saved, written

#: Tokens of a group. Pieces of a transaction have max_tokens groups.
GROUP = 2
#: So many rules at most are broadcast; more are joined in parts, so that a token that most pages have is no hot key.
FEW, SALT = 1 << 14, 64
#: Rules of one token that travel together.
CHUNK = 1000

#: Fixed rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, after the first ``://`` up to ``/``, ``?``, ``#`` or the end; the path from there up to
    ``?``, ``#`` or the end. Both are empty where there is no ``://``."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits the host or one of its superdomains and starts the path, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none for null."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    prefixed = lambda p, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    parts = [
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)))),
        prefixed("host=", labels),
        F.array(F.concat(F.lit("site="), F.array_join(F.slice(F.reverse(labels), 1, 2), "."))),
        prefixed("path=", F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: ~x.rlike("^[0-9]+$"))),
        prefixed("query=", F.split(F.lower(query), "[&;]")),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def _filed(rules: DataFrame) -> DataFrame:
    """(anchor, part, rules) of rules (anchors, ...): those of each anchor in lists of at most about CHUNK."""
    each = rules.withColumn("anchor", F.explode("anchors"))
    n = each.groupBy("anchor").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
    part = each.join(n, "anchor").withColumn("part", F.pmod(F.xxhash64("rule_id"), F.col("n")))
    return part.groupBy("anchor", "part").agg(F.collect_list(F.struct("rule_id", "any_of", "anchors", "confidence")).alias("rules"))


def _matches(sets: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """sets (key, items, ...) with each list of rules (rule_id, any_of, anchors, confidence) one of whose anchors a set has:
    column ``met``, the rules of the list that hold, at least one. A rule holds if the set has a token of each class in
    any_of; it is met under the least of its anchors that the set has, so once. rules should be a written table."""
    spread, filed, on = sets.withColumn("anchor", F.explode("items")), _filed(rules), ["anchor"]
    if rules.count() <= FEW:
        filed = F.broadcast(filed)
    else:
        spread = spread.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))
        filed, on = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["anchor", "salt"]
    holds = lambda r: (F.array_min(F.array_intersect(r["anchors"], F.col("items"))) == F.col("anchor")) & F.forall(r["any_of"], lambda c: F.arrays_overlap(c, F.col("items")))
    return spread.join(filed, on).withColumn("met", F.filter("rules", holds)).where(F.size("met") > 0).drop("rules", "part", *on)


def _pieces(items: Column, max_tokens: int) -> Column:
    """Pieces of a transaction: each max_tokens of its groups of GROUP tokens; fewer groups are one piece."""
    groups = F.ceil(F.size(items) / GROUP).cast("int")
    chosen = F.transform(F.sequence(F.lit(0), groups - 1), lambda k: F.array(k))
    for _ in range(max_tokens - 1):
        chosen = F.flatten(F.transform(chosen, lambda c: F.transform(F.filter(F.sequence(F.lit(0), groups - 1), lambda k: k > F.element_at(c, -1)), lambda k: F.concat(c, F.array(k)))))
    cut = F.transform(chosen, lambda c: F.flatten(F.transform(c, lambda k: F.slice(items, k * GROUP + 1, GROUP))))
    return F.when(groups > max_tokens, cut).otherwise(F.array(items))


def _anchored(sets: DataFrame, count: DataFrame) -> DataFrame:
    """sets (antecedent) with rule_id and the rarest of its tokens as anchor."""
    named = sets.withColumn("rule_id", F.xxhash64("antecedent"))
    rarest = named.select("rule_id", F.explode("antecedent").alias("item")).join(count, "item").groupBy("rule_id").agg(F.min(F.struct("n", "item"))["item"].alias("anchor"))
    return named.join(rarest, "rule_id")


def mine(transactions: DataFrame, *, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 5, max_tokens: int = 4) -> DataFrame:
    """(rule_id, antecedent, any_of, anchors, confidence, support) of the rules from transactions (items array<string>, block
    boolean): at least min_count and min_support of all transactions have the antecedent and are blocked, and these are
    at least min_confidence of those with the antecedent; it has at most max_tokens tokens, and none of its subsets is at
    least as sure. any_of has for each token of the antecedent all tokens of its class, which the same transactions have;
    anchors are those of the rarest. All work is in Spark jobs; the rules stay a table."""
    kept = saved(transactions.groupBy(F.array_sort("items").alias("items"), "block").agg(F.count("*").alias("times")).withColumn("t", F.xxhash64("items")))
    n = kept.agg(F.sum("times")).first()[0] or 0
    empty = kept.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, any_of array<array<string>>, anchors array<string>, confidence double, support double")
    least = max(min_count, min_support * n)
    blocked = F.sum(F.when(F.col("block"), F.col("times")).otherwise(0))
    item = kept.select("t", "times", "block", F.explode("items").alias("item"))
    # tokens of the same transactions: equal counts and equal sums of two hashes of them
    trace = [F.sum(F.xxhash64("t", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    of = item.groupBy("item").agg(F.sum("times").alias("n"), blocked.alias("n_block"), *trace).where((F.col("n_block") >= least) & (F.col("n") < n))
    token = saved(of.groupBy("n", "n_block", "h1", "h2").agg(F.min("item").alias("item"), F.array_sort(F.collect_set("item")).alias("class")).select("item", "n", "class"))
    if token.isEmpty():
        return empty
    short = saved(item.join(token.drop("class"), "item").groupBy("t", "block", "times").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("by")).select("t", "block", "times", F.transform("by", lambda x: x["item"]).alias("items")))
    enough = math.ceil(least)  # more copies of a transaction than this say no more of what is frequent
    copies = F.sequence(F.lit(1), F.least(F.col("times"), F.lit(enough)).cast("int"))
    bad = saved(short.where("block").select(F.explode(_pieces(F.col("items"), max_tokens)).alias("items"), copies.alias("copies")).select("items", F.explode("copies").alias("_")).select("items"))
    grown = FPGrowth(itemsCol="items", minSupport=min(1.0, (enough - 0.5) / max(1, bad.count())), minConfidence=0.0).fit(bad).freqItemsets
    proposed = grown.where(F.size("items") <= max_tokens).select(F.array_sort("items").alias("antecedent")).distinct()
    sets = saved(_anchored(proposed, token.drop("class")).select("rule_id", "antecedent", "anchor", F.array("anchor").alias("anchors"), F.transform("antecedent", lambda x: F.array(x)).alias("any_of"), F.lit(None).cast("double").alias("confidence")))
    counted = _matches(short, "t", sets).select("block", "times", F.explode("met").alias("m")).groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.sum("times").alias("n"), blocked.alias("n_block"))
    sure = counted.where((F.col("n_block") >= least) & (F.col("n_block") >= min_confidence * F.col("n")))
    rules = saved(sets.drop("confidence").join(sure, "rule_id").select("rule_id", "antecedent", "anchor", "anchors", "any_of", (F.col("n_block") / F.col("n")).alias("confidence"), (F.col("n_block") / F.lit(n)).alias("support")))
    # a rule goes if a smaller antecedent is at least as sure
    larger = rules.where(F.size("antecedent") > 1).select(F.col("rule_id").alias("r"), F.col("antecedent").alias("items"), F.col("confidence").alias("own"))
    beaten = _matches(larger, "r", rules).where(F.exists("met", lambda m: (F.size(m["any_of"]) < F.size("items")) & (m["confidence"] >= F.col("own"))))
    best = rules.join(beaten.select(F.col("r").alias("rule_id")).distinct(), "rule_id", "left_anti")
    classes = best.select("rule_id", F.explode("antecedent").alias("item")).join(token.drop("n"), "item").groupBy("rule_id").agg(F.collect_list("class").alias("any_of"))
    first = token.select(F.col("item").alias("anchor"), F.col("class").alias("anchors"))
    return best.drop("any_of", "anchors").join(classes, "rule_id").join(first, "anchor").select("rule_id", "antecedent", "any_of", "anchors", "confidence", "support")


def judge_urls(
    pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 5, max_tokens: int = 4
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_rules, confidence) for each row of pages.

    labels: (page_id, block boolean). verdict is the fixed rule's, else block if a mined rule matches, else allow; n_rules
    and confidence tell of the mined rules that match, whatever the fixed one says. A page with several labels is several
    transactions; null labels and labels of no page are left out. Equal URLs are judged once. A rule needs ``min_count``
    blocked pages, ``min_support`` of the labelled ones and ``min_confidence``, and has at most ``max_tokens`` tokens. A null URL,
    or one without ``://``, has an empty host and path. Repeated page ids and null ids keep their rows. Without labels nothing is mined.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    urls = written(own.select("url").distinct().withColumn("items", tokens(F.col("url"))), "urls")
    known = own.join(labels.where("block is not null").select("page_id", "block"), "page_id").select("url", "block").join(urls, "url").select("items", "block")
    mined = saved(mine(known, min_support=min_support, min_confidence=min_confidence, min_count=min_count, max_tokens=max_tokens))
    hit = _matches(urls.select("url", "items"), "url", mined).select("url", F.size("met").alias("n"), F.array_max(F.transform("met", lambda m: m["confidence"])).alias("c"))
    met = hit.groupBy("url").agg(F.sum("n").alias("n_rules"), F.max("c").alias("confidence"))
    host, path = host_and_path(F.col("url"))
    got = own.join(met, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "confidence")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return got.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"), "n_rules", F.round("confidence", 6).alias("confidence"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of documents stand for those of the pages with the same number: low quality or toxic is blocked."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
