"""URL filters: given rules first; else association rules that FP-growth mines from labelled URLs.

Only DataFrame operations and Spark's FP-growth. Rules ``tokens -> block`` are mined from the blocked URLs alone, as
most labels are allow: token combinations with enough support among them, then their confidence, the share of blocked ones among
all labelled URLs that hold the combination, by the same inverted index that matches URLs. Rules with a shorter rule
inside are pruned, as they block nothing more.

A null URL, or one without ``://``, has empty host and path, no rule and the verdict allow. Fewer than ``min_rows``
blocked URLs, or none labelled, give no mined rules: the verdict is then allow. A page with several labels counts as blocked if one of them says so.
Ties of confidence don't matter, as all mined rules block. Repeated rows are each judged; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few

#: rule -> verdict; a rule is a host (with its subdomains) and the beginning of a path.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weak labels of the query: words of hosts that name spam, as blocklists do; one URL in LABELLED is labelled.
SPAM_WORDS = ("adult", "ads", "bet", "bets", "casino", "farm", "free", "loan", "loans", "pills", "porn", "sex", "spam", "viagra")
LABELLED = 2
#: Tokens of a rule at most, and rules that may be broadcast.
MAX_TOKENS, MAX_BROADCAST_ROWS = 3, 100_000


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, as a struct (n, rule, verdict), or null."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    of = F.array(*(F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("h"), F.lit("/" + r.partition("/")[2]).alias("p")) for r, v in rules.items()))
    fits = F.filter(of, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def tokens(host: Column, path: Column) -> Column:
    """Host labels and path words, told apart; numbers in a path are one token."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, r"[^A-Za-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"^\d+$", "#")))
    return F.array_distinct(F.concat(labels, parts))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 3) -> DataFrame:
    """labelled (tokens, block boolean) -> rules (rule_id, antecedent, confidence, support) for block.

    Support is the share of blocked URLs; a rule also needs min_rows of them, so that a few chance ones don't make one.
    """
    labelled = cut(labelled.select("tokens", "block"))
    blocked = labelled.where("block").select("tokens")
    n = blocked.count()
    none = labelled.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double")
    if n < max(1, min_rows):
        return none
    items = FPGrowth(itemsCol="tokens", minSupport=min(1.0, max(min_support, min_rows / n))).fit(blocked).freqItemsets
    some = cut(items.where(F.size("items") <= MAX_TOKENS).select(F.xxhash64(F.array_sort("items")).alias("rule_id"), F.col("items").alias("antecedent"), F.col("freq").alias("_block")))
    # each different set of tokens is matched once
    sets = labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count_if(~F.col("block")).alias("_n")).where("_n > 0")
    allowed = hits(sets.select("tokens", "_n"), some).groupBy("rule_id").agg(F.sum("_n").alias("_allow"))
    sure = some.join(allowed, "rule_id", "left").withColumn("confidence", F.col("_block") / (F.col("_block") + F.coalesce("_allow", F.lit(0))))
    sure = cut(sure.where(F.col("confidence") >= min_confidence).select("rule_id", "antecedent", "confidence", (F.col("_block") / n).alias("support")))
    inside = hits(sure.select(F.col("antecedent").alias("tokens"), F.col("rule_id").alias("_longer")), sure).where("rule_id != _longer").select(F.col("_longer").alias("rule_id")).distinct()
    return sure.join(inside, "rule_id", "left_anti")


def hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (tokens, ...) -> without tokens, with the rule_id of each rule all of whose tokens they hold, by an inverted index.

    A rule is posted under one of its tokens, that of the fewest rules, and the rest of it compared.
    """
    each = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("_t"))
    load = each.groupBy("_t").agg(F.count("*").alias("_k"))
    index = each.join(load, "_t").groupBy("rule_id").agg(F.first("antecedent").alias("_all"), F.min(F.struct("_k", "_t")).alias("_post")).select("rule_id", "_all", F.col("_post._t").alias("_t"))
    found = urls.withColumn("_t", F.explode("tokens")).join(few(index, MAX_BROADCAST_ROWS), "_t").where(F.size(F.array_except("_all", "tokens")) == 0)
    return found.drop("_t", "_all", "tokens")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens) -> (url, confidence): those that hold all tokens of a rule, with the surest rule."""
    return hits(urls, rules.select("rule_id", "antecedent")).join(few(rules.select("rule_id", "confidence"), MAX_BROADCAST_ROWS), "rule_id").groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 3) -> DataFrame:
    """pages (page_id, url), labels (page_id, block boolean) -> page_id, host, path, rule, verdict, confidence."""
    of = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = labels.where("block is not null").groupBy(F.col("page_id").alias("_id")).agg(F.max("block").alias("block"))
    learnt = cut(mine(of.join(known, F.col("page_id") == F.col("_id")).select(tokens(F.col("host"), F.col("path")).alias("tokens"), "block"), min_support, min_confidence, min_rows))
    one = of.select("url", "host", "path").distinct().select("url", tokens(F.col("host"), F.col("path")).alias("tokens"))
    sure = matches(one, learnt).withColumnRenamed("url", "_url")
    got = of.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).join(sure, F.col("url") == F.col("_url"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return got.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def weak_labels(pages: DataFrame, rules: dict[str, str] = RULES, one_in: int = LABELLED) -> DataFrame:
    """pages (page_id, url) -> (page_id, block): labels of hosts, for one in ``one_in`` of the URLs that no given rule judges, by hash.

    Blocked are hosts with a word of SPAM_WORDS; the others are allowed, as all URLs are unless something speaks against
    them. What a given rule judges isn't learnt from, as rules would be restated without the place where the path must begin. The URLs without a label are held
    out: mined rules judge them by what they share with labelled ones.
    """
    h = host(F.col("url"))
    open_ = rule(h, path(F.col("url")), rules).isNull() & (h != "")
    return pages.where(open_ & (F.pmod(F.xxhash64("url"), F.lit(one_in)) == 0)).select("page_id", spammy(h).alias("block"))


def spammy(host: Column) -> Column:
    """Whether a host has a word of SPAM_WORDS."""
    return F.coalesce(F.arrays_overlap(F.split(host, r"[^a-z0-9]+"), F.array(*map(F.lit, SPAM_WORDS))), F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, weak_labels(pages))
