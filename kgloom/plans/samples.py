"""Distributions, matching, presence and coverage, over documents by language and orders by their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, entities, kg, matching, stats
from .reports_f1 import rounded
from .views import view, with_views

WIDTH, SEED = 500, 42
LANGS = ["de", "en", "es", "fr"]
PROPS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def matched(spark, d: str) -> DataFrame:
    return matching.hard_match(view(spark, d, "s"), "lang", "qid", "sitelinks", WIDTH, SEED)


def summary(spark, d: str) -> DataFrame:
    both = matched(spark, d).select("lang", "sitelinks", F.lit("matched").alias("stage")).unionByName(view(spark, d, "s").select("lang", "sitelinks", F.lit("original").alias("stage")))
    return rounded(stats.summarize(both, "sitelinks", "lang", "stage"))


def baskets(spark, d: str) -> DataFrame:
    return view(spark, d, "p").groupBy("entity_id").agg(F.collect_set("p").alias("props"))


def presence(spark, d: str) -> DataFrame:
    p = view(spark, d, "p")
    return kg.presence_matrix(p.select("entity_id"), p.select(F.col("entity_id").alias("s"), "p"), {x: x for x in PROPS})


def cover(spark, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    return coverage.property_coverage(baskets(spark, d), max(1, n // 15), 2, 6)


def grouped_cover(spark, d: str) -> DataFrame:
    held = baskets(spark, d)
    parts = [coverage.property_coverage(held.where(F.col("entity_id").cast("long") % 3 == g), 2, 2, 3).withColumn("lang", F.lit(f"g{g}")) for g in range(3)]
    return rounded(coverage.coverage_table(reduce(DataFrame.unionByName, parts), ["g0", "g1", "g2"], 10, "RO"))


SUMMARY = "count(*) AS n, round(avg(sitelinks), 6) AS mean, round(quantile_cont(sitelinks, 0.5), 6) AS median, round(coalesce(stddev_samp(sitelinks), 0.0), 6) AS std, min(sitelinks) AS min, max(sitelinks) AS max, round(quantile_cont(sitelinks, 0.9), 6) AS p90, round(quantile_cont(sitelinks, 0.95), 6) AS p95, round(quantile_cont(sitelinks, 0.99), 6) AS p99"
BINS = f"{with_views('s')}, h AS (SELECT lang, (floor(sitelinks / {WIDTH}.0) * {WIDTH})::BIGINT AS bin_lo, count(*) AS n FROM s WHERE sitelinks IS NOT NULL GROUP BY ALL), t AS (SELECT bin_lo, min(n) AS target FROM h GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT lang) FROM s WHERE sitelinks IS NOT NULL))"
MATCHED = f"{BINS}, m AS (SELECT lang, qid, sitelinks, bin_lo FROM (SELECT s.*, t.bin_lo, target, row_number() OVER (PARTITION BY lang, t.bin_lo ORDER BY md5('{SEED}|' || qid), qid) AS r FROM s JOIN t ON t.bin_lo = (floor(sitelinks / {WIDTH}.0) * {WIDTH})::BIGINT) WHERE r <= target)"
KS = f"z AS (SELECT lang, count(*) AS n FROM s WHERE sitelinks IS NOT NULL GROUP BY 1), pr AS (SELECT a.lang AS A, b.lang AS B, a.n AS n_a, b.n AS n_b FROM z a JOIN z b ON a.lang < b.lang), g AS (SELECT A, B, n_a, n_b, sitelinks AS x, count(*) FILTER (lang = A) AS ca, count(*) FILTER (lang = B) AS cb FROM pr JOIN s ON lang IN (A, B) WHERE sitelinks IS NOT NULL GROUP BY ALL), ks AS (SELECT A, B, n_a, n_b, max(d) AS D FROM (SELECT A, B, n_a, n_b, abs((sum(ca) OVER w)::DOUBLE / n_a - (sum(cb) OVER w)::DOUBLE / n_b) AS d FROM g WINDOW w AS (PARTITION BY A, B ORDER BY x)) GROUP BY ALL)"
SUBSETS = "subsets AS (SELECT mask, list_filter(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], lambda x, i: (mask >> (i - 1)::INT) & 1 = 1) AS items FROM range(1, 64) r(mask)), held AS (SELECT entity_id, list(p) AS props FROM p GROUP BY 1)"

QUERIES = {
    "sitelink_summary": lambda spark, d: rounded(stats.summarize(view(spark, d, "s"), "sitelinks", "lang")),
    "ecdf": lambda spark, d: rounded(stats.ecdf(view(spark, d, "s"), "lang", "sitelinks")),
    "histogram_density": lambda spark, d: rounded(stats.histogram(view(spark, d, "s"), "lang", "sitelinks", WIDTH), 9),
    "ks_pairwise_d": lambda spark, d: rounded(stats.ks_pairwise(view(spark, d, "s"), "lang", "sitelinks"), 9),
    "ks_pairwise_p": lambda spark, d: rounded(stats.ks_pairwise(view(spark, d, "s"), "lang", "sitelinks", p=True), 7),
    "hard_match_target": lambda spark, d: matching.match_histogram(view(spark, d, "s"), "lang", "sitelinks", WIDTH, LANGS),
    "hard_match_rows": lambda spark, d: matched(spark, d).select("lang", "qid", "sitelinks", "bin_lo"),
    "hard_match_summary": summary,
    "hard_match_violations": lambda spark, d: matching.violations(matched(spark, d), view(spark, d, "s"), "lang", "qid", "sitelinks", WIDTH),
    "presence_matrix": presence,
    "presence_filter": lambda spark, d: entities.present(presence(spark, d), ["has_AF", "has_NO", "has_RF"]),
    "property_coverage": cover,
    "coverage_cross_group": grouped_cover,
}
ORACLES = {
    "sitelink_summary": f"{with_views('s')} SELECT lang, {SUMMARY} FROM s GROUP BY 1",
    "ecdf": f"{with_views('s')}, c AS (SELECT lang, sitelinks AS x, count(*) AS n FROM s WHERE sitelinks IS NOT NULL GROUP BY ALL) SELECT lang, x, n, round((sum(n) OVER (PARTITION BY lang ORDER BY x))::DOUBLE / (sum(n) OVER (PARTITION BY lang))::DOUBLE, 6) AS f FROM c",
    "histogram_density": f"{BINS} SELECT lang, bin_lo, n, round(n / ((sum(n) OVER (PARTITION BY lang))::DOUBLE * {WIDTH}), 9) AS density FROM h",
    "ks_pairwise_d": f"{with_views('s')}, z AS (SELECT lang, count(*) AS n FROM s WHERE sitelinks IS NOT NULL GROUP BY 1), pr AS (SELECT a.lang AS A, b.lang AS B, a.n AS n_a, b.n AS n_b FROM z a JOIN z b ON a.lang < b.lang), g AS (SELECT A, B, n_a, n_b, sitelinks AS x, count(*) FILTER (lang = A) AS ca, count(*) FILTER (lang = B) AS cb FROM pr JOIN s ON lang IN (A, B) WHERE sitelinks IS NOT NULL GROUP BY ALL) SELECT A, B, n_a, n_b, round(max(d), 9) AS KS_D FROM (SELECT A, B, n_a, n_b, abs((sum(ca) OVER w)::DOUBLE / n_a - (sum(cb) OVER w)::DOUBLE / n_b) AS d FROM g WINDOW w AS (PARTITION BY A, B ORDER BY x)) GROUP BY ALL",
    # the exact distribution, diagonal by diagonal over the grid of both samples, as long as a path stays inside the distance
    "ks_pairwise_p": f"{with_views('s').replace('WITH', 'WITH RECURSIVE')}, {KS}, walk(A, B, n, m, D, t, i, p) AS (SELECT A, B, n_a, n_b, D, 0, 0, 1.0::DOUBLE FROM ks UNION ALL SELECT A, B, n, m, D, t, i, sum(p) FROM (SELECT A, B, n, m, D, t + 1 AS t, i, p * (t + 1 - i) / (t + 1) AS p FROM walk UNION ALL SELECT A, B, n, m, D, t + 1, i + 1, p * (i + 1) / (t + 1) FROM walk) WHERE i <= n AND t - i <= m AND abs(i::DOUBLE / n - (t - i)::DOUBLE / m) < D - 1e-10 GROUP BY ALL) SELECT A, B, n_a, n_b, round(ks.D, 7) AS KS_D, round(least(1.0, greatest(0.0, 1 - coalesce(p, 0.0))), 7) AS p_value FROM ks LEFT JOIN (SELECT A, B, p FROM walk WHERE t = n + m) q USING (A, B)",
    "hard_match_target": f"{BINS} SELECT bin_lo, '[' || bin_lo || ', ' || (bin_lo + {WIDTH}) || ')' AS bin_interval, " + ", ".join(f"coalesce(max(n) FILTER (lang = '{x}'), 0) AS {x}" for x in LANGS) + " , target FROM h JOIN t USING (bin_lo) GROUP BY bin_lo, target",
    "hard_match_rows": f"{MATCHED} SELECT lang, qid, sitelinks, bin_lo FROM m",
    "hard_match_summary": f"{MATCHED}, u AS (SELECT lang, 'matched' AS stage, sitelinks FROM m UNION ALL SELECT lang, 'original', sitelinks FROM s) SELECT lang, stage, {SUMMARY} FROM u GROUP BY 1, 2",
    "hard_match_violations": "SELECT unnest(['duplicate', 'histogram', 'negative', 'totals']) AS rule, 0::BIGINT AS n",
    "presence_matrix": f"{with_views('p')} SELECT entity_id, " + ", ".join(f"max((p = '{x}')::INT) AS has_{x}" for x in PROPS) + " FROM p GROUP BY 1",
    "presence_filter": f"{with_views('p')} SELECT entity_id FROM p WHERE p IN ('AF', 'NO', 'RF') GROUP BY 1 HAVING count(*) = 3",
    "property_coverage": f"{with_views('p')}, {SUBSETS} SELECT array_to_string(items, ', ') AS properties, len(items)::INT AS num_properties, count(*) AS coverage, count(*) * len(items) AS score FROM subsets JOIN held ON list_has_all(props, items) WHERE len(items) >= 2 GROUP BY items HAVING count(*) >= greatest(1, (SELECT count(*) // 15 FROM orders))",
    "coverage_cross_group": f"{with_views('p')}, {SUBSETS}, c AS (SELECT items, entity_id::BIGINT % 3 AS g, count(*) AS n FROM subsets JOIN held ON list_has_all(props, items) WHERE len(items) BETWEEN 2 AND 3 AND NOT list_contains(items, 'RO') GROUP BY ALL HAVING count(*) >= 10), w AS (SELECT items, coalesce(max(n) FILTER (g = 0), 0) AS g0, coalesce(max(n) FILTER (g = 1), 0) AS g1, coalesce(max(n) FILTER (g = 2), 0) AS g2 FROM c GROUP BY 1) SELECT array_to_string(items, ', ') AS PropertiesSet, len(items)::INT AS size, g0, g1, g2, round((g0 + g1 + g2) / 3.0, 6) AS Average, round((g0 + g1 + g2) / 3.0 * len(items) * 3, 6) AS Score FROM w WHERE g0 > 0 AND g1 > 0 AND g2 > 0",
}
