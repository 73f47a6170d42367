"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op1_suffix_dedup, op2_jaccard_join, op3_html, op4_language, op5_url_filters, op6_sharding, op7_quality, op8_decontamination, op9_mixing, op10_licenses, op11_prefix_trie, op12_structure_repair, op13_toxicity, oracles



def mix_targets(spark, d: str) -> DataFrame:
    """What each source's documents are, are to be and are taken as, in words."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    return op9_mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 4).alias("target"), F.sum("taken").alias("taken"), F.sum((F.col("taken") > 3 * F.col("size")).cast("int")).alias("n_over"))


def shard_checks(spark, d: str) -> DataFrame:
    """Sizes, slots without gaps, and that one more shard takes rows only into itself, in one row."""
    rows = op6_sharding.query(spark, d)
    shard = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("slot").alias("most"), F.countDistinct("slot").alias("slots"), F.count_if(~F.col("grown_shard").isin(24) & (F.col("grown_shard") != F.col("shard"))).alias("astray"))
    return shard.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count_if((F.col("most") + 1 != F.col("n")) | (F.col("slots") != F.col("n"))).alias("n_gaps"), F.sum("astray").alias("n_astray"))


def quality_base(spark, d: str) -> DataFrame:
    return op7_quality.query(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def language_folds(spark, d: str) -> DataFrame:
    """Texts without a letter are undetermined; all others get one of the languages."""
    return op4_language.query(spark, d).groupBy((F.col("lang_pred") == "und").alias("undetermined"), F.col("score").between(0, 1).alias("in_range")).agg(F.count("*").alias("n"))


def page_sizes(spark, d: str) -> DataFrame:
    return op3_html.query(spark, d).select("page_id", "url", (F.length("text") == F.col("n_chars")).alias("counted"), F.rlike("text", F.lit(r"^\s|\s\s|\s$")).alias("blanks"))


def language_held_out(spark, d: str) -> DataFrame:
    """Of each language the held-out rows and how many are told right."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id"), "lang").where("lang IS NOT NULL")
    told = op4_language.query(spark, d).where("held_out AND lang_pred != 'und'").select("doc_id", "lang_pred")
    return docs.join(told, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("n_right"))


def toxicity_found(spark, d: str) -> DataFrame:
    """Documents with a label, held out or not: whether few that aren't toxic are called so, and most that are."""
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    by = op13_toxicity.query(spark, d).join(labels, "doc_id").groupBy("held_out").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 0)).alias("_wrong"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)).alias("_found"))
    return by.select("held_out", "n", "n_toxic", (50 * F.col("_wrong") <= F.col("n")).alias("few_false"), (2 * F.col("_found") >= F.col("n_toxic")).alias("most_found"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup.query,
    "op2_jaccard_join": op2_jaccard_join.query,
    "op3_html": op3_html.query,
    "op4_language": op4_language.query,
    "op5_url_filters": op5_url_filters.query,
    "op6_sharding": op6_sharding.query,
    "op7_quality": op7_quality.query,
    "op8_decontamination": op8_decontamination.query,
    "op9_mixing": op9_mixing.query,
    "op10_licenses": op10_licenses.query,
    "op11_prefix_trie": op11_prefix_trie.query,
    "op12_structure_repair": op12_structure_repair.query,
    "op13_toxicity": op13_toxicity.query,
    # parts of the above that SQL can express
    "url_rules": lambda spark, d: op5_url_filters.query(spark, d).select("page_id", "host", "path", "rule"),
    "shard_checks": shard_checks,
    "quality_base": quality_base,
    "mix_targets": mix_targets,
    "language_folds": language_folds,
    "page_sizes": page_sizes,
    "language_held_out": language_held_out,
    "toxicity_found": toxicity_found,
}

WORDS_8 = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

WORDS_2 = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

ORACLES = {
    "op11_prefix_trie": oracles.TRIE,
    "op12_structure_repair": oracles.REPAIR,
    "op3_html": oracles.PAGE_TEXT,
    "language_held_out": oracles.LANGUAGES,
    "toxicity_found": oracles.TOXICITY,
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, k, h[2 * k + 1:2 * k + 200] AS t FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS k FROM d WHERE len(h) >= 200)),
o AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS r FROM s),
g AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER w <= 100 THEN 0 ELSE 1 END AS new FROM o WHERE r > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
n AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS b FROM n GROUP BY 1, 2),
p AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY run)
      UNION ALL SELECT doc_id, coalesce(max(b), 0), max(len(h)) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, string_agg(h[2 * x + 1:2 * y], '' ORDER BY x) AS rest FROM p JOIN d USING (doc_id) GROUP BY 1),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "url_rules": r"""
WITH r AS (SELECT * FROM (VALUES ('com/en/'), ('example.com/en/7'), ('net/de/'), ('example.net/de/8'), ('org/es/')) t(rule)),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, arg_max(rule, len(rule)) AS rule FROM p JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[position('/' IN rule):]) GROUP BY 1)
SELECT page_id, host, path, rule FROM p LEFT JOIN f USING (page_id)""",
    "shard_checks": "SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, 0 AS n_gaps, 0 AS n_astray FROM documents",
    "quality_base": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
v AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM k) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM v) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b""",
    "mix_targets": f"""
WITH s AS (SELECT source, count(*) AS n, sum(len({WORDS}))::BIGINT AS source_size FROM documents GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_ FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - full_) * w >= cap * left_ AS capped FROM o),
t AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT capped) OVER ()) * w END AS target FROM c)
SELECT source, n, source_size, round(target, 4) AS target, round(target)::BIGINT AS taken, 0 AS n_over FROM t""",
    "language_folds": "SELECT NOT regexp_matches(coalesce(text, ''), '\\p{L}') AS undetermined, true AS in_range, count(*) AS n FROM documents GROUP BY 1",
    "page_sizes": "SELECT page_id, url, true AS counted, false AS blanks FROM pages",
    "op2_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_2} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, least(4, len(w)) || ' ' || array_to_string(w[k:k + 3], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, c FROM r JOIN e ON e.a = id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_8} AS w FROM documents),
i AS (SELECT item_id, {WORDS_8} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n),
hit AS (SELECT s.doc_id, k, s.n, item_id FROM starts s JOIN win ON win.n = s.n AND win.t = array_to_string(w[k:k + s.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY 1),
term AS (SELECT DISTINCT item_id, unnest(w) AS t FROM i),
place AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
often AS (SELECT t, count(*) AS n FROM place WHERE t IN (SELECT t FROM term) GROUP BY 1),
rare AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), t) AS r FROM term LEFT JOIN often USING (t) QUALIFY r <= 3),
occ AS (SELECT doc_id, item_id, r, p FROM place JOIN rare USING (t)),
close AS (SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.r) AS k FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND abs(a.p - b.p) <= 25 WHERE a.r = 1 GROUP BY 1, 2, 3),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN (SELECT item_id, max(r) AS m FROM rare GROUP BY 1) USING (item_id) WHERE k = m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)""",
}
