"""Graders, translation, text rules and failure analysis over answers made of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions import text
from ..operators import failure, grading, kg, scorers, translate
from .graph import vocab
from .reports_f1 import rounded
from .views import view, with_views


def dob(spark, d: str) -> DataFrame:
    return grading.grade_dob(view(spark, d, "b"))


def tagged(spark, d: str) -> DataFrame:
    return failure.tagged(dob(spark, d))


def countries(spark, d: str) -> DataFrame:
    answers = view(spark, d, "a").withColumn("llm_output_en", F.col("llm_output"))
    of = kg.entity_vocabulary(kg.citizenship(view(spark, d, "t")), vocab(spark, d))
    return grading.grade_country(answers, of, view(spark, d, "v"))


def places(spark, d: str) -> DataFrame:
    table = view(spark, d, "pl").select("name_key", "q", F.array("country").alias("countries"))
    return grading.grade_place(view(spark, d, "pa"), table, view(spark, d, "v"))


def resumed(spark, d: str) -> DataFrame:
    b = view(spark, d, "b").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("Q_number"), F.lit("en").alias("LoQ"), F.lit("en").alias("LoE"), "gt", "llm_output")
    previous = grading.grade_dob(b.where(F.pmod(F.hash("Q_number"), F.lit(3)) == 0))
    return grading.resume(b, previous, grading.grade_dob).select("Q_number", "eval", "eval_type")


def texts(spark, d: str) -> DataFrame:
    return view(spark, d, "x")


def pairs(spark, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    a, b = text.casefold("p_name"), text.casefold(F.regexp_replace("p_name", r"^\S+ ", ""))
    return p.select("p_partkey", text.similar(a, b).alias("similar"), text.similar(a, text.casefold("p_brand")).alias("brand"))


def overlap(spark, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("gt"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("llm_output"))
    return rounded(scorers.score(p, "overlap").drop("METEOR_ordered"))


def vectors(spark, d: str, weighted: bool) -> DataFrame:
    """Embeddings as token vectors: of ten in a row five are the truth and five, in part the same tokens, the output."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 10").alias("key"), (F.col("vec_id") % 5).alias("pos"), (F.col("vec_id") % 10 < 5).alias("_t"), F.concat(F.lit("l"), "label").alias("token"), F.col("embedding").alias("vector"))
    return rounded(scorers.bert_score(e.where("_t").drop("_t"), e.where("NOT _t").drop("_t"), weighted))


def judge_prompts(spark, d: str) -> DataFrame:
    """What a judge is asked on answers about countries, with up to SHOWN of many names."""
    c = view(spark, d, "a").select("Q_number", "llm_output", "gt")
    n = F.regexp_replace("Q_number", "c", "").cast("int")
    names = lambda word: F.transform(F.sequence(F.lit(1), 1 + n % 30), lambda i: F.concat(F.lit(word), i))
    return c.select("Q_number", providers.asked_of_judge("country", output=F.col("llm_output"), truth=F.col("gt"), demonyms=names("d"), aliases=names("a{")).alias("asked"))


class Doubles:
    """A provider that knows every second text."""

    def translate(self, misses: DataFrame) -> DataFrame:
        return misses.withColumn("en", F.when(F.length("text") % 2 == 0, F.concat(F.lit("en "), "text")))


def translated_table(spark, d: str) -> DataFrame:
    """The table of translations with what a provider has added, each row at a place of its own."""
    return translate.translate(view(spark, d, "a"), view(spark, d, "tr"), Doubles())[1]


def meteor_words(spark, d: str) -> DataFrame:
    """METEOR by words, of texts in which each word stands once."""
    words = lambda *c: F.array_distinct(F.filter(F.split(F.concat_ws(" ", *c), " "), lambda w: w != ""))
    p = spark.read.parquet(f"{d}/part.parquet")
    p = p.select("p_partkey", F.array_join(words("p_name", "p_type"), " ").alias("gt"), F.array_join(F.concat(F.slice(words("p_type", "p_name"), 2, 99), F.slice(words("p_type", "p_name"), 1, 1)), " ").alias("llm_output"))
    return rounded(scorers.score(p, "meteor", stages=("exact",)))


QUERIES = {
    "meteor_words": meteor_words,
    "bert_score_vectors": lambda spark, d: vectors(spark, d, False),
    "bert_score_weighted": lambda spark, d: vectors(spark, d, True),
    "judge_prompts": judge_prompts,
    "translate_table": translated_table,
    "dob_grade": lambda spark, d: dob(spark, d).select("l_orderkey", "l_linenumber", "eval", "eval_type", "eval_score"),
    "dob_summary": lambda spark, d: rounded(grading.summary(dob(spark, d), "model")),
    "dob_weighted_avg": lambda spark, d: rounded(dob(spark, d).groupBy("model").agg(F.avg("eval_score").alias("mean_score"), F.avg((F.col("eval") == "TP").cast("int")).alias("hit_share"))),
    "dob_failure_modes": lambda spark, d: failure.modes(tagged(spark, d)),
    "dob_format_compliance": lambda spark, d: failure.format_compliance(tagged(spark, d)),
    "dob_year_error_buckets": lambda spark, d: rounded(failure.year_buckets(tagged(spark, d))),
    "dob_score_distribution": lambda spark, d: rounded(failure.score_distribution(dob(spark, d))),
    "dob_model_summary": lambda spark, d: rounded(failure.by_model(tagged(spark, d))),
    "casefold_text": lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.casefold("text")).alias("folded_md5")),
    "normalize_candidates": lambda spark, d: texts(spark, d).select("p_partkey", F.array_join(text.candidates("raw"), "|").alias("candidates")),
    "clean_place": lambda spark, d: texts(spark, d).select("p_partkey", text.clean_place("raw").alias("place")),
    "parse_gt_list": lambda spark, d: texts(spark, d).select("p_partkey", F.array_join(text.parse_list("raw"), "|").alias("truths")),
    "split_list": lambda spark, d: texts(spark, d).select("p_partkey", F.array_join(text.split_list("raw"), "|").alias("items")),
    "empty_answers": lambda spark, d: view(spark, d, "a").select("Q_number", text.is_empty("llm_output").alias("empty_name"), text.is_empty("llm_output", text.EMPTY_WORD).alias("empty_word")),
    "substring_pairs": pairs,
    "translate_lookup": lambda spark, d: translate.lookup(view(spark, d, "a"), view(spark, d, "tr")).select("Q_number", "LoQ", "llm_output", "llm_output_en"),
    "translate_misses": lambda spark, d: translate.misses(translate.lookup(view(spark, d, "a"), view(spark, d, "tr"))),
    "resume_anti_join": resumed,
    "country_grade": lambda spark, d: countries(spark, d).select("Q_number", "eval", "eval_type", "provenance"),
    "country_summary": lambda spark, d: grading.summary(countries(spark, d), "LoQ"),
    "place_grade": lambda spark, d: places(spark, d).select("Q_number", "eval", "eval_type", "provenance"),
    "verdict_fallback": lambda spark, d: grading.open_questions(countries(spark, d), view(spark, d, "v")),
    "bleu_rouge": overlap,
    "cider": lambda spark, d: rounded(scorers.cider(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("gt"), F.concat_ws(" ", "p_name", "p_type").alias("llm_output")), "p_partkey")),
}

DOB = f"""{with_views('b')}, pg AS (SELECT *, regexp_extract(gt, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})T', ['y', 'm', 'd']) AS g, trim(llm_output) AS o1 FROM b),
po AS (SELECT *, regexp_extract(o1, '(\\d{{4}})-(\\d{{2}})-(\\d{{2}})', ['y', 'm', 'd']) AS o FROM pg),
k AS (SELECT *, CASE WHEN o1 = '' OR upper(o1) = 'NONE' THEN 'empty' WHEN g.y = '' OR o.y = '' THEN 'no_match' WHEN g = o THEN 'exact_match'
 WHEN g.y = o.y AND g.m = o.d AND g.d = o.m AND o.d <= '12' AND o.m <= '31' THEN 'swap_match' WHEN g.y = o.y AND g.m = o.m THEN 'year_month_match'
 WHEN g.y = o.y AND g.m = o.d AND o.d <= '12' THEN 'year_month_swap_match' WHEN g.y = o.y THEN 'year_match' ELSE 'no_match' END AS eval_type FROM po),
dob AS (SELECT *, CASE WHEN eval_type = 'empty' THEN 'FN' WHEN eval_type IN ('year_match', 'no_match') THEN 'FP' ELSE 'TP' END AS eval,
 CASE WHEN eval_type IN ('exact_match', 'swap_match') THEN 1.0 WHEN eval_type LIKE 'year_month%' THEN 0.7 WHEN eval_type = 'year_match' THEN 0.5 ELSE 0.0 END::DOUBLE AS eval_score,
 regexp_full_match(llm_output, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS ok, try_cast(regexp_extract(llm_output, '^(\\d{{4}})', 1) AS INT) - try_cast(substr(gt, 1, 4) AS INT) AS diff FROM k)"""
WRONG = "SELECT abs(diff) AS y FROM dob WHERE eval_type = 'no_match' AND ok AND diff IS NOT NULL"
CAND = f"""{with_views('x')}, s1 AS (SELECT p_partkey, raw, trim(regexp_replace(regexp_replace(trim(raw), '^\\[?\\s*[''"]?', ''), '[''"]?\\s*\\]?$', '')) AS t FROM x),
s2 AS (SELECT p_partkey, raw, trim(regexp_replace(t, '\\s*\\([^)]*\\)\\s*$', '')) AS t FROM s1), s3 AS (SELECT p_partkey, raw, CASE WHEN contains(t, ' - ') THEN trim(regexp_replace(CASE WHEN len(trim(t[1:position(' - ' IN t) - 1])) > len(trim(t[position(' - ' IN t) + 3:])) THEN trim(t[position(' - ' IN t) + 3:]) ELSE t END, '\\s*\\[.*?\\]\\s*$', '')) ELSE t END AS t FROM s2)"""
TABLE = f"{with_views('a', 'tr')}, ex AS (SELECT loq, text, arg_min(en, pos) AS en FROM tr GROUP BY 1, 2), an AS (SELECT text, arg_min(en, pos) AS en FROM tr GROUP BY 1), it AS (SELECT DISTINCT llm_output, trim(trim(llm_output[2:-2]), '''\"') AS item FROM a WHERE llm_output LIKE '[%]' AND NOT contains(llm_output, ',')), li AS (SELECT llm_output, CASE WHEN v LIKE '[\"%\"]' THEN v ELSE '[\"' || v || '\"]' END AS en FROM (SELECT it.llm_output, coalesce(b.en, w.en) AS v FROM it LEFT JOIN an b ON b.text = item LEFT JOIN an w ON w.text = '[' || item || ']' WHERE item <> '') WHERE v IS NOT NULL), lk AS (SELECT a.*, CASE WHEN trim(a.llm_output) = '' OR upper(trim(a.llm_output)) = 'NONE' THEN 'NONE' WHEN a.LoQ = 'en' THEN a.llm_output ELSE coalesce(ex.en, an.en, li.en) END AS llm_output_en FROM a LEFT JOIN ex ON ex.loq = a.LoQ AND ex.text = a.llm_output LEFT JOIN an ON an.text = a.llm_output LEFT JOIN li ON li.llm_output = a.llm_output)"
COUNTRY = f"""{with_views('a', 'v')}, n AS (SELECT Q_number, LoQ, llm_output AS o, gt, lower(gt[3:-3]) AS g, CASE WHEN nk % 2 = 0 THEN lower(gt[3:-3]) || 'ese' END AS dem FROM a JOIN (SELECT 'c' || c_custkey AS q, c_nationkey AS nk FROM customer) z ON q = Q_number),
c AS (SELECT *, list_filter(list_transform(string_split(trim(o, '[]'''), ','), lambda y: lower(trim(y))), lambda y: y <> '') AS cs FROM n),
m AS (SELECT c.*, match_type, CASE WHEN o IN ('N/A', '['''']', '') THEN '' WHEN list_contains(cs, g) THEN 'exact_match' WHEN list_contains(cs, 'land ' || g) THEN 'alias_match'
 WHEN len(list_filter(cs, lambda y: len(y) >= 4 AND len(g) >= 4 AND (contains(y, g) OR contains(g, y)))) > 0 THEN 'substring_match' WHEN dem IS NOT NULL AND list_contains(cs, dem) THEN 'demonym_match' END AS r FROM c LEFT JOIN v ON v.llm_output = o AND v.gt_raw = gt),
cg AS (SELECT Q_number, LoQ, o, gt, coalesce(r, CASE WHEN match_type IN ('exact_match', 'alias_match', 'substring_match', 'demonym_match', 'historical_match', 'no_match') THEN match_type ELSE 'no_match' END) AS eval_type, CASE WHEN r = '' THEN '' WHEN r IS NOT NULL THEN 'auto' ELSE 'judge' END AS provenance FROM m),
cf AS (SELECT *, CASE WHEN eval_type = '' THEN 'FN' WHEN eval_type = 'no_match' THEN 'FP' ELSE 'TP' END AS eval FROM cg)"""
FOLD = r"regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PLACE = f"""{with_views('pa', 'pl')}, c AS (SELECT Q_number, llm_output_en AS o, gt[3:-3] AS g, trim(rtrim(trim(split_part(regexp_replace(trim(regexp_replace(llm_output_en, '[''"\\[\\]]+', '', 'g')), '\\s*\\([^)]*\\)\\s*$', ''), ',', 1)), '.')) AS t FROM pa),
f AS (SELECT *, {FOLD.format('t')} AS tf, {FOLD.format('g')} AS gf FROM c), j AS (SELECT f.*, x.q AS oq, x.country AS oc, y.q AS gq, y.country AS gc FROM f LEFT JOIN pl x ON x.name_key = lower(t) LEFT JOIN pl y ON y.name_key = lower(g)),
r AS (SELECT *, CASE WHEN upper(trim(o)) IN ('', 'NONE') OR t = '' THEN '' WHEN tf = gf OR (len(tf) >= 4 AND len(gf) >= 4 AND (contains(tf, gf) OR contains(gf, tf))) THEN 'exact_match' WHEN oq = gq THEN 'exact_match' WHEN oc = gc THEN 'country_match' ELSE 'no_match' END AS eval_type FROM j)"""
TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
GRAMS = ", ".join(f"{t} AS (SELECT p_partkey, n, array_to_string({c}[i:i + n - 1], chr(1)) AS x, count(*) AS c FROM (SELECT p_partkey, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM w, k WHERE len({c}) >= n) GROUP BY ALL)" for t, c in (("go", "o"), ("gg", "g")))
def vector_scores(weighted: bool) -> str:
    weight = "ln(((SELECT count(DISTINCT key) FROM e WHERE t) + 1) / (coalesce(df, 0) + 1)::DOUBLE)" if weighted else "1.0"
    return f"""WITH e AS (SELECT vec_id // 10 AS key, vec_id % 5 AS pos, vec_id % 10 < 5 AS t, 'l' || label AS token, embedding::DOUBLE[] AS v FROM embeddings),
df AS (SELECT token, count(DISTINCT key) AS df FROM e WHERE t GROUP BY 1),
b AS (SELECT x.key, x.t, x.pos, any_value(x.token) AS token, max(list_cosine_similarity(x.v, y.v)) AS l FROM e x LEFT JOIN e y ON x.key = y.key AND x.t <> y.t GROUP BY 1, 2, 3),
w AS (SELECT b.*, {weight} AS w FROM b LEFT JOIN df USING (token)),
s AS (SELECT key, coalesce(sum(w * coalesce(l, 0)) FILTER (NOT t) / nullif(sum(w) FILTER (NOT t), 0), 0) AS p, coalesce(sum(w * coalesce(l, 0)) FILTER (t) / nullif(sum(w) FILTER (t), 0), 0) AS r FROM w GROUP BY 1)
SELECT key, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s"""


ORACLES = {
    "meteor_words": f"""WITH d AS (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type, ' '), lambda w: w <> '') AS a, list_filter(string_split(p_type || ' ' || p_name, ' '), lambda w: w <> '') AS b FROM part),
e AS (SELECT p_partkey, list_filter(a, lambda w, i: list_position(a, w) = i) AS g, list_filter(b, lambda w, i: list_position(b, w) = i) AS r FROM d),
w AS (SELECT p_partkey, g, list_concat(r[2:], r[:1]) AS o FROM e),
k AS (SELECT p_partkey, i, list_position(g, o[i]) AS j FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM w)),
c AS (SELECT p_partkey, count(*) AS m, count(*) FILTER (coalesce(j <> b + 1, true)) AS c FROM (SELECT *, lag(j) OVER (PARTITION BY p_partkey ORDER BY i) AS b FROM k) WHERE j > 0 GROUP BY 1)
SELECT p_partkey, array_to_string(g, ' ') AS gt, array_to_string(o, ' ') AS llm_output, round(10 * (m / len(o)) * (m / len(g)) / (m / len(g) + 9 * (m / len(o))) * (1 - 0.5 * (c / m) ^ 3), 6) AS METEOR_full FROM w JOIN c USING (p_partkey)""",
    "bert_score_vectors": vector_scores(False),
    "bert_score_weighted": vector_scores(True),
    "judge_prompts": f"""{with_views('a')}, n AS (SELECT Q_number, llm_output, gt, range(1, least(20, 1 + Q_number[2:]::INT % 30) + 1) AS k FROM a)
SELECT Q_number, 'Does the answer name the same country as the truth? Say one of: exact_match, alias_match, substring_match, demonym_match, historical_match, no_match.' || chr(10) || 'Answer: ' || llm_output || chr(10) || 'Truth: ' || gt || chr(10)
 || 'Demonyms: ' || array_to_string(list_transform(k, lambda i: 'd' || i), ', ') || chr(10) || 'Aliases: ' || array_to_string(list_transform(k, lambda i: 'a{{' || i), ', ') AS asked FROM n""",
    "translate_table": f"{TABLE}, ms AS (SELECT DISTINCT LoQ AS loq, llm_output AS text FROM lk WHERE llm_output_en IS NULL) SELECT loq, text, en, pos FROM tr UNION ALL SELECT loq, text, CASE WHEN len(text) % 2 = 0 THEN 'en ' || text ELSE text END, (SELECT max(pos) FROM tr) + row_number() OVER (ORDER BY text, loq) FROM ms",
    "dob_grade": f"{DOB} SELECT l_orderkey, l_linenumber, eval, eval_type, eval_score FROM dob",
    "dob_summary": f"{DOB} SELECT model, eval, eval_type, count(*) AS n, round(avg(eval_score), 6) AS mean_score FROM dob GROUP BY ALL",
    "dob_weighted_avg": f"{DOB} SELECT model, round(avg(eval_score), 6) AS mean_score, round(avg((eval = 'TP')::INT), 6) AS hit_share FROM dob GROUP BY ALL",
    "dob_failure_modes": f"{DOB} SELECT CASE WHEN o1 IN ('YYYY-MM-DD', 'RRRR-MM-DD') THEN 'literal_format_echo' WHEN regexp_full_match(o1, '\\d{{4}}') THEN 'year_only_no_format' WHEN ok THEN 'wrong_date_correct_format' WHEN len(o1) > 40 THEN 'verbose_response' ELSE 'other_format' END AS failure_mode, count(*) AS n FROM dob WHERE eval_type = 'no_match' GROUP BY 1",
    "dob_format_compliance": f"{DOB} SELECT count(*) AS n, count(*) FILTER (ok) AS n_format, count(*) FILTER (ok AND eval_score = 0) AS n_wrong, count(*) FILTER (ok AND eval_score <> 0) AS n_right FROM dob",
    "dob_year_error_buckets": f"{DOB}, w AS ({WRONG}), z AS (SELECT count(*) AS a, round(avg(y), 6) AS mean_diff, round(quantile_cont(y, 0.5), 6) AS median_diff FROM w) SELECT CASE WHEN y <= 0 THEN NULL WHEN y <= 1 THEN '0-1' WHEN y <= 5 THEN '2-5' WHEN y <= 10 THEN '6-10' WHEN y <= 50 THEN '11-50' WHEN y <= 100 THEN '51-100' WHEN y <= 500 THEN '101-500' WHEN y <= 5000 THEN '500+' END AS bucket, count(*) AS n, round(count(*) / any_value(a)::DOUBLE, 6) AS share, any_value(mean_diff) AS mean_diff, any_value(median_diff) AS median_diff FROM w, z GROUP BY 1",
    "dob_score_distribution": f"{DOB} SELECT eval_score, count(*) AS n, round(count(*) / (SELECT count(*) FROM dob)::DOUBLE, 6) AS share FROM dob GROUP BY 1",
    "dob_model_summary": f"{DOB} SELECT model, round(avg(ok::INT), 6) AS format_share, round(avg(eval_score), 6) AS mean_score FROM dob GROUP BY 1",
    "casefold_text": f"SELECT doc_id, md5({STRIP.format(FOLD.format('text'))}) AS folded_md5 FROM documents",
    "normalize_candidates": CAND + """ SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(t, ','), lambda p: trim(split_part(regexp_replace(trim(p), '[''"\\[\\]()]+', '', 'g'), '/', 1))), lambda p: p <> ''), '|') AS candidates FROM s3""",
    "clean_place": f"""{with_views('x')} SELECT p_partkey, trim(regexp_replace(trim(split_part(trim(regexp_replace(trim(regexp_replace(trim(raw), '[''"\\[\\]]+', '', 'g')), '\\s*\\([^)]*\\)\\s*$', '')), ',', 1)), '\\.+$', '')) AS place FROM x""",
    "parse_gt_list": f"""{with_views('x')} SELECT x.p_partkey, CASE x.p_partkey % 7 WHEN 0 THEN p_name || '|' || p_type ELSE trim(trim(raw), '[]''"') END AS truths FROM x JOIN part USING (p_partkey)""",
    "split_list": f"""{with_views('x')} SELECT p_partkey, CASE WHEN trim(raw) LIKE '[%]' THEN array_to_string(list_filter(list_transform(string_split(trim(raw)[2:-2], ','), lambda p: trim(trim(p), '''"')), lambda p: p <> ''), '|') END AS items FROM x""",
    "empty_answers": f"""{with_views('a')} SELECT Q_number, upper(trim(llm_output)) IN ('', 'NONE', 'N/A', 'NA', 'NULL', '[]', '['''']', '[""]') AS empty_name, upper(trim(llm_output)) IN ('', 'NONE') AS empty_word FROM a""",
    "substring_pairs": f"WITH c AS (SELECT p_partkey, {FOLD.format('p_name')} AS a, {FOLD.format("regexp_replace(p_name, '^[^ ]+ ', '')")} AS b, {FOLD.format('p_brand')} AS d FROM part) SELECT p_partkey, len(a) >= 4 AND len(b) >= 4 AND (contains(a, b) OR contains(b, a)) AS similar, len(a) >= 4 AND len(d) >= 4 AND (contains(a, d) OR contains(d, a)) AS brand FROM c",
    "translate_lookup": f"{TABLE} SELECT Q_number, LoQ, llm_output, llm_output_en FROM lk",
    "translate_misses": f"{TABLE} SELECT DISTINCT LoQ AS loq, llm_output AS text FROM lk WHERE llm_output_en IS NULL",
    "resume_anti_join": f"{DOB} SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS Q_number, eval, eval_type FROM dob",
    "country_grade": f"{COUNTRY} SELECT Q_number, eval, eval_type, provenance FROM cf",
    "country_summary": f"{COUNTRY} SELECT LoQ, eval, eval_type, count(*) AS n FROM cf GROUP BY ALL",
    "place_grade": f"{PLACE} SELECT Q_number, CASE eval_type WHEN '' THEN 'FN' WHEN 'no_match' THEN 'FP' ELSE 'TP' END AS eval, eval_type, CASE eval_type WHEN '' THEN '' WHEN 'no_match' THEN 'judge' ELSE 'auto' END AS provenance FROM r",
    "bleu_rouge": f"""WITH RECURSIVE t AS (SELECT p_partkey, p_name || ' ' || p_type AS gt, p_type || ' ' || p_name || ' ' || p_brand AS llm_output FROM part), w AS (SELECT *, {TOKENS.format('gt')} AS g, {TOKENS.format('llm_output')} AS o FROM t), k AS (SELECT unnest(range(1, 5)) AS n),
{GRAMS}, cl AS (SELECT p_partkey, n, sum(least(go.c, gg.c)) AS c FROM go JOIN gg USING (p_partkey, n, x) GROUP BY 1, 2),
pr AS (SELECT w.p_partkey, k.n, ln((coalesce(c, 0) + 1e-15) / (greatest(len(o) - k.n + 1, 0) + 1e-9)) AS l FROM w CROSS JOIN k LEFT JOIN cl ON cl.p_partkey = w.p_partkey AND cl.n = k.n),
b AS (SELECT p_partkey, exp(avg(l) FILTER (n <= 1)) AS b1, exp(avg(l) FILTER (n <= 2)) AS b2, exp(avg(l) FILTER (n <= 3)) AS b3, exp(avg(l)) AS b4 FROM pr GROUP BY 1),
z AS (SELECT *, CASE WHEN (len(o) + 1e-15) / (len(g) + 1e-9) < 1 THEN exp(1 - (len(g) + 1e-9) / (len(o) + 1e-15)) ELSE 1 END AS bp FROM w),
same AS (SELECT p_partkey, i, j FROM (SELECT p_partkey, g, o, i, unnest(range(1, len(g) + 1)) AS j FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM w)) WHERE o[i] = g[j]),
chain(p_partkey, i, j, l) AS (SELECT p_partkey, i, j, 1 FROM same UNION SELECT c.p_partkey, s.i, s.j, l + 1 FROM chain c JOIN same s ON s.p_partkey = c.p_partkey AND s.i > c.i AND s.j > c.j),
lcs AS (SELECT p_partkey, max(l) AS l FROM chain GROUP BY 1), m AS (SELECT p_partkey, c AS m FROM cl WHERE n = 1)
SELECT p_partkey, gt, llm_output, round(b1 * bp, 6) AS Bleu_1, round(b2 * bp, 6) AS Bleu_2, round(b3 * bp, 6) AS Bleu_3, round(b4 * bp, 6) AS Bleu_4, round(coalesce((1 + 1.2 ^ 2) * (l / len(o)) * (l / len(g)) / (l / len(g) + 1.2 ^ 2 * (l / len(o))), 0), 6) AS ROUGE_L, round(coalesce(10 * (m / len(o)) * (m / len(g)) / (m / len(g) + 9 * (m / len(o))), 0), 6) AS METEOR FROM z JOIN b USING (p_partkey) LEFT JOIN lcs USING (p_partkey) LEFT JOIN m USING (p_partkey)""",
    "cider": f"""WITH w AS (SELECT p_partkey, {TOKENS.format('p_name')} AS g, {TOKENS.format("(p_name || ' ' || p_type)")} AS o FROM part), k AS (SELECT unnest(range(1, 5)) AS n), {GRAMS},
df AS (SELECT n, x, count(*) AS df FROM gg GROUP BY 1, 2), total AS (SELECT ln(greatest(1.0, count(*))) AS total FROM w),
v AS (SELECT p_partkey, n, coalesce(gg.c, 0) * (total - ln(greatest(1, coalesce(df, 0)))) AS a, coalesce(go.c, 0) * (total - ln(greatest(1, coalesce(df, 0)))) AS b FROM gg FULL JOIN go USING (p_partkey, n, x) LEFT JOIN df USING (n, x) CROSS JOIN total),
c AS (SELECT p_partkey, n, sum(least(a, b) * a) AS s, sqrt(sum(a * a)) AS x, sqrt(sum(b * b)) AS y FROM v GROUP BY 1, 2), f AS (SELECT p_partkey, sum(CASE WHEN x > 0 AND y > 0 THEN s / (x * y) ELSE 0 END) / 4 AS f FROM c GROUP BY 1)
SELECT p_partkey, round(10 * coalesce(f, 0) * exp(-((len(o) - len(g)) ^ 2) / (2 * 6.0 ^ 2)), 6) AS CIDEr FROM w LEFT JOIN f USING (p_partkey)""",
    "verdict_fallback": f"{COUNTRY} SELECT DISTINCT trim(o) AS llm_output, trim(gt) AS gt_raw FROM cf WHERE provenance = 'judge' AND NOT EXISTS (SELECT 1 FROM v WHERE v.llm_output = trim(o) AND v.gt_raw = trim(gt))",
}
