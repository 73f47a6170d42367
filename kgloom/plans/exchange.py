"""Files written and read again, text tools, reports in order, and the answers of translators and judges, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions import bins, text
from ..operators import grading, inference, order, prompts, stats
from ..schemas import ANSWERS, VERDICTS
from ..sources import caches, files
from . import graph, samples
from .views import view, with_views

COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]


def answers(spark, d: str) -> DataFrame:
    return view(spark, d, "a").select(COLUMNS)


def ids(spark, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_ids(spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("Q"), "c_custkey")), path)
    return files.read_ids(spark, path)


def csv_answers(spark, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_csv(answers(spark, d), path)
    return files.read_answers(spark, path)


def csv_without(spark, d: str) -> DataFrame:
    """Two columns left out on the way, and a number read as a number."""
    path = files.scratch(spark)
    files.write_csv(answers(spark, d).withColumn("pos", F.regexp_replace("Q_number", "c", "")), path, drop=("prompt", "gt"))
    return files.read_csv(spark, path, "Q_number string, LoE string, LoQ string, property string, llm_output string, pos long")


def csv_texts(spark, d: str) -> DataFrame:
    """Whole texts with their line breaks and quotes."""
    path = files.scratch(spark)
    files.write_csv(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), path)
    return files.read_answers(spark, path, "doc_id string, text string").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


def split(spark, d: str) -> DataFrame:
    """A folder for each property and model; the second writing replaces one of them only."""
    path = files.scratch(spark)
    rows = answers(spark, d).withColumn("model", F.concat(F.lit("m"), F.length("llm_output") % 3))
    files.write_answers(rows, path)
    files.write_answers(rows.where("model = 'm1'").withColumn("llm_output", F.lit("again")), path)
    return spark.read.options(**files.CSV, inferSchema="false").csv(path).groupBy("property", "model").agg(F.count("*").alias("n"), F.count_if(F.col("llm_output") == "again").alias("n_again"))


def cache(spark, d: str) -> DataFrame:
    path, of = files.scratch(spark), view(spark, d, "v")
    before = files.read_cache(spark, path, VERDICTS).count()
    for odd in (0, 1):
        files.append_cache(of.where(F.length("gt_raw") % 2 == odd), path)
    return files.read_cache(spark, path, VERDICTS).withColumn("before", F.lit(before))


def cache_upsert(spark, d: str) -> DataFrame:
    """Orders' states by key, put twice: the second takes the place of some rows, adds others, and of two with a key the later order counts."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("state"))
    cache = caches.Cache(spark, files.scratch(spark), "k long, at long, state string", ("k",), 8)
    cache.put(o.where("k % 3 != 0").withColumn("state", F.lit("old")), latest="at")
    cache.put(o.where("k % 2 = 0"), latest="at")
    return cache.read()


def entities_object(spark, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_entity_object(graph.documents(spark, d), path)
    return counted(files.read_entities(spark, path, list(graph.PAIRS.values())))


def entities_lines(spark, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_entities(graph.documents(spark, d), path)
    return counted(files.read_entity_lines(spark, path))


def counted(documents: DataFrame) -> DataFrame:
    n = lambda p: F.coalesce(F.try_element_at("props", F.lit(p))["count"], F.lit(0)).alias(p)
    return documents.select("qid", "labels_count", "sitelinks", graph.flat("labels").alias("labels"), n("P27"), n("P106"))


def batch_ids(spark, d: str) -> DataFrame:
    """All ids in requests of 200."""
    return order.batched(ids(spark, d), 200, F.length("qid"), "qid")


def sorted_prompts(spark, d: str) -> DataFrame:
    """Prompts of all entities by their number of links, the most first."""
    asked = prompt_rows(spark, d)
    return order.numbered(asked, F.desc("num_sitelinks"), "Q_number", "language").select("Q_number", "language", "num_sitelinks", "rank")


def prompt_rows(spark, d: str) -> DataFrame:
    """A prompt for each customer and language of its nation's labels, with the customer's links."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("Q_number"), F.concat(F.lit("n"), "c_nationkey").alias("entity"), F.col("c_acctbal").cast("int").alias("num_sitelinks"))
    said = view(spark, d, "l").where("kind = 'label'").select("entity", F.col("lang").alias("language"))
    return c.join(said, "entity").drop("entity")


def model_samples(spark, d: str) -> DataFrame:
    """A sample for each part."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("Q_number"), F.lit("en").alias("LoE"), F.lit("en").alias("LoQ"), F.lit("name").alias("property"), F.col("p_brand").alias("gt"), F.concat("p_type", F.lit(". ")).alias("instruction"), F.col("p_name").alias("question"))


MODELS = ("google/gemma-2-9b-it", "moonshotai/Moonlight-16B-A3B-Instruct")


def inference_batches(spark, d: str) -> DataFrame:
    """The batches that each model gets, with what padding adds."""

    def of(model: str) -> DataFrame:
        asked = model_samples(spark, d).withColumn("input", prompts.chat(F.lit(prompts.layout_of(model))))
        found = inference.in_batches(asked, inference.settings(model)["batch_size"])
        return inference.batch_report(found).select(F.lit(model).alias("model"), "batch", "n", "longest", "padding")

    return of(MODELS[0]).unionByName(of(MODELS[1]))


def backwards(batch: list, how: dict) -> list[str]:
    """A model that says what it is asked backwards, and how many it is asked together."""
    return [f"{len(batch)} {m[-1]['content'][::-1]}" for m in batch]


def inference_answers(spark, d: str) -> DataFrame:
    """Answers of a model that is asked in batches of the size of its settings."""
    generator = inference.Batched(MODELS[1], backwards)
    return inference.infer(model_samples(spark, d), MODELS[1], generator)


def tools(spark, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(text.one_line("text")).alias("one_line"), F.md5(text.ascii_only("text")).alias("ascii_only"), F.md5(text.without_echo("text", F.substring("text", 1, 10))).alias("without_echo"))


def model_output(spark, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("I think\nso</think>\n "), "p_name", F.lit(" </think>x"))).otherwise(F.concat("p_type", F.lit("\n"), "p_name"))
    name = F.concat(F.lit("property_pob_"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, "_prov").otherwise(""), F.lit(".csv"))
    return p.select("p_partkey", text.without_thoughts(said).alias("answer"), text.model_of(name, "property_pob").alias("model"), text.id_of(F.concat(F.lit("http://x/y/Q"), "p_partkey")).alias("id"))


def contracts(spark, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 5).alias("k"))
    one, two = F.to_json(F.struct(F.col("p_name").alias("en"))), F.to_json(F.struct(F.array("p_name", "p_type").alias("en")))
    answer = F.when(F.col("k") == 0, one).when(F.col("k") == 1, two).when(F.col("k") == 2, F.lit("not JSON")).when(F.col("k") == 3, F.lit('{"de": "x"}')).otherwise(F.lit('{"en": 7}'))
    said = F.when(F.col("k") == 0, F.lit('{"match_type": "alias_match", "reason": "r"}')).when(F.col("k") == 1, F.lit('{"match_type": "perhaps"}')).when(F.col("k") == 2, F.lit("")).when(F.col("k") == 3, F.lit('{"match_type": null}')).otherwise(F.lit('{"match_type": "no_match"}'))
    return p.select("p_partkey", providers.translation_of(answer, F.col("p_type")).alias("en"), providers.verdict_of(said, list(grading.COUNTRY_SCORES)).alias("verdict"))


def ranked_sets(spark, d: str) -> DataFrame:
    return order.numbered(samples.cover(spark, d), F.desc("score"), F.desc("coverage"), "properties")


def sorted_entities(spark, d: str) -> DataFrame:
    """All entities by links, the most first; entities without a count come last."""
    return order.numbered(view(spark, d, "s"), F.desc_nulls_last("sitelinks"), "qid")


QUERIES = {
    "io_ids": ids,
    "io_csv_answers": csv_answers,
    "io_csv_missing": csv_without,
    "io_csv_texts": csv_texts,
    "io_split_by_property": split,
    "io_cache": cache,
    "cache_upsert": cache_upsert,
    "io_entities_object": entities_object,
    "io_entities_lines": entities_lines,
    "batch_ids": batch_ids,
    "text_tools": tools,
    "model_output": model_output,
    "answer_contracts": contracts,
    "non_null_counts": lambda spark, d: stats.non_null_counts(spark.read.parquet(f"{d}/documents.parquet"), "lang"),
    "bin_edges": lambda spark, d: spark.createDataFrame([(x,) for x in bins.edges(*view(spark, d, "s").agg(F.min("sitelinks"), F.max("sitelinks")).first(), samples.WIDTH)], "edge long"),
    "top_entities": lambda spark, d: stats.top(view(spark, d, "s").select("lang", "qid", "sitelinks"), 100, F.desc_nulls_last("sitelinks"), "qid"),
    "ranked_value_counts": lambda spark, d: order.numbered(view(spark, d, "g").groupBy("eval_type").agg(F.count("*").alias("n")), F.desc("n"), "eval_type"),
    "ranked_names": lambda spark, d: order.numbered(view(spark, d, "g").select("model", "LoE", "LoQ").distinct(), "model", "LoE", "LoQ"),
    "ranked_stages": lambda spark, d: order.numbered(samples.summary(spark, d).select("stage", "lang", "n"), "stage", "lang"),
    "ranked_bins": lambda spark, d: order.numbered(stats.histogram(view(spark, d, "s"), "lang", "sitelinks", samples.WIDTH).select("lang", "bin_lo", "n"), "bin_lo", "lang"),
    "ranked_sets": ranked_sets,
    "sorted_entities": sorted_entities,
    "sorted_prompts": sorted_prompts,
    "inference_batches": inference_batches,
    "inference_answers": inference_answers,
}
A = "SELECT " + ", ".join(COLUMNS) + " FROM a"
COUNTED = f"{graph.DOCS} SELECT qid, labels_count, sitelinks, labels, (c IS NOT NULL)::INT AS P27, (s IS NOT NULL)::INT AS P106 FROM dl"
ORACLES = {
    "io_ids": "SELECT 'Q' || c_custkey AS qid FROM customer",
    "io_csv_answers": f"{with_views('a')} {A}",
    "io_csv_missing": f"{with_views('a')} SELECT Q_number, LoE, LoQ, property, CASE WHEN llm_output NOT IN ('None', 'N/A', 'NA', 'nan', 'null', 'NULL', '') THEN llm_output END AS llm_output, Q_number[2:]::BIGINT AS pos FROM a",
    "io_csv_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "io_split_by_property": f"{with_views('a')} SELECT property, 'm' || (len(llm_output) % 3) AS model, count(*) AS n, count(*) FILTER (len(llm_output) % 3 = 1) AS n_again FROM a GROUP BY 1, 2",
    "io_cache": f"{with_views('v')} SELECT llm_output, gt_raw, match_type, 0 AS before FROM v",
    "cache_upsert": "SELECT o_custkey AS k, max(o_orderkey) AS at, CASE WHEN o_custkey % 2 = 0 THEN arg_max(o_orderstatus, o_orderkey) ELSE 'old' END AS state FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey % 2 = 0 GROUP BY o_custkey",
    "io_entities_object": COUNTED,
    "io_entities_lines": COUNTED,
    "batch_ids": "SELECT ((row_number() OVER (ORDER BY len(q), q) - 1) // 200)::BIGINT AS batch, q AS qid FROM (SELECT 'Q' || c_custkey AS q FROM customer)",
    "text_tools": "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS one_line, md5(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) AS ascii_only, md5(text[11:]) AS without_echo FROM documents",
    "model_output": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name END AS answer, replace(p_brand, '#', '-') AS model, 'Q' || p_partkey AS id FROM part",
    "answer_contracts": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '["' || p_name || '", "' || p_type || '"]' WHEN 4 THEN '7' ELSE p_type END AS en, CASE p_partkey % 5 WHEN 0 THEN 'alias_match' ELSE 'no_match' END AS verdict FROM part""",
    "non_null_counts": "SELECT lang, count(doc_id) AS doc_id, count(text) AS text, count(source) AS source, count(n_chars) AS n_chars FROM documents GROUP BY 1",
    "bin_edges": f"{with_views('s')} SELECT unnest(range((floor(min(sitelinks) / {samples.WIDTH}.0) * {samples.WIDTH})::BIGINT, ((floor(max(sitelinks) / {samples.WIDTH}.0) + 2) * {samples.WIDTH})::BIGINT + 1, {samples.WIDTH})) AS edge FROM s",
    "top_entities": f"{with_views('s')} SELECT lang, qid, sitelinks, row_number() OVER (ORDER BY sitelinks DESC NULLS LAST, qid) AS rank FROM s QUALIFY rank <= 100",
    "ranked_value_counts": f"{with_views('g')} SELECT *, row_number() OVER (ORDER BY n DESC, eval_type) AS rank FROM (SELECT eval_type, count(*) AS n FROM g GROUP BY 1)",
    "ranked_names": f"{with_views('g')} SELECT *, row_number() OVER (ORDER BY model, LoE, LoQ) AS rank FROM (SELECT DISTINCT model, LoE, LoQ FROM g)",
    "ranked_stages": f"{samples.MATCHED}, u AS (SELECT lang, 'matched' AS stage FROM m UNION ALL SELECT lang, 'original' FROM s WHERE sitelinks IS NOT NULL), c AS (SELECT stage, lang, count(*) AS n FROM u GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY stage, lang) AS rank FROM c",
    "ranked_bins": f"{samples.BINS} SELECT *, row_number() OVER (ORDER BY bin_lo, lang) AS rank FROM h",
    "ranked_sets": samples.ORACLES["property_coverage"].replace("SELECT array_to_string", "SELECT *, row_number() OVER (ORDER BY score DESC, coverage DESC, properties) AS rank FROM (SELECT array_to_string") + ")",
    "sorted_entities": f"{with_views('s')} SELECT lang, qid, sitelinks, row_number() OVER (ORDER BY sitelinks DESC NULLS LAST, qid) AS rank FROM s",
    "sorted_prompts": f"""{with_views('l')}, p AS (SELECT 'c' || c_custkey AS Q_number, lang AS language, trunc(c_acctbal)::INT AS num_sitelinks FROM customer JOIN l ON entity = 'n' || c_nationkey AND kind = 'label')
SELECT *, row_number() OVER (ORDER BY num_sitelinks DESC, Q_number, language) AS rank FROM p""",
    "inference_batches": """
WITH p AS (SELECT 'p' || p_partkey AS q, len(p_type || '. ' || p_name) AS n FROM part),
b AS (SELECT model, n, (row_number() OVER (PARTITION BY model ORDER BY n, q) - 1) // size AS batch FROM p, (VALUES ('google/gemma-2-9b-it', 256), ('moonshotai/Moonlight-16B-A3B-Instruct', 64)) m(model, size))
SELECT model, batch, count(*) AS n, max(n)::INT AS longest, (max(n) * count(*) - sum(n))::BIGINT AS padding FROM b GROUP BY 1, 2""",
    "inference_answers": """
WITH p AS (SELECT 'p' || p_partkey AS Q_number, p_brand AS gt, p_type || '. ' AS i, p_name AS q FROM part),
b AS (SELECT *, (row_number() OVER (ORDER BY len(i || q), Q_number) - 1) // 64 AS batch FROM p)
SELECT Q_number, 'en' AS LoE, 'en' AS LoQ, 'name' AS property, gt, rtrim(count(*) OVER (PARTITION BY batch) || ' ' || reverse(q)) AS llm_output, i || q AS prompt FROM b""",
}
