"""Graph patterns, entity documents and prompt grids over triples made of customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, kg, prompts
from ..schemas import TRIPLES
from .views import view, with_views

LANGUAGES = ["en", "fr", "de"]
PAIRS = {"country": "P27", "segment": "P106"}
TEMPLATES = [(lang, p, f"## {lang}: tell the {p}. ## {p} of {{}}?" + (" ## Example: x" if p == "country" else "")) for lang in LANGUAGES for p in PAIRS]


def flat(labels) -> F.Column:
    """A map of labels as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def facts(spark, d: str) -> DataFrame:
    t = view(spark, d, "t")
    ids = t.where("p = 'P27'").select(F.col("s").alias("qid"))
    return kg.facts(t, view(spark, d, "l"), ids, list(PAIRS.values()), LANGUAGES)


def documents(spark, d: str) -> DataFrame:
    return entities.documents(facts(spark, d), kg.link_counts(view(spark, d, "k")))


def vocab(spark, d: str) -> DataFrame:
    label = view(spark, d, "l").where("entity like 'n%'")
    return kg.vocabulary(label, label.where("kind = 'demonym'"), ["en"])


def classes(spark) -> DataFrame:
    return spark.createDataFrame([("r0",), ("r1",), ("r2",)], "class string")


def grid(spark, d: str) -> DataFrame:
    table = spark.createDataFrame(TEMPLATES, "lang string, property string, template string")
    return prompts.grid(documents(spark, d), table, LANGUAGES, PAIRS)


def long(spark, d: str) -> DataFrame:
    g = grid(spark, d)
    wide = g.groupBy("ent_ID", "lang").pivot("property", list(PAIRS)).agg(F.first("ground_truth").alias("ground_truth"), F.first("prompt").alias("prompt"))
    return prompts.samples(wide, F.lit("en"))


def chat(spark, d: str) -> DataFrame:
    layouts = spark.createDataFrame([(x,) for x in prompts.LAYOUTS], "layout string")
    c = prompts.chat("layout")
    return long(spark, d).crossJoin(F.broadcast(layouts)).select("Q_number", "LoQ", "property", "layout", F.size(c).alias("n"), F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " / ").alias("messages"))


QUERIES = {
    "kg_facts_labels": lambda spark, d: facts(spark, d).select("qid", "property", "value", flat("labels").alias("labels"), flat("value_labels").alias("value_labels")),
    "kg_link_counts": lambda spark, d: kg.link_counts(view(spark, d, "k")),
    "kg_star_entities": lambda spark, d: kg.star(view(spark, d, "t"), ["L0", "L1"], ["SBUILDING", "SMACHINERY"]),
    "kg_count_distinct": lambda spark, d: kg.star(view(spark, d, "t"), ["L0", "L1"], ["SBUILDING", "SMACHINERY"]).agg(F.countDistinct("entity_id").alias("n")),
    "kg_page": lambda spark, d: kg.page(kg.star(view(spark, d, "t"), ["L0"], ["SBUILDING"]), 20, 10),
    "kg_path_depth2": lambda spark, d: kg.subclasses(view(spark, d, "t"), classes(spark), 2),
    "kg_union_count": lambda spark, d: kg.count_by_class(view(spark, d, "t").unionByName(view(spark, d, "t").where("p = 'P27'").withColumn("p", F.lit("P106"))), classes(spark), 1),
    "kg_vocab_union": vocab,
    "kg_successor_terminals": lambda spark, d: kg.terminals(view(spark, d, "e"), view(spark, d, "e").select(F.col("a").alias("node"))),
    "kg_vocab_fallback": lambda spark, d: kg.with_successors(vocab(spark, d), view(spark, d, "e")),
    "kg_harvest": lambda spark, d: kg.harvest(view(spark, d, "t").unionByName(spark.createDataFrame([("SBUILDING", "P279", "SHOUSEHOLD"), ("SMACHINERY", "P279", "SBUILDING")], TRIPLES)), view(spark, d, "k"), spark.createDataFrame([("SHOUSEHOLD",)], "class string"), ["L0"]),
    "kg_harvest_every_language": lambda spark, d: kg.harvest(view(spark, d, "t"), view(spark, d, "k"), spark.createDataFrame([("SFURNITURE",), ("SAUTOMOBILE",)], "class string"), view(spark, d, "t").where("p = 'P1412'").select("o"), 7),
    "kg_sitelinks_of_one": lambda spark, d: kg.sitelinks(view(spark, d, "k"), "c1"),
    "kg_entity_vocabulary": lambda spark, d: kg.entity_vocabulary(kg.citizenship(view(spark, d, "t")), vocab(spark, d)).select("entity_q", *(F.array_join(c, "|").alias(c) for c in ("demonyms", "aliases", "labels"))),
    "entity_documents": lambda spark, d: documents(spark, d).select("qid", flat("labels").alias("labels"), "labels_count", *(F.array_join(F.transform(entities.values(p), lambda v: F.concat(v["value"], F.lit(":"), v["labels_count"])), "|").alias(p) for p in ("P27", "P106")), "sitelinks"),
    "entity_completeness": lambda spark, d: entities.completeness(documents(spark, d).withColumn("lang", F.element_at(entities.values("P106"), 1)["value"]), list(PAIRS.values()), LANGUAGES),
    "complete_filter": lambda spark, d: entities.complete(documents(spark, d), list(PAIRS.values()), LANGUAGES).select("qid"),
    "labels_all_langs": lambda spark, d: documents(spark, d).select("qid", entities.in_all(F.col("labels"), LANGUAGES).alias("own"), entities.has_label("en").alias("en"), entities.has_value_in("P27", "de").alias("country_de"), entities.has_value_in_all("P27", LANGUAGES).alias("country_all")),
    "prompt_grid": lambda spark, d: grid(spark, d).select("ent_ID", "lang", "property", F.array_join("ground_truth", "|").alias("ground_truth"), "prompt", "num_sitelinks"),
    "prompt_unpivot": lambda spark, d: long(spark, d),
    "chat_messages": chat,
    "split_by_property": lambda spark, d: prompts.answers(long(spark, d), F.upper("Q_number")).groupBy("property", "LoQ").agg(F.count("*").alias("n"), F.min("prompt").alias("first_prompt")),
}

PER = f"{with_views('t', 'l', 'k')}, lm AS (SELECT entity, string_agg(lang || '=' || value, '|' ORDER BY lang || '=' || value) AS labels, count(*)::INT AS n, list(lang) AS langs FROM l WHERE kind = 'label' AND lang IN ('en', 'fr', 'de') GROUP BY 1), f AS (SELECT s AS qid, p AS property, o AS value FROM t WHERE p IN ('P27', 'P106') AND s IN (SELECT s FROM t WHERE p = 'P27')), lk AS (SELECT entity, count(*) AS n FROM k WHERE regexp_matches(site, '^https://[a-z-]+\\.wikipedia\\.org/$') GROUP BY 1)"
STAR = "{0} SELECT DISTINCT s AS entity_id FROM t WHERE p = 'P106' AND o IN ({1}) AND s IN (SELECT s FROM t WHERE p = 'P31' AND o = 'Q5') AND s IN (SELECT s FROM t WHERE p = 'P1412' AND o IN ({2}))"
DOCS = f"{PER}, doc AS (SELECT qid, max(CASE WHEN property = 'P27' THEN value END) AS c, max(CASE WHEN property = 'P106' THEN value END) AS s FROM f GROUP BY 1), dl AS (SELECT doc.qid, doc.c, doc.s, coalesce(lm.labels, '') AS labels, coalesce(lm.n, 0)::INT AS labels_count, coalesce(lm.langs, []) AS langs, cl.n AS cn, sl.n AS sn, coalesce(cl.langs, []) AS clangs, lk.n AS sitelinks FROM doc LEFT JOIN lm ON lm.entity = qid LEFT JOIN lm cl ON cl.entity = c LEFT JOIN lm sl ON sl.entity = s LEFT JOIN lk ON lk.entity = qid)"
VOCAB = f"{{0}}, voc AS (SELECT DISTINCT entity AS country_q, lang, kind, value FROM l WHERE entity LIKE 'n%' AND lang = 'en')"
CLOSE = "close(root, node) AS (SELECT a, b FROM e UNION SELECT root, b FROM close JOIN e ON e.a = node), term AS (SELECT root, node FROM close WHERE node NOT IN (SELECT a FROM e))"
GRID = (
    f"{DOCS}, lg AS (SELECT unnest(['en', 'fr', 'de']) AS lang), pr AS (SELECT unnest(['country', 'segment']) AS property), g AS (SELECT qid AS ent_ID, lg.lang, property, coalesce(v.value, '') AS ground_truth, coalesce(own.value, en.value) AS name, sitelinks AS num_sitelinks"
    " FROM dl CROSS JOIN lg CROSS JOIN pr LEFT JOIN l v ON v.entity = CASE property WHEN 'country' THEN c ELSE s END AND v.kind = 'label' AND v.lang = lg.lang LEFT JOIN l own ON own.entity = qid AND own.kind = 'label' AND own.lang = lg.lang LEFT JOIN l en ON en.entity = qid AND en.kind = 'label' AND en.lang = 'en'),"
    " gp AS (SELECT ent_ID, lang, property, ground_truth, CASE WHEN ground_truth = '' THEN '' ELSE '## ' || lang || ': tell the ' || property || '. ## ' || property || ' of ' || name || '?' || CASE property WHEN 'country' THEN ' ## Example: x' ELSE '' END END AS prompt, num_sitelinks FROM g WHERE name IS NOT NULL),"
    " smp AS (SELECT ent_ID AS Q_number, 'en' AS LoE, property, lang AS LoQ, '[\"' || ground_truth || '\"]' AS gt, '## ' || split_part(prompt, '##', 2) AS instruction, '## ' || split_part(prompt, '##', 3) || CASE property WHEN 'country' THEN '## ' || split_part(prompt, '##', 4) ELSE '' END AS question FROM gp WHERE prompt <> '')"
)
ORACLES = {
    "kg_facts_labels": f"{PER} SELECT qid, property, value, a.labels, b.labels AS value_labels FROM f LEFT JOIN lm a ON a.entity = qid LEFT JOIN lm b ON b.entity = value",
    "kg_link_counts": f"{PER} SELECT entity, n FROM lk",
    "kg_star_entities": STAR.format(with_views("t"), "'SBUILDING', 'SMACHINERY'", "'L0', 'L1'"),
    "kg_count_distinct": f"SELECT count(*) AS n FROM ({STAR.format(with_views('t'), "'SBUILDING', 'SMACHINERY'", "'L0', 'L1'")})",
    "kg_page": STAR.format(with_views("t"), "'SBUILDING'", "'L0'") + " ORDER BY 1 LIMIT 20 OFFSET 10",
    "kg_path_depth2": f"{with_views('t')} SELECT DISTINCT b.o AS root, a.s AS class FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'P279' AND b.p = 'P279' AND b.o IN ('r0', 'r1', 'r2')",
    "kg_union_count": f"{with_views('t')}, x AS (SELECT o AS root, s AS class FROM t WHERE p = 'P279' AND o IN ('r0', 'r1', 'r2') UNION SELECT unnest(['r0', 'r1', 'r2']), unnest(['r0', 'r1', 'r2'])) SELECT root, count(DISTINCT s) AS n FROM x JOIN t ON t.o = x.class AND t.p IN ('P106', 'P27') GROUP BY 1",
    "kg_vocab_union": VOCAB.format(with_views("l")) + " SELECT country_q, lang, kind, value FROM voc",
    "kg_successor_terminals": with_views("e").replace("WITH", "WITH RECURSIVE") + f", {CLOSE} SELECT root, node FROM term",
    "kg_vocab_fallback": VOCAB.format(with_views("l", "e").replace("WITH", "WITH RECURSIVE")) + f", {CLOSE} SELECT country_q, lang, kind, value FROM voc UNION SELECT root, lang, kind, value FROM term JOIN voc ON country_q = node WHERE root NOT IN (SELECT country_q FROM voc WHERE kind = 'demonym')",
    "kg_harvest": f"{PER}, x AS (SELECT DISTINCT s FROM t WHERE p = 'P106' AND o IN ('SHOUSEHOLD', 'SBUILDING') AND s IN (SELECT s FROM t WHERE p = 'P31' AND o = 'Q5') AND s IN (SELECT s FROM t WHERE p = 'P1412' AND o = 'L0')) SELECT s AS entity_id FROM x JOIN lk ON entity = s WHERE n >= 9",
    "kg_harvest_every_language": f"{PER}, x AS (SELECT DISTINCT s FROM t WHERE p = 'P106' AND o IN ('SFURNITURE', 'SAUTOMOBILE') AND s IN (SELECT s FROM t WHERE p = 'P31' AND o = 'Q5') AND s IN (SELECT s FROM t WHERE p = 'P1412')) SELECT s AS entity_id FROM x JOIN lk ON entity = s WHERE n >= 7",
    "kg_sitelinks_of_one": f"{with_views('k')} SELECT DISTINCT site FROM k WHERE entity = 'c1' AND regexp_matches(site, '^https://[a-z-]+\\.wikipedia\\.org/$')",
    "kg_entity_vocabulary": VOCAB.format(with_views("l", "t")) + " SELECT s AS entity_q, " + ", ".join(f"coalesce(string_agg(DISTINCT value, '|' ORDER BY value) FILTER (kind = '{k}'), '') AS {c}" for k, c in (("demonym", "demonyms"), ("alias", "aliases"), ("label", "labels"))) + " FROM t JOIN voc ON country_q = o WHERE p = 'P27' GROUP BY 1",
    "entity_documents": f"{DOCS} SELECT qid, labels, labels_count, c || ':' || coalesce(cn, 0) AS P27, s || ':' || coalesce(sn, 0) AS P106, sitelinks FROM dl",
    "entity_completeness": f"{DOCS} SELECT s AS lang, count(*) AS n_entities, count(*) FILTER (coalesce(sitelinks, 0) >= 9 AND cn = 3) AS P27, count(*) FILTER (coalesce(sitelinks, 0) >= 9 AND sn = 3) AS P106, count(*) FILTER (coalesce(sitelinks, 0) >= 9 AND cn = 3 AND sn = 3) AS complete FROM dl GROUP BY 1",
    "complete_filter": f"{DOCS} SELECT qid FROM dl WHERE coalesce(sitelinks, 0) >= 9 AND cn = 3 AND sn = 3",
    "labels_all_langs": f"{DOCS} SELECT qid, labels_count = 3 AS own, list_contains(langs, 'en') AS en, list_contains(clangs, 'de') AS country_de, coalesce(cn, 0) = 3 AS country_all FROM dl",
    "prompt_grid": f"{GRID} SELECT * FROM gp",
    "prompt_unpivot": f"{GRID} SELECT * FROM smp",
    "chat_messages": f"{GRID}, ly AS (SELECT unnest(['system', 'no_think', 'user', 'typed']) AS layout) SELECT Q_number, LoQ, property, layout, (CASE WHEN layout IN ('system', 'no_think') THEN 2 ELSE 1 END)::INT AS n, CASE layout WHEN 'system' THEN 'system: ' || instruction || ' / user: ' || question WHEN 'no_think' THEN 'system: /no_think / user: ' || instruction || question WHEN 'user' THEN 'user: ' || instruction || question ELSE 'user: [{{\"type\":\"text\",\"text\":\"' || instruction || question || '\"}}]' END AS messages FROM smp CROSS JOIN ly".replace("{{", "{").replace("}}", "}"),
    "split_by_property": f"{GRID} SELECT property, LoQ, count(*) AS n, min(instruction || question) AS first_prompt FROM smp GROUP BY 1, 2",
}
