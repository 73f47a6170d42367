"""Views that lay the operators' input types over the star-schema tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # graded answers
    "g": """SELECT o_orderkey AS k, o_orderpriority AS model, r_name AS LoE, c_mktsegment AS LoQ,
        CASE o_orderstatus WHEN 'F' THEN 'TP' WHEN 'O' THEN 'FP' ELSE 'FN' END AS eval,
        CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' THEN 'no_match' WHEN o_orderkey % 3 = 0 THEN 'exact_match' WHEN o_orderkey % 3 = 1 THEN 'substring_match' ELSE 'historical_match' END AS eval_type,
        CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 2 = 0 THEN 'auto' ELSE 'judge' END AS provenance
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # dates of birth and answers
    "b": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS model, d || 'T00:00:00Z' AS gt,
        CASE (l_orderkey + l_linenumber) % 12 WHEN 0 THEN d WHEN 1 THEN y || '-' || dd || '-' || m WHEN 2 THEN y || '-' || m || '-28' WHEN 3 THEN y || '-12-31'
            WHEN 4 THEN 'born on ' || d || '.' WHEN 5 THEN 'NONE' WHEN 6 THEN ' ' WHEN 7 THEN y WHEN 8 THEN 'YYYY-MM-DD'
            WHEN 9 THEN 'nobody wrote down on which day it was in that year' WHEN 10 THEN CAST(CAST(y AS INT) + l_linenumber * l_linenumber * 5 - 5 AS STRING) || '-' || m || '-' || dd ELSE y || '-11-' || m END AS llm_output
        FROM (SELECT *, substr(d, 1, 4) AS y, substr(d, 6, 2) AS m, substr(d, 9, 2) AS dd FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) a) b""",
    # values by group
    "s": "SELECT lang, doc_id AS qid, n_chars AS sitelinks FROM {documents}",
    # presence: each order has some of six properties
    "p": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS entity_id, l_returnflag || l_linestatus AS p FROM {lineitem}",
    # triples
    "t": """SELECT 'n' || n_nationkey AS s, 'P31' AS p, 'Q5' AS o FROM {nation}
        UNION ALL SELECT 'n' || n_nationkey, 'P131', 'r' || n_regionkey FROM {nation}
        UNION ALL SELECT 'c' || c_custkey, 'P31', 'Q5' FROM {customer} WHERE c_custkey % 4 <> 0
        UNION ALL SELECT 'c' || c_custkey, 'P27', 'n' || c_nationkey FROM {customer}
        UNION ALL SELECT 'c' || c_custkey, 'P1412', 'L' || (c_custkey % 3) FROM {customer}
        UNION ALL SELECT 'c' || c_custkey, 'P106', 'S' || c_mktsegment FROM {customer}
        UNION ALL SELECT 'o' || o_orderkey, 'P170', 'c' || o_custkey FROM {orders}
        UNION ALL SELECT 'c' || c_custkey, 'P279', 'n' || c_nationkey FROM {customer}
        UNION ALL SELECT 'n' || n_nationkey, 'P279', 'r' || n_regionkey FROM {nation}""",
    # successors among the nations: n to 2 n + 1, and a cycle of three
    "e": """SELECT 'n' || n_nationkey AS a, 'n' || (2 * n_nationkey + 1) AS b FROM {nation} WHERE 2 * n_nationkey + 1 < 22
        UNION ALL SELECT 'n' || n_nationkey, 'n' || (CASE n_nationkey WHEN 22 THEN 23 WHEN 23 THEN 24 ELSE 22 END) FROM {nation} WHERE n_nationkey >= 22""",
    # labels of nations, regions and customers; some languages lack some
    "l": """SELECT 'n' || n_nationkey AS entity, 'label' AS kind, lang, n_name || CASE lang WHEN 'en' THEN '' ELSE ' ' || lang END AS value
        FROM {nation}, (SELECT 'en' AS lang UNION ALL SELECT 'fr' UNION ALL SELECT 'de') x WHERE NOT (lang = 'de' AND n_nationkey % 5 = 0)
        UNION ALL SELECT 'n' || n_nationkey, 'alias', 'en', 'Land ' || n_name FROM {nation}
        UNION ALL SELECT 'n' || n_nationkey, 'demonym', 'en', n_name || 'ese' FROM {nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'r' || r_regionkey, 'label', 'en', r_name FROM {region}
        UNION ALL SELECT 'S' || s, 'label', lang, s || ' ' || lang FROM (SELECT DISTINCT c_mktsegment AS s FROM {customer}) y, (SELECT 'en' AS lang UNION ALL SELECT 'fr' UNION ALL SELECT 'de') z
        UNION ALL SELECT 'c' || c_custkey, 'label', 'en', c_name FROM {customer}""",
    # links of customers
    "k": """SELECT 'c' || o_custkey AS entity, CASE o_orderkey % 10 WHEN 0 THEN 'http://' ELSE 'https://' END || translate(CAST(o_orderkey AS STRING), '0123456789', 'abcdefghij') || CASE o_orderkey % 10 WHEN 1 THEN '.wikiquote.org/' ELSE '.wikipedia.org/' END AS site FROM {orders}""",
    # answers on countries
    "a": """SELECT 'c' || c_custkey AS Q_number, 'en' AS LoE, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS LoQ, 'country' AS property,
        '[''' || n_name || ''']' AS gt,
        CASE c_custkey % 9 WHEN 0 THEN '[' || n_name || ']' WHEN 1 THEN 'Land ' || n_name WHEN 2 THEN n_name || 'ese' WHEN 3 THEN 'Old ' || n_name WHEN 4 THEN 'Atlantis' WHEN 5 THEN 'N/A'
            WHEN 6 THEN 'Mu, ' || n_name WHEN 7 THEN '['''']' ELSE 'Lemuria ' || (c_custkey % 4) END AS llm_output,
        c_name AS prompt FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # a table of translations
    "tr": """SELECT 'fr' AS loq, 'Atlantis' AS text, 'Atlantis en' AS en, CAST(1 AS BIGINT) AS pos UNION ALL SELECT 'de', 'Atlantis', 'Atlantis aus', CAST(2 AS BIGINT)
        UNION ALL SELECT 'fr', n_name, '["' || n_name || ' (en)"]', CAST(10 + n_nationkey AS BIGINT) FROM {nation} WHERE n_nationkey % 3 <> 0
        UNION ALL SELECT 'fr', '[' || n_name || ']', n_name || ' en', CAST(100 + n_nationkey AS BIGINT) FROM {nation} WHERE n_nationkey % 3 = 0
        UNION ALL SELECT 'it', 'Lemuria 2', 'Lemuria two', CAST(200 AS BIGINT)""",
    # verdicts
    "v": """SELECT DISTINCT 'Lemuria ' || (c_custkey % 4) AS llm_output, '[''' || n_name || ''']' AS gt_raw,
        CASE c_custkey % 4 WHEN 0 THEN 'historical_match' WHEN 1 THEN 'no_match' WHEN 2 THEN 'nonsense' ELSE 'exact_match' END AS match_type
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 3""",
    # places: suppliers' names resolve to ids, and lie in nations
    "pl": """SELECT lower(s_name) AS name_key, 'Q' || (s_suppkey % 40) AS q, 'n' || s_nationkey AS country FROM {supplier}""",
    # answers on places
    "pa": """SELECT CAST(s_suppkey AS STRING) AS Q_number, 'en' AS LoE, 'en' AS LoQ, '[''' || s_name || ''']' AS gt,
        CASE s_suppkey % 8 WHEN 0 THEN s_name || ', far away' WHEN 1 THEN '"' || s_name || '" (town)' WHEN 2 THEN 'Supplier#00000000' || (s_suppkey % 7) WHEN 3 THEN 'None' WHEN 4 THEN 'Nowhere at all'
            WHEN 5 THEN 'near ' || s_name WHEN 6 THEN 'Supplier#0000000' || (10 + s_suppkey % 60) ELSE '().' END AS llm_output_en FROM {supplier}""",
    # texts that look like answers
    "x": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '  [''' || p_name || ''', ''' || p_type || ''']  ' WHEN 1 THEN p_name || ' (' || p_type || ')' WHEN 2 THEN p_name || ' and more words - ' || p_brand || ' [x]'
        WHEN 3 THEN p_name || '/' || p_type || ', ' || p_brand WHEN 4 THEN '"' || p_name || '"' WHEN 5 THEN '[' || p_type || ']' ELSE '  ' END AS raw FROM {part}""",
}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(used)})


def with_views(*names: str) -> str:
    """WITH clause that defines views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
