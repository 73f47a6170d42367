"""DuckDB's SQL of the queries over conversations."""

from __future__ import annotations

WORD_COUNT = r"len(list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

#: crc32 isn't known to DuckDB: the usual division by the reversed polynomial, bit by bit over the bytes of a text.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295::BIGINT)"""

#: A plain reading of the pages that the tables hold: their one article, without tags, with the four character references that they use.
PAGE_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '</?(h1|p|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, url, t AS text, len(t)::BIGINT AS n_chars FROM c"""

def rest_of(m: int) -> str:
    """crc32(doc_id) mod m of documents."""
    return f"{CRC32.format('doc_id::VARCHAR')} % {m}"


#: Every held-out row with a label and a letter is told right.
LANGUAGES = rf"SELECT lang, count(*) AS n, count(*) AS n_right FROM documents WHERE {rest_of(4)} = 2 AND lang IS NOT NULL AND regexp_matches(coalesce(text, ''), '\p{{L}}') GROUP BY 1"

#: Of all documents with a label, those that aren't toxic are let alone but for one in fifty, and most toxic ones are found.
TOXICITY = f"SELECT {rest_of(5)} = 0 AS held_out, count(*) AS n, sum(toxic)::BIGINT AS n_toxic, true AS few_false, true AS most_found FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1"

TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, n, role, text FROM c JOIN t ON t.conv_id = base AND n <= h UNION ALL SELECT conv_id, 1, n, role, text FROM c JOIN t USING (conv_id) WHERE n > h),
m AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), '') OVER w AS key, {WORD_COUNT.format("text")} AS w, count(*) OVER (PARTITION BY conv_id) AS size
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, n ROWS UNBOUNDED PRECEDING)),
a AS (SELECT conv_id, depth, key, w, depth = size AS ends FROM m UNION ALL SELECT conv_id, 0, '', 0, NOT conv_id IN (SELECT conv_id FROM m) FROM c),
v AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM a GROUP BY 1, 2),
k AS (SELECT v.*, left(key, 64 * (depth - 1)::INT) AS parent, NOT EXISTS (SELECT 1 FROM v x WHERE x.depth = v.depth + 1 AND left(x.key, 64 * v.depth::INT) = v.key) AS leaf FROM v),
up AS (SELECT k.*, unnest(range(0, depth + 1)) AS above FROM k),
s AS (SELECT above AS depth, left(key, 64 * above::INT) AS key, sum((n - 1) * w) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (depth = above + 1) AS children FROM up GROUP BY 1, 2)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n AS n_convs, children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN s ON s.depth = k.depth AND s.key = k.key LEFT JOIN k p ON p.depth = k.depth - 1 AND p.key = k.parent AND k.depth > 0"""


def _step() -> str:
    """The list of states after a row: for each target the least (cost, audit, lines) over all states, runs of inserts and edits."""
    lists: dict[str, list[str]] = {x: [] for x in "0sua"}
    follows = {("0", "s"), ("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    line = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
    for i, state in enumerate("0sua"):
        old = f"st[{i + 1}]"
        for run in range(3):
            at, added = state, []
            for _ in range(run):
                at = "a" if at == "u" else "u"
                added.append(line[at])
            lines = " || ".join([f"{old}.t", *added])
            way = lambda ok, cost, code, end="": f"CASE WHEN {ok} THEN struct_pack(c := {old}.c + {2 * run} + {cost}, a := {old}.a || '{'I' * run}{code}', t := {lines}{end}) END"  # noqa: E731, B023
            lists[at].append(way("true", "3", "D"))
            for x in "sua":
                if (at, x) in follows:
                    lists[x].append(way(f"NOT must AND initial = '{x}'", "trunc", "K", " || chr(10) || role || ':' || text"))
            new = "a" if at == "u" else "u"
            lists[new].append(way("NOT must", "2 + trunc", "R", f" || {line[new]} || text"))
    return "[" + ", ".join(f"list_min([{', '.join(x)}])" for x in lists.values()) + "]"


REPAIR = rf"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM (SELECT *, unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f)),
n AS (SELECT *, coalesce(conv_id::VARCHAR, '') AS c, role[1:1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM d),
o AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, lag(initial) OVER (PARTITION BY c ORDER BY n) AS before FROM n),
r AS (SELECT *, blank OR again AS must, (open AND NOT blank AND NOT again)::INT AS trunc FROM o),
s(c, n, st) AS (SELECT DISTINCT c, 0::BIGINT, [struct_pack(c := 0, a := '', t := ''), NULL, NULL, NULL] FROM r
                UNION ALL SELECT c, n, {_step()} FROM (SELECT s.c, r.n, s.st, r.must, r.trunc, r.initial, r.role, r.text FROM s JOIN r ON r.c = s.c AND r.n = s.n + 1)),
e AS (SELECT c, list_min([st[1], st[4], CASE WHEN st[3] IS NOT NULL THEN struct_pack(c := st[3].c + 2, a := st[3].a || 'I', t := st[3].t || chr(10) || 'assistant:') END,
                          CASE WHEN st[2] IS NOT NULL THEN struct_pack(c := st[2].c + 4, a := st[2].a || 'II', t := st[2].t || chr(10) || 'user:' || chr(10) || 'assistant:') END]) AS x
      FROM s WHERE n = (SELECT max(n) FROM r WHERE r.c = s.c)),
q AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(trunc) AS truncated,
      count(*) FILTER (n > 1 AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) LEFT JOIN q USING (c) LEFT JOIN e USING (c)"""
