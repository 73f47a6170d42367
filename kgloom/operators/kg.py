"""Graph patterns over triples (s, p, o) and labels (entity, kind, lang, value).

Patterns are equi-joins; lists of wanted ids, properties and languages are parameters, pushed down to the scan as
filters where they are short. Store triples partitioned by p.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept

#: Fixed value: the sites of Wikipedia's languages.
WIKIPEDIA = r"^https://[a-z-]+\.wikipedia\.org/$"


def facts(triples: DataFrame, labels: DataFrame, ids: DataFrame, properties: list[str], languages: list[str]) -> DataFrame:
    """(qid, property, value, labels, value_labels): all facts of the ids with the labels of entity and value as maps by language.

    Labels are gathered into one map an entity and joined twice, however many languages there are.
    """
    found = triples.where(F.col("p").isin(properties)).join(ids.select(F.col("qid").alias("s")).distinct(), "s")
    of = label_maps(labels, languages)
    return (
        found.join(of.withColumnRenamed("labels", "value_labels"), F.col("o") == F.col("entity"), "left").drop("entity")
        .join(of, F.col("s") == F.col("entity"), "left")
        .select(F.col("s").alias("qid"), F.col("p").alias("property"), F.col("o").alias("value"), "labels", "value_labels")
    )


def label_maps(labels: DataFrame, languages: list[str]) -> DataFrame:
    """(entity, labels): each entity's labels by language; of several in one language the first in order."""
    one = labels.where((F.col("kind") == "label") & F.col("lang").isin(languages)).groupBy("entity", "lang").agg(F.min("value").alias("value"))
    return one.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "value")))).alias("labels"))


def link_counts(links: DataFrame, site: str = WIKIPEDIA) -> DataFrame:
    """(entity, n): links (entity, site) to sites that match, of Wikipedia by default; entities without any are absent."""
    return links.where(F.rlike("site", F.lit(site))).groupBy("entity").agg(F.count("*").alias("n"))


def sitelinks(links: DataFrame, entity: str, site: str = WIKIPEDIA) -> DataFrame:
    """The different sites of one entity."""
    return links.where((F.col("entity") == entity) & F.rlike("site", F.lit(site))).select("site").distinct()


def presence_matrix(entities: DataFrame, triples: DataFrame, properties: dict[str, str]) -> DataFrame:
    """(entity_id, has_<name> 0/1 ...) for every entity; properties: name -> id. One grouped pass, no join for each property."""
    held = triples.where(F.col("p").isin(list(properties.values()))).groupBy(F.col("s").alias("entity_id")).agg(*(F.max(F.when(F.col("p") == p, 1)).alias(f"has_{n}") for n, p in properties.items()))
    return entities.select("entity_id").distinct().join(held, "entity_id", "left").na.fill(0)


def wanted(triples: DataFrame, p: str, of: DataFrame | list[str]) -> DataFrame:
    """(s): subjects whose p is one of a list, or of the first column of a table."""
    held = triples.where(F.col("p") == p)
    if isinstance(of, DataFrame):
        return held.join(of.select(F.col(of.columns[0]).alias("o")).distinct(), "o", "left_semi").select("s")
    return held.where(F.col("o").isin(of)).select("s")


def star(triples: DataFrame, languages: DataFrame | list[str], occupations: DataFrame | list[str], human: str = "Q5", *, instance_of: str = "P31", occupation: str = "P106", language: str = "P1412") -> DataFrame:
    """(entity_id): humans of any of the occupations who use any of the languages."""
    of = lambda p, o: wanted(triples, p, o)
    return of(occupation, occupations).join(of(instance_of, [human]), "s", "left_semi").join(of(language, languages), "s", "left_semi").select(F.col("s").alias("entity_id")).distinct()


def page(ids: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of ids; in order, so that pages don't overlap."""
    return ids.orderBy(*ids.columns).offset(offset).limit(limit)


def subclasses(triples: DataFrame, classes: DataFrame, depth: int, subclass_of: str = "P279") -> DataFrame:
    """(root, class): classes whose chain of ``depth`` steps up ends in a root; walks of that very length."""
    edge = triples.where(F.col("p") == subclass_of).select(F.col("s").alias("_below"), F.col("o").alias("class"))
    at = classes.select(F.col("class").alias("root"), "class").distinct()
    for _ in range(depth):
        at = at.join(edge, "class").select("root", F.col("_below").alias("class")).distinct()
    return at


def expanded(triples: DataFrame, classes: DataFrame, depth: int, subclass_of: str = "P279") -> DataFrame:
    """(root, class): each class itself and its subclasses at the depth."""
    return classes.select(F.col("class").alias("root"), "class").unionByName(subclasses(triples, classes, depth, subclass_of)).distinct()


def count_by_class(triples: DataFrame, classes: DataFrame, depth: int, *, occupation: str = "P106", subclass_of: str = "P279") -> DataFrame:
    """(root, n): different entities of a class or of its subclasses at the depth."""
    has = triples.where(F.col("p") == occupation).select("s", F.col("o").alias("class"))
    return expanded(triples, classes, depth, subclass_of).join(has, "class").groupBy("root").agg(F.countDistinct("s").alias("n"))


def citizenship(triples: DataFrame, property_id: str = "P27") -> DataFrame:
    """(entity_q, country_q)."""
    return triples.where(F.col("p") == property_id).select(F.col("s").alias("entity_q"), F.col("o").alias("country_q")).distinct()


def vocabulary(labels: DataFrame, demonyms: DataFrame, languages: list[str]) -> DataFrame:
    """(country_q, lang, kind, value): demonyms (entity, lang, value), aliases and labels in the languages."""
    kinds = [demonyms.select("entity", F.lit("demonym").alias("kind"), "lang", "value")]
    kinds += [labels.where(F.col("kind") == k).select("entity", "kind", "lang", "value") for k in ("alias", "label")]
    out = reduce(DataFrame.unionByName, kinds).where(F.col("lang").isin(languages))
    return out.select(F.col("entity").alias("country_q"), "lang", "kind", "value").distinct()


def closure(edges: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """(root, node): all nodes that one edge (a, b) or more lead to from a root. Cycles end, as known pairs aren't followed again.

    Each round follows the new pairs only; every round's pairs are written, so that the plan doesn't grow.
    """
    edges = edges.select(F.col("a").alias("node"), F.col("b").alias("_next")).distinct()
    front = roots.select(F.col("node").alias("root"), "node").distinct().join(edges, "node").select("root", F.col("_next").alias("node")).distinct()
    known = front = kept(front)
    for _ in range(most):
        front = kept(front.join(edges, "node").select("root", F.col("_next").alias("node")).distinct().join(known, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return known
        known = kept(known.unionByName(front))
    raise ValueError(f"a path is longer than {most}")


def terminals(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): successors over one edge or more that have no edge of their own.

    Paths are doubled: after k rounds ``reach`` holds the ends within 2 ** k steps of each node and ``jump`` the nodes
    exactly 2 ** k steps on, so rounds grow with the logarithm of the longest chain. On a cycle jumps go on for ever; no
    shortest path has more steps than there are nodes, which bounds the rounds.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    inner = edges.select(F.col("a").alias("b")).distinct()
    jump = kept(edges.join(inner, "b", "left_semi").select("a", "b"))
    reach = kept(edges.join(inner, "b", "left_anti").select("a", F.col("b").alias("end")))
    nodes, steps = inner.count(), 1
    while steps <= nodes and not jump.isEmpty():
        further = jump.join(reach.withColumnRenamed("a", "b"), "b").select("a", "end")
        reach = kept(reach.unionByName(further).distinct())
        jump = kept(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("_next")), "b").select("a", F.col("_next").alias("b")).distinct())
        steps *= 2
    return roots.select(F.col("node").alias("a")).distinct().join(reach, "a").select(F.col("a").alias("root"), F.col("end").alias("node"))


def with_successors(vocab: DataFrame, edges: DataFrame) -> DataFrame:
    """Vocabulary in which a country without a demonym also has that of its terminal successors."""
    bare = vocab.select("country_q").unionByName(edges.select(F.col("a").alias("country_q"))).distinct().join(vocab.where("kind = 'demonym'").select("country_q"), "country_q", "left_anti")
    heirs = terminals(edges, bare.select(F.col("country_q").alias("node")))
    more = heirs.join(vocab.withColumnRenamed("country_q", "node"), "node").select(F.col("root").alias("country_q"), "lang", "kind", "value")
    return vocab.unionByName(more).distinct()


def entity_vocabulary(citizen: DataFrame, vocab: DataFrame) -> DataFrame:
    """(entity_q, demonyms, aliases, labels): sorted sets over all of an entity's countries."""
    words = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value"))))
    return citizen.join(vocab, "country_q").groupBy("entity_q").agg(words("demonym").alias("demonyms"), words("alias").alias("aliases"), words("label").alias("labels"))


def harvest(triples: DataFrame, links: DataFrame, classes: DataFrame, languages: DataFrame | list[str], least_links: int = 9, depth: int = 1) -> DataFrame:
    """(entity_id): the star pattern over the classes and their subclasses, with enough links; one plan, no paging."""
    chosen = star(triples, languages, expanded(triples, classes, depth).select("class"))
    enough = link_counts(links).where(F.col("n") >= least_links).select(F.col("entity").alias("entity_id"))
    return chosen.join(enough, "entity_id", "left_semi")


def merge_facts(parts: DataFrame) -> DataFrame:
    """Partial rows (qid, property, values array) merged by entity and property."""
    return parts.groupBy("qid", "property").agg(F.flatten(F.collect_list("values")).alias("values"))


def bindings(rows: DataFrame, column: str, variables: list[str]) -> DataFrame:
    """SPARQL result bindings (array of maps of structs with a value) as columns; unbound variables are null."""
    b = rows.select(F.explode(column).alias("b"))
    return b.select(*(F.try_element_at("b", F.lit(v))["value"].alias(v) for v in variables))
