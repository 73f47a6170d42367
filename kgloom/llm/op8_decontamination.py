"""Benchmark decontamination by a distributed positional inverted index.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII. Each window of a test item (``width``
consecutive words, or the whole of a shorter item) is sought by its rarest terms: the index stores the postings
(term, document, position) of those terms over the whole corpus; lists adjusted by the terms' offsets are
intersected, rarest first; what is left is compared word by word. Besides these phrases, proximity matches are
counted: items whose rarest terms all occur within ``SPAN`` words of the rarest one, in any order. Only DataFrame operations.

Null texts have no words; an item without words has no window. Rows of one id and different texts are told apart by
their texts, as are rows without an id; equal rows have equal results. Items of one id are one item, with the windows of all its rows;
an item without an id is named by no string, so its hits count as words but not as an item. Ties between terms go by
the term. Empty tables give no hits or an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from .common import cut, few, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts lower-cased words, and a word before lower-casing; as positive sets of letters, which Java matches much faster.
BREAK, RAW_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Rows of a table of test terms or items that may be broadcast, if their texts are few bytes as well; a larger one is joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
#: Rarest terms of an item that make a proximity match, and within how many words of the rarest.
NEAR, SPAN = 3, 25


def words(text: Column) -> Column:
    """Lower-cased words; pure ASCII takes the faster function, which there does the same."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def small(df: DataFrame) -> DataFrame:
    return few(df, MAX_BROADCAST_ROWS)


def identity(docs: DataFrame) -> tuple[Column, Column]:
    """A row's key: its id, or for rows without one a hash of the text; and another hash of the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text, F.lit(8))), F.xxhash64(text)


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """items (item_id, words) -> (item_id, at, len, terms): each window's place and words."""
    n = F.size("words")
    at = items.where(n > 0).select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - width))).alias("at"))
    terms = F.slice("words", F.col("at") + 1, F.least(F.lit(width), F.size("words")))
    return at.select("item_id", "at", F.size(terms).alias("len"), terms.alias("terms"))


def counted(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each test term occurs in the corpus (doc, words); 0 for those that don't.

    An outer explode, whose nulls the join drops: before a plain one Spark filters by the size of the array, and so makes the words twice.
    """
    found = corpus.select(F.explode_outer("words").alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def seeds(window: DataFrame, counts: DataFrame, k: int = 2) -> DataFrame:
    """(item_id, at, r, term, off): each window's k rarest terms with their offsets from the item's start; r is 1 for the rarest."""
    each = window.select("item_id", "at", F.posexplode("terms").alias("off", "term")).join(counts, "term")
    r = F.row_number().over(W.partitionBy("item_id", "at").orderBy("n", "term", "off"))
    return each.withColumn("r", r).where(F.col("r") <= k).select("item_id", "at", "r", "term", (F.col("at") + F.col("off")).alias("off"))


def postings(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc, pos) of all occurrences of the terms; exploded as in ``counted``."""
    return corpus.select("doc", F.posexplode_outer("words").alias("pos", "term")).join(small(terms), "term").select("term", "doc", "pos")


def alignments(index: DataFrame, seed: DataFrame) -> DataFrame:
    """(doc, item_id, start): where item word 0 would stand in a document in which both seeds of some window fit.

    Lists are adjusted by offset and intersected from the rarest term, window by window; a start may be negative.
    """
    of = lambda r, off: seed.where(F.col("r") == r).select("item_id", "at", "term", F.col("off").alias(off))
    placed = lambda r, off: index.join(small(of(r, off).drop("at").distinct()), "term").select("doc", "item_id", (F.col("pos") - F.col(off)).alias("start"), off).distinct()
    both = of(1, "off").drop("term").join(of(2, "off2").drop("term"), ["item_id", "at"], "left").select("item_id", "off", "off2").distinct()
    first = placed(1, "off").join(small(both), ["item_id", "off"])
    paired = first.where("off2 is not null").join(placed(2, "off2"), ["doc", "item_id", "start", "off2"], "left_semi")
    return paired.unionByName(first.where("off2 is null")).select("doc", "item_id", "start").distinct()


def verified(found: DataFrame, corpus: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc, h, item_id, begin, end): runs of document words that occurrences of windows cover, by comparing words.

    corpus (doc, h, words). Each alignment stays a row of its own, compared with the words of its document; only documents with
    alignments are shuffled.
    """
    here = few(cut(found.select(F.col("doc").alias("_doc")).distinct()), 500_000)
    texts = corpus.join(here, F.col("doc") == F.col("_doc"), "left_semi")
    each = found.join(small(items.select("item_id", F.col("words").alias("item"))), "item_id").join(texts, "doc")
    w, item, start, n = F.col("words"), F.col("item"), F.col("start"), F.size("item")
    other = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~(F.get(w, start + i).eqNullSafe(F.get(item, i))))
    # runs of equal words lie between the places where words differ
    between = lambda at: F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.struct((start + F.get(at, k - 1) + 1).alias("begin"), (start + F.get(at, k)).alias("end")))
    runs = F.filter(let(F.concat(F.array(F.lit(-1)), other), between), lambda r: r["end"] - r["begin"] >= F.least(F.lit(width), n))
    return each.select("doc", "h", "item_id", F.explode_outer(runs).alias("r")).where("r is not null").select("doc", "h", "item_id", "r.begin", "r.end")


def covered(runs: Column) -> Column:
    """How many places sorted runs (begin, end) cover."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    add = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], acc["upto"]))).alias("n"), F.greatest(r["end"], acc["upto"]).alias("upto"))
    return F.aggregate(runs, none, add)["n"]


def rarest(items: DataFrame, counts: DataFrame, k: int = NEAR) -> DataFrame:
    """(item_id, r, term, of): each item's k rarest different terms; r is 1 for the rarest, of how many there are."""
    each = items.select("item_id", F.explode(F.array_distinct("words")).alias("term")).distinct().join(counts, "term")
    r = F.row_number().over(W.partitionBy("item_id").orderBy("n", "term"))
    some = each.withColumn("r", r).where(F.col("r") <= k)
    return some.select("item_id", "r", "term", F.max("r").over(W.partitionBy("item_id")).alias("of"))


def proximity(index: DataFrame, terms: DataFrame, span: int = SPAN, k: int = NEAR) -> DataFrame:
    """(doc, item_id): documents in which an item's terms (item_id, r, term, of) all lie within span words of one occurrence of the rarest.

    Lists meet by stretches of ``span`` positions, so no list is paired with a whole other one.
    """
    of = lambda r: index.join(small(terms.where(F.col("r") == r)), "term").select("doc", "item_id", "pos", "of")
    stretch = lambda at: F.floor(at / F.lit(span)).cast("int")
    near = of(1).withColumn("_at", stretch(F.col("pos")))
    for r in range(2, k + 1):
        here = stretch(F.col("pos"))
        other = of(r).select(F.col("doc").alias("_d"), F.col("item_id").alias("_i"), F.col("pos").alias("_p"), F.explode(F.array(here - 1, here, here + 1)).alias("_s"))
        fits = (F.col("doc") == F.col("_d")) & (F.col("item_id") == F.col("_i")) & (F.col("_at") == F.col("_s")) & (F.abs(F.col("pos") - F.col("_p")) <= span)
        near = near.where(F.col("of") >= r).join(other, fits, "left_semi").unionByName(near.where(F.col("of") < r))
    return near.select("doc", "item_id").distinct()


def search(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text), benchmark (item_id, text) -> rows with hits (doc, h, n_hit, n_items, items) and ids with proximity matches (doc, n_near); doc and h as by ``identity``."""
    doc, h = identity(docs)
    corpus = docs.select(doc.alias("doc"), h.alias("h"), words(F.col("text")).alias("words"))
    items = cut(benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).select(F.xxhash64("item_id", "words").alias("item_id"), F.col("item_id").alias("name"), "words").distinct())
    window = cut(windows(items, width))
    counts = cut(counted(corpus, cut(window.select(F.explode("terms").alias("term")).distinct())))
    seed, close = cut(seeds(window, counts)), cut(rarest(items, counts))
    index = cut(postings(corpus, seed.select("term").unionByName(close.select("term")).distinct()))
    runs = verified(cut(alignments(index, seed)), corpus, items, width).join(small(items.select("item_id", "name")), "item_id")
    per = runs.groupBy("doc", "h").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("_runs"), F.sort_array(F.collect_set(F.col("name").cast("string"))).alias("items"))
    near = proximity(index, close).join(small(items.select("item_id", "name")), "item_id").groupBy("doc").agg(F.countDistinct("name").alias("n_near"))
    return per.select("doc", "h", covered(F.col("_runs")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items"), near


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row of docs."""
    doc, h = identity(docs)
    all_docs = docs.select("doc_id", doc.alias("_doc"), h.alias("_h"), F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    found, near = search(docs, benchmark, width)
    found = found.select("doc", "h", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("sha"))
    both = all_docs.join(found, (F.col("_doc") == F.col("doc")) & (F.col("_h") == F.col("h")), "left").drop("doc").join(near, F.col("_doc") == F.col("doc"), "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select("doc_id", "n_words", n("n_hit"), n("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), n("n_near"))


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any hit."""
    found, _ = search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc", "h"), *identity(docs))
