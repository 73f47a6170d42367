"""Scores of free text against its truth: overlap scores from one linear pass over both texts' words, model scores through a provider.

BLEU is a sentence's geometric mean of clipped n-gram precisions with the brevity penalty and a tiny floor;
ROUGE-L is the F measure (beta 1.2) of the longest common subsequence; METEOR among the overlap scores is its exact-match part, with the penalty
for order as a column beside it, and ``meteor`` the whole: stages of matches (word, stem, synonym) in the alignment of fewest chunks; CIDEr's document frequencies are those of the truths in the frame.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TINY, SMALL = 1e-15, 1e-9


def tokens(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda t: t != "")


def ngrams(t: Column, n: int) -> Column:
    """Joined n-grams of a token array."""
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\x01"))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit of a number for each word of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for y in b:
        hit = free & places.get(y, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def runs(pred: list[str], truth: list[str]) -> int:
    """Stretches of words that stand together in both texts, when each word is matched to its like in order."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(truth):
        places.setdefault(y, []).append(j)
    last, n, used = None, 0, Counter()
    for i, x in enumerate(pred):
        if used[x] < len(places.get(x, ())):
            at = (i, places[x][used[x]])
            n += last is None or at != (last[0] + 1, last[1] + 1)
            last, used[x] = at, used[x] + 1
    return n


MATCHED = ("c1", "c2", "c3", "c4", "l", "runs")


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in MATCHED]))
def matched(pred: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """n-grams of the prediction found in the truth, each as often as that has it at most, for n from 1 to 4; their longest common subsequence; and their runs."""
    out = []
    for p, t in zip(pred, truth, strict=True):
        p, t = list(p), list(t)
        grams = lambda x, n: Counter(zip(*(x[k:] for k in range(n)), strict=False))
        out.append((*((grams(p, n) & grams(t, n)).total() for n in range(1, 5)), common_subsequence(p, t), runs(p, t)))
    return pd.DataFrame(out, columns=list(MATCHED))


def overlap_scores(df: DataFrame, gt: str = "gt", output: str = "llm_output", beta: float = 1.2) -> DataFrame:
    """With Bleu_1 to Bleu_4, ROUGE_L, METEOR (recall weighs nine to one) and METEOR_ordered, less half the cube of runs by matches."""
    p, t, m = F.size("_p"), F.size("_t"), F.col("_m")
    both = df.withColumns({"_p": tokens(output), "_t": tokens(gt)}).withColumn("_m", matched("_p", "_t"))
    logs = [F.log((m[f"c{k}"] + TINY) / (F.greatest(p - (k - 1), F.lit(0)) + SMALL)) for k in range(1, 5)]
    ratio = (p + TINY) / (t + SMALL)
    brief = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    cols = {f"Bleu_{n}": F.exp(sum(logs[1:n], logs[0]) / n) * brief for n in range(1, 5)}
    prec, rec = m["l"] / p, m["l"] / t
    cols["ROUGE_L"] = F.when(m["l"] > 0, (1 + beta**2) * prec * rec / (rec + beta**2 * prec)).otherwise(0.0)
    prec, rec = m["c1"] / p, m["c1"] / t
    cols["METEOR"] = F.when(m["c1"] > 0, 10 * prec * rec / (rec + 9 * prec)).otherwise(0.0)
    out = both.withColumns(cols)
    return out.withColumn("METEOR_ordered", F.when(m["c1"] > 0, F.col("METEOR") * (1 - 0.5 * F.pow(m["runs"] / m["c1"], F.lit(3)))).otherwise(0.0)).drop("_p", "_t", "_m")


def cider(df: DataFrame, key: str, gt: str = "gt", output: str = "llm_output", sigma: float = 6.0) -> DataFrame:
    """(key, CIDEr): TF-IDF cosine of 1- to 4-grams, clipped, with a Gaussian penalty for length; document frequencies from all truths."""
    each = None
    for n in range(1, 5):
        part = df.select(key, F.lit(n).alias("n"), ngrams(tokens(gt), n).alias("t"), ngrams(tokens(output), n).alias("p"), (F.size(tokens(output)) - F.size(tokens(gt))).alias("d"))
        each = part if each is None else each.unionByName(part)
    side = lambda c: each.select(key, "n", F.explode(c).alias("g")).groupBy(key, "n", "g").agg(F.count("*").alias(f"tf_{c}"))
    total = df.agg(F.log(F.greatest(F.lit(1.0), F.count("*").cast("double"))).alias("_all"))
    idf = side("t").groupBy("n", "g").agg(F.count("*").alias("df"))
    both = side("t").join(side("p"), [key, "n", "g"], "full").na.fill(0).join(idf, ["n", "g"], "left").join(F.broadcast(total))
    w = F.col("_all") - F.log(F.greatest(F.lit(1.0), F.coalesce("df", F.lit(0)).cast("double")))
    both = both.withColumns({"a": F.col("tf_t") * w, "b": F.col("tf_p") * w})
    dot = both.groupBy(key, "n").agg(F.sum(F.least("a", "b") * F.col("a")).alias("s"), F.sqrt(F.sum(F.col("a") ** 2)).alias("x"), F.sqrt(F.sum(F.col("b") ** 2)).alias("y"))
    cos = F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("s") / (F.col("x") * F.col("y"))).otherwise(0.0)
    score = dot.groupBy(key).agg((F.sum(cos) / 4).alias("_c"))
    length = df.select(key, F.exp(-((F.size(tokens(output)) - F.size(tokens(gt))) ** 2) / (2 * sigma**2)).alias("_g"))
    return length.join(score, key, "left").select(key, (10 * F.coalesce("_c", F.lit(0.0)) * F.col("_g")).alias("CIDEr"))


def s_stem(word: str) -> str:
    """A word without the ending of an English plural (the three rules of the S-stemmer)."""
    w = word.lower()
    if w.endswith("ies") and not w.endswith(("eies", "aies")):
        return w[:-3] + "y"
    if w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
        return w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) else w


#: What a match of each stage is worth: the same word, the same stem, words of a synonym set.
STAGES = {"exact": 1.0, "stem": 0.6, "synonym": 0.8}


def alignment(pred: list[str], truth: list[str], kinds: list[tuple[float, Callable[[str], frozenset]]], beam: int = 40) -> tuple[int, float, int]:
    """(matches, their worth, chunks) of the alignment of most words, of those of the fewest chunks, of those of most worth.

    kinds: worth and keys of a word; words match by the first kind in which they share a key. Partial alignments that leave the same truth words for what
    follows, and end alike, are one; of the others the best ``beam`` go on, so the result is exact unless more are alike.
    """
    worth: list[dict[int, float]] = [{} for _ in pred]
    for value, keys in kinds:
        places: dict = {}
        for j, y in enumerate(truth):
            for k in keys(y):
                places.setdefault(k, []).append(j)
        for i, x in enumerate(pred):
            for k in keys(x):
                for j in places.get(k, ()):
                    worth[i].setdefault(j, value)
    later, ahead = [0] * (len(pred) + 1), 0
    for i in range(len(pred) - 1, -1, -1):
        for j in worth[i]:
            ahead |= 1 << j
        later[i] = ahead
    states = {(0, -2): (0, 0, 0.0)}  # used truth words that still matter, the last match if it stands right before -> -matches, chunks, -worth
    for i, ways in enumerate(worth):
        found: dict = {}
        for (used, last), (m, chunks, w) in states.items():
            options = [(used & later[i + 1], -2, m, chunks, w)]
            options += [((used | 1 << j) & later[i + 1], j, m - 1, chunks + (j != last + 1), w - v) for j, v in ways.items() if not used >> j & 1]
            for mask, at, *score_ in options:
                score_ = tuple(score_)
                if (mask, at) not in found or score_ < found[mask, at]:
                    found[mask, at] = score_
        states = dict(sorted(found.items(), key=lambda x: (x[1], x[0]))[:beam])
    m, chunks, w = min(states.values())
    return -m, -w, chunks


def meteor(df: DataFrame, gt: str = "gt", output: str = "llm_output", stages: tuple[str, ...] = ("exact", "stem", "synonym"), stem: Callable[[str], str] = s_stem, synonyms: DataFrame | None = None, most: int = 200_000) -> DataFrame:
    """With METEOR_full: words matched by stages in the alignment of fewest chunks; recall weighs nine to one, less half the cube of chunks by matches.

    synonyms: (word, synset), at most ``most`` rows, which are counted, as every task holds them.
    """
    sets: dict[str, set] = {}
    if synonyms is not None and "synonym" in stages:
        if synonyms.count() > most:
            raise ValueError(f"more than {most} synonyms")
        for word, synset in synonyms.select("word", F.col("synset").cast("string")).collect():
            sets.setdefault(word, set()).add(synset)
    keys = {"exact": lambda x: frozenset([x]), "stem": lambda x: frozenset([stem(x)]), "synonym": lambda x: frozenset(sets.get(x, ()))}
    kinds = [(STAGES[s], keys[s]) for s in stages]

    @F.pandas_udf("matches int, worth double, chunks int")
    def aligned(pred: pd.Series, truth: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([alignment(list(p), list(t), kinds) for p, t in zip(pred, truth, strict=True)], columns=["matches", "worth", "chunks"])

    both = df.withColumns({"_p": tokens(output), "_t": tokens(gt)}).withColumn("_m", aligned("_p", "_t"))
    prec, rec, m = F.col("_m.worth") / F.size("_p"), F.col("_m.worth") / F.size("_t"), F.col("_m.matches")
    full = F.when(m > 0, 10 * prec * rec / (rec + 9 * prec) * (1 - 0.5 * F.pow(F.col("_m.chunks") / m, F.lit(3)))).otherwise(0.0)
    return both.withColumn("METEOR_full", full).drop("_p", "_t", "_m")


def bert_score(truth: DataFrame, output: DataFrame, weighted: bool = False, block: int = 256) -> DataFrame:
    """truth and output (key, pos, token, vector) -> (key, precision, recall, f1): each token against the likest of the other side by cosine.

    With ``weighted``, tokens weigh by the inverse document frequency over all truths, log((n + 1) / (df + 1)). Tokens of a key
    are compared in blocks, a matrix product for each pair of blocks, so that long texts take more tasks, not more memory. A
    key with no tokens on one side scores 0; vectors of length 0 are like none.
    """

    def blocks(side: DataFrame, name: str) -> DataFrame:
        at = F.array_sort(F.collect_list(F.struct("pos", F.col("vector").cast("array<double>").alias("vector"))))
        return side.groupBy("key", F.floor(F.col("pos") / block).alias(f"{name}_block")).agg(at.alias("_at")).select("key", F.col("_at.pos").alias(f"{name}_pos"), F.col("_at.vector").alias(name))

    def unit(vectors) -> np.ndarray:
        x = np.array([np.asarray(v, float) for v in vectors])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def likest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                like = unit(r.t) @ unit(r.o).T
                n, m = like.shape
                yield pd.DataFrame({"key": [r.key] * (n + m), "side": ["t"] * n + ["o"] * m, "pos": [*r.t_pos, *r.o_pos], "like": np.concatenate([like.max(1), like.max(0)])})

    kind = dict(truth.dtypes)["key"]
    best = blocks(truth, "t").join(blocks(output, "o"), "key").mapInPandas(likest, f"key {kind}, side string, pos long, like double")
    best = best.groupBy("key", "side", "pos").agg(F.max("like").alias("like"))
    each = truth.select("key", F.lit("t").alias("side"), F.col("pos").cast("long").alias("pos"), "token").unionByName(output.select("key", F.lit("o").alias("side"), F.col("pos").cast("long").alias("pos"), "token"))
    weight = F.lit(1.0)
    if weighted:
        n = truth.agg(F.countDistinct("key").alias("_n"))
        df = truth.groupBy("token").agg(F.countDistinct("key").alias("_df"))
        each = each.join(df, "token", "left").join(F.broadcast(n))
        weight = F.log((F.col("_n") + 1) / (F.coalesce("_df", F.lit(0)) + 1))
    each = each.withColumn("_w", weight).join(best, ["key", "side", "pos"], "left")
    share = lambda side: F.coalesce(F.try_divide(F.sum(F.when(F.col("side") == side, F.col("_w") * F.coalesce("like", F.lit(0.0)))), F.sum(F.when(F.col("side") == side, F.col("_w")))), F.lit(0.0))
    both = each.groupBy("key").agg(share("o").alias("precision"), share("t").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


#: Metric by name; model scores are added with register(name, function of a DataFrame).
METRICS: dict[str, Callable[..., DataFrame]] = {"overlap": overlap_scores, "meteor": meteor}


def register(name: str, scorer: Callable[..., DataFrame]) -> None:
    METRICS[name] = scorer


def score(df: DataFrame, metric: str, **how) -> DataFrame:
    """df with the metric's columns; frames without truth or output are an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {sorted(METRICS)}")
    missing = {how.get("gt", "gt"), how.get("output", "llm_output")} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return METRICS[metric](df, **how)
