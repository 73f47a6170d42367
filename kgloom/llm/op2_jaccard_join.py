"""N-gram Jaccard join by prefixes of token combinations, and the components of its links.

Tokens are hashes of ``width``-word shingles. Two documents whose sets have Jaccard similarity t or more share all but
miss(x) = |x| - ceil(t |x|) tokens of either. In one order of all tokens (rarest first), each document's prefix is
extended until, over its token classes, sum(max(0, n - (k - 1))) > miss(x): n of its prefix tokens are of a class
that is indexed by combinations of k. Then the two share at least one entry of the index. Classes: rare tokens singly (k = 1); frequent
tokens by pairs (k = 2) inside subclasses, so many of them (in proportion to the document's size) that the
pairs of a document grow in proportion to its tokens. Tokens that occur once fill the prefix but need no entry.

Document frequencies are counted over all documents on a fixed share of the hash space, which comes first in the
order, and on all tokens of those documents whose prefix might not fit into that share. Equal sets are one class from the start. In each
entry of the index, the least document is compared with all others (a star, not all pairs); what these links don't
connect is compared next, but for pairs that bounds rule out, taken from sizes, from what both share with that document and
from tokens that none of the others has. All
comparisons are exact on the whole sets. No link between different sets is lost: pairs left out are either connected already or
not similar.

Null or empty texts have no tokens, component themselves and link with nothing; rows with null ids link with nothing either and have
no component; rows of one id must hold one text (with several, each row counts its own shingles and shares one component). Ties of
frequency go by the token. Empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, Hasher, chunks, components, cut, few, mix, texts, without, words

#: The query's words a shingle and least similarity in percent; those of the pipeline's stage.
WIDTH, PERCENT = 4, 85
STAGE_WIDTH, STAGE_PERCENT = 5, 80
#: Tokens in more documents than this are frequent. Tokens of a document for each subclass of frequent ones.
RARE, SUBCLASS = 8, 32
#: Parts of what a document shares with a pivot, in which pairs are sought.
PARTS = 16
#: Tasks forget the sets they have seen after so many.
SEEN = 1 << 17
SETS = "doc long, n long, inside long, s1 long, s2 long"
TOKENS = "token long, doc long"


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, end to end, and the texts' bounds in them."""
    start, end, first = words(data, offsets)
    h = Hasher(data, lower=True).of(start, end)
    n = len(h)
    docs = len(offsets) - 1
    count = np.diff(first)
    of = np.repeat(np.arange(docs), count)
    key = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        key = mix(key + h[k : n - width + 1 + k] * np.uint64(2 * k + 0x9E3779B97F4A7C15 | 1)) if len(key) else key
    whole = np.flatnonzero(of[: len(key)] == of[width - 1 :]) if len(key) else np.zeros(0, np.int64)
    key, owner = key[whole], of[whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        one = np.full(len(short), 0x51ED270B, np.uint64) + count[short].astype(np.uint64)
        for k in range(width - 1):
            more = k < count[short]
            one[more] = mix(one[more] * np.uint64(0xD6E8FEB86659FD93) + h[first[short[more]] + k])
        key, owner = np.concatenate((key, one)), np.concatenate((owner, short))
    by = np.lexsort((key, owner))
    key, owner = key[by], owner[by]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)]
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(docs + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def of_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, tokens, bounds) for some rows at a time."""
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in chunks(offsets):
            off = offsets[a : b + 1]
            yield ids[a:b], *shingles(data[off[0] : off[-1]], off - off[0], width)


def frame(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[f.split()[0] for f in schema.split(", ")])


def misses(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100)


def subclasses(n: int, percent: int = PERCENT) -> set[int]:
    """Numbers of subclasses by which a document of n tokens is indexed: those of all sizes that a partner may have."""
    of = lambda m: 1 << max(0, int(m // SUBCLASS).bit_length() - 1)
    low, high = of(-(-percent * n // 100)), of(100 * n // percent)
    return {g for g in (low, 2 * low, 4 * low) if low <= g <= high}


def fits(n: np.ndarray, inside: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the share holds a prefix of each document in any case: each subclass can cost a token."""
    return inside - n / (SUBCLASS * percent / 100) - 1 >= n - np.ceil(percent * n / 100 - 1e-9) + 1


def top(percent: int) -> np.uint64:
    """The end of the share of the hash space whose tokens come first in the order: about twice what may be missing, as a prefix takes half of that."""
    return np.uint64((200 - 2 * percent) * 2**64 // 100) if percent > 50 else np.uint64(2**64 - 1)


def within(token: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(token < top(percent))))
    return total[at[1:]] - total[at[:-1]]


def token_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Counted tokens of each document; of equal sets in one task, the first only (this bears on frequencies alone, as only representatives are indexed, the least ids)."""
    seen: dict[tuple[int, int], int] = {}
    for ids, token, at in of_batches(batches, width):
        size = np.diff(at)
        new = np.ones(len(ids), bool)
        for i, s in enumerate(zip(size.tolist(), sums(mix(token + np.uint64(1)), at).tolist(), strict=True)):
            new[i] = seen.setdefault(s, ids[i]) >= ids[i]
            seen[s] = min(seen[s], ids[i])
        owner = np.repeat(np.arange(len(ids)), size)
        take = new[owner] & ((token < top(percent)) | ~fits(size, within(token, at, percent), percent)[owner])
        if len(seen) > SEEN:
            seen.clear()
        yield frame(TOKENS, token[take].view(np.int64), ids[owner[take]])


def entries(n: int, inside: int, token: np.ndarray, often: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index entries of a document of n tokens, ``inside`` of them in the share; token and often: the counted ones in 2 documents or more."""
    first = token < top(percent)
    beyond, token, often = token[~first], token[first], often[first]
    by = np.lexsort((token, np.where(often <= RARE, 0, np.frexp(often)[1])))
    token, often = token[by], often[by]
    need = misses(n, percent) + 1 - (inside - len(token))  # what tokens of this document alone leave open
    if need <= 0:
        return np.zeros(0, np.uint64)
    rare, frequent = token[often <= RARE][:need], token[often > RARE]
    need -= len(rare)
    if need <= 0:
        return rare
    out = [rare]
    for g in subclasses(n, percent):
        sub = mix(frequent) % np.uint64(g)
        order = np.argsort(sub, kind="stable")
        more = np.zeros(len(sub), bool)  # each token of a subclass but the first adds one
        more[order[1:]] = sub[order][1:] == sub[order][:-1]
        upto = int(np.searchsorted(np.cumsum(more), need)) + 1
        if upto > len(frequent):  # the prefix goes on beyond the share: there all tokens singly
            out.append(beyond)
        some, sub = frequent[:upto], sub[:upto]
        for s in np.unique(sub):
            x = np.sort(some[sub == s])
            i, j = np.triu_indices(len(x), 1)
            out.append(mix(x[i] * np.uint64(3) + mix(x[j] + np.uint64(g))))
    return np.unique(np.concatenate(out))


def entry_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "n", "inside"))
        lists = batch.column("tokens")
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        flat = lists.flatten()
        token, often = flat.field("token").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("often").to_numpy(zero_copy_only=False)
        held, size = [], 0
        for i in range(len(ids)):
            e = entries(int(n[i]), int(inside[i]), token[at[i] : at[i + 1]], often[at[i] : at[i + 1]], percent)
            held.append((i, e))
            size += len(e)
            if size >= CHUNK or i + 1 == len(ids):
                rows = np.repeat([k for k, _ in held], [len(x) for _, x in held]).astype(np.int64)
                yield frame("entry long, doc long, n long", np.concatenate([x for _, x in held]).view(np.int64), ids[rows], n[rows])
                held, size = [], 0


def packed_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for ids, token, at in of_batches(batches, width):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([token[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc", "tokens"])


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection of two packed sets."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            out.append((len(x), len(y), int((both[1:] == both[:-1]).sum())))
        nx, ny, both = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [])))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both), pa.array(nx + ny - both)], names=["a", "b", "shared", "united"])


def token_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc) of packed sets."""
    for batch in batches:
        for doc, raw in zip(batch.column("doc").to_pylist(), batch.column("tokens"), strict=True):
            token = np.frombuffer(raw.as_buffer(), np.int64)
            yield frame(TOKENS, token, np.full(len(token), doc))


def packed(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, tokens): whole sets of some documents, each one binary value. Up to half a million ids are broadcast, so that texts aren't shuffled."""
    wanted = few(cut(ids.select(F.col("doc").alias("doc_id")).distinct()), 500_000)
    return cut(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(partial(packed_sets, width=width), "doc long, tokens binary"), rebalance=False, free=True)


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, shared, united: exact sizes of intersection and union."""
    both = pairs.join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b").join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
    return cut(both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, shared long, united long"), free=True)


def enough(shared, n, m, percent: int):
    """Whether so many shared tokens make documents of n and m tokens similar."""
    return shared * 100 >= (n + m - shared) * percent


def band(n):
    """Sizes within 2 % or so, by number."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.02)))


def remaining(star: DataFrame, first: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that share a pivot, aren't connected yet and may be similar.

    Two documents that share an index entry share its pivot. o is what a document shares with the pivot, u how many of
    its tokens no other document here has. Neither these nor more than the lesser o can be shared, so a pair shares
    min(o) + min(n - o - u) tokens at most. As a document shares n - u at most, it can only be similar to
    documents of up to ``most`` tokens; and as similar documents share the percentage of the larger one at least, the smaller one's o reaches
    that less the larger one's n - o - u. So pairs are sought inside bands of sizes and parts of o, and only where these hold
    several components: a cluster that is connected already, beside the pivot's, is never paired with itself.
    """
    got = first.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), F.col("shared").alias("o"))
    label = star.join(comp, F.col("doc") == F.col("id"), "left").select("pivot", "doc", "n", F.coalesce("component_id", "doc").alias("c"))
    open_ = label.groupBy("pivot").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi").select("pivot")
    rest = cut(label.join(open_, "pivot").join(got, ["pivot", "doc"], "left"))
    here = rest.select(F.explode(F.array("doc", "pivot")).alias("doc")).distinct()
    lone = sets.join(here, "doc").mapInArrow(token_pairs, TOKENS).groupBy("token").agg(F.count("*").alias("_k"), F.min("doc").alias("doc")).where("_k = 1").groupBy("doc").agg(F.count("*").alias("u"))
    rest = rest.join(lone, "doc", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    rest = cut(rest.withColumn("most", F.floor((F.col("n") - F.col("u")) * (100 + percent) / percent) - F.col("n")))
    up_to, n = F.least("most", "n"), F.col("n")
    least = F.ceil(n * percent / 100)
    # parts of o in the size; -1 for documents that weren't compared with the pivot, which may go with any
    part = lambda o: F.floor(o * PARTS / n).cast("int")
    small = rest.where("most >= n").withColumns({"band": band(n), "part": F.coalesce(part(F.col("o")), F.lit(-1))})
    parts = F.sequence(F.coalesce(part(F.greatest(F.lit(0), F.floor(n * percent / 100) - (n - F.col("o") - F.col("u")))), F.lit(0)), F.lit(PARTS))
    large = rest.where(up_to >= least).withColumn("band", F.explode(F.sequence(band(F.greatest(F.lit(1), least)), band(up_to)))).withColumn("part", F.explode(F.array_append(parts, -1)))
    key = ["pivot", "band", "part"]
    mixed = small.select(*key, "c").unionByName(large.select(*key, "c")).groupBy(*key).agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi").select(*key)
    large = large.select(*key, *(F.col(c).alias("_" + c) for c in ("doc", "n", "c", "o", "u", "most")))
    inside = F.least("o", "_o") + F.least(F.col("n") - F.col("o") - F.col("u"), F.col("_n") - F.col("_o") - F.col("_u"))
    bound = F.when(F.col("o").isNotNull() & F.col("_o").isNotNull(), inside).otherwise(F.least(F.col("n") - F.col("u"), F.col("_n") - F.col("_u")))
    fits_ = (F.col("c") != F.col("_c")) & (F.col("n") <= F.least("_most", "_n")) & (F.col("_n") <= F.col("most"))
    small = cut(small.join(mixed, key))
    pairs = small.join(large, key).where(fits_ & enough(bound, F.col("n"), F.col("_n"), percent))
    return pairs.select(F.least("doc", "_doc").alias("a"), F.greatest("doc", "_doc").alias("b")).distinct()


def index(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(entry, doc, n): the index over the representatives of all sets."""
    tokens = docs.select("doc_id", "text").mapInArrow(partial(token_rows, width=width, percent=percent), TOKENS)
    often = cut(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), free=True)
    shared = tokens.join(often, "token").groupBy("doc").agg(F.collect_list(F.struct("token", "often")).alias("tokens"))
    rep = sets.where("doc = rep and n > 0").select("doc", "n", "inside").distinct()
    return rep.join(shared, "doc").mapInArrow(partial(entry_rows, percent=percent), "entry long, doc long, n long")


def set_rows(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Each document's tokens, how many of them lie in the share, and two sums that tell its set."""
    for ids, token, at in of_batches(batches, width):
        s1, s2 = sums(mix(token + np.uint64(1)), at), sums(mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
        yield frame(SETS, ids, np.diff(at), within(token, at, percent), s1.view(np.int64), s2.view(np.int64))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc, n, rep, ...) with each set's representative, its least id; links (a, b, shared, united) that connect all that is linked; components (id, component_id) of those."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = cut(docs.mapInArrow(partial(set_rows, width=width, percent=percent), SETS))
    least = cut(own.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    sets = cut(own.join(least, ["n", "s1", "s2"], "left").select("doc", "n", "inside", F.coalesce("rep", "doc").alias("rep")))
    entry = cut(index(docs, sets, width, percent), rebalance=False, free=True)
    pivot = entry.groupBy("entry").agg(F.min(F.struct("doc", "n")).alias("_p"), F.count("*").alias("_n")).where("_n > 1").select("entry", F.col("_p.doc").alias("pivot"), F.col("_p.n").alias("_pn"))
    star = cut(entry.join(pivot, "entry").where("doc != pivot").select("pivot", "_pn", "doc", "n").distinct())
    small, large = F.least("n", "_pn"), F.greatest("n", "_pn")
    whole = packed(docs, star.select(F.explode(F.array("pivot", "doc")).alias("doc")), width)
    first = compare(star.where(enough(small, small, large, percent)).select(F.col("pivot").alias("a"), F.col("doc").alias("b")), whole)
    similar = F.col("shared") * 100 >= F.col("united") * percent
    link = first.where(similar)
    comp = components(link)
    second = compare(cut(remaining(star, first, comp, whole, percent)), whole).where(similar)
    links = link.unionByName(second)
    return sets, links, comp if second.isEmpty() else components(links)


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, one row for each row of docs."""
    sets, _, comp = join(docs, width, percent)
    bare = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(partial(set_rows, width=width, percent=percent), SETS)
    bare = bare.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return bare.unionByName(sets.join(comp, F.col("rep") == F.col("id"), "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the least id; rows without an id stay."""
    return without(docs, classes(docs, STAGE_WIDTH, STAGE_PERCENT).where("doc_id != component_id").select("doc_id"))
