"""Language identification by interpolated Kneser-Ney character models.

One model a language, of letter 4-grams over lower-cased text (all that is no letter is one blank), fitted on a bounded
sample of labelled rows; every language that has any is fitted. The models' grams lie together in one sorted array of hashes for each order, with a column of log
probabilities for each language; contexts likewise with their back-off weights. Languages beyond ``TOGETHER`` have further arrays.

A text may quote others at any length, so it goes to the language that it is written in around what it quotes (``costs``): the one of the least
loss in bits against the best language of each word, where stretches of words may be another's for a price, twice that at the text's beginning or
end, and a small one for each window of words in them. Without such stretches that is the language of the lowest cross-entropy. A text is rejected if its lowest
cross-entropy per character lies above a limit calibrated on rows of the sample that weren't fitted. One text doesn't always tell what is its own and what is quoted,
as when it begins in one language and ends in another; it then goes to the cheaper one.

Letters are told apart by 16 bits each, four to a 64-bit key, so large alphabets keep theirs; beyond the ``ALPHABET`` most frequent of the sample they are one unknown letter.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Without any labelled row there is no model: all are ``und``, and
none is rejected, so that the stage keeps a corpus that nothing can judge.
Repeated rows are each judged; ties go to the first language by name; an empty table gives an empty result; further columns are left
alone. One pass over the rows, without a shuffle; whole texts count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK, chunks, cut, few, texts

ORDER, BITS, ALPHABET, SPREAD = 4, 16, 65_000, np.uint64(0x9E3779B97F4A7C15)
#: The sample: rows of each language, bytes of a row, and bytes of all rows at most, shared out equally among the languages (one row of each in any case).
ROWS, ROW_BYTES, BYTES = 400, 32_768, 64 << 20
#: Languages whose grams share arrays.
TOGETHER = 64
#: Windows of a text: ENDS words one by one at either end, INNER words at once between, more where there would be over WINDOWS.
ENDS, INNER, WINDOWS = 24, 8, 4096
#: Bits that a quotation costs inside a text, and that each window and at least each character of it costs.
QUOTED, STAY, STAY_CHARACTER = 12.0, 1.5, 0.045
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


@dataclass
class Tables:
    """The models of some languages."""

    n: int
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by order - 1: sorted hashes, log2 p by language
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by length: sorted hashes, log2 back-off by language
    least: float = -8.0  # log2 of the share of a character that was never seen


@dataclass
class Model:
    languages: list[str]
    alphabet: dict[int, int]
    #: For each code point 0 if it is no letter, 1 for an unknown letter, else its number; made once, as it takes a while.
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, np.uint16))
    tables: list[Tables] = field(default_factory=list)
    sharpness: float = 1.0
    limit: float = 1e9

    def __post_init__(self):
        self.numbers[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for c, i in self.alphabet.items():
            self.numbers[c] = i

    def ids(self) -> np.ndarray:
        return self.numbers

    def evaluate(self, seq: np.ndarray) -> np.ndarray:
        """log2 p of each place's character after those before it, by language."""
        key = keyed(seq)
        return np.concatenate([looked_up(t, key) for t in self.tables], axis=1)


def keyed(seq: np.ndarray) -> np.ndarray:
    """Each place's last ORDER characters in one number, the last one lowest."""
    key = seq.astype(np.uint64)
    for k in range(1, ORDER):
        key[k:] |= seq[:-k].astype(np.uint64) << np.uint64(BITS * k)
    return key


def low(k: int) -> np.uint64:
    """A mask of k characters."""
    return np.uint64((1 << BITS * k) - 1)


def looked_up(tables: Tables, key: np.ndarray) -> np.ndarray:
    """log2 p of each key's last character by language, from the longest known gram, or a shorter one after backing off."""
    out = np.zeros((len(key), tables.n), np.float32)
    open_ = np.arange(len(key))
    for k in range(ORDER, 0, -1):
        part = key[open_] & low(k)
        hashes, logs = tables.grams[k - 1]
        at, hit = find(hashes, part)
        out[open_[hit]] += logs[at[hit]]
        open_, part = open_[~hit], part[~hit]
        if not len(open_):
            break
        hashes, logs = tables.contexts[k - 1]
        at, hit = find(hashes, part >> np.uint64(BITS))
        out[open_[hit]] += logs[at[hit]]
    out[open_] += np.float32(tables.least)  # every character has this share at least
    return out


def find(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    h = keys * SPREAD
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return at, hashes[at] == h


def sequences(data: bytes, bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character numbers of texts end to end, blanks collapsed; the texts' bounds; whether each has a letter."""
    parts = [data[a:b].decode("utf-8", "replace").lower() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    points = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([len(p) + 1 for p in parts])
    seq = ids[points]
    keep = (seq > 0) | np.append(True, seq[:-1] > 0)
    keep[end - 1] = True
    letters = np.concatenate(([0], np.cumsum(seq > 0)))[np.append(0, end)]
    return seq[keep], np.append(0, np.concatenate(([0], np.cumsum(keep)))[end]), np.diff(letters) > 0


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """sample: (lang, text). Every fifth text of a language is kept for calibration."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    letters: dict[int, int] = {}
    for _, t in sample:
        for c in t.lower():
            if c.isalpha():
                letters[ord(c)] = letters.get(ord(c), 0) + 1
    common = sorted(letters, key=lambda c: (-letters[c], c))[:ALPHABET]
    model = Model(languages, {c: i + 2 for i, c in enumerate(common)})
    ids = model.ids()
    by = {lang: [t for x, t in sample if x == lang] for lang in languages}
    for at in range(0, len(languages), TOGETHER):
        model.tables.append(tabulated([ngrams([t for i, t in enumerate(by[lang]) if i % 5 or len(by[lang]) < 5], ids) for lang in languages[at : at + TOGETHER]], max(256, len(common) + 2)))
    calibrate(model, [(lang, t) for lang in languages for i, t in enumerate(by[lang]) if i % 5 == 0])
    return model


def tabulated(count: list[list[tuple[np.ndarray, np.ndarray]]], letters: int) -> Tables:
    """The models of languages from their counts (``ngrams``) over so many letters: interpolated Kneser-Ney, each language with discounts of its own."""
    tables = Tables(len(count), least=-float(np.log2(letters)))
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([c[k - 1][0] for c in count]))
        ctx = np.unique(keys >> np.uint64(BITS))
        p, back = np.zeros((len(keys), len(count))), np.zeros((len(ctx), len(count)))
        for j, c in enumerate(count):
            own, n = c[k - 1]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            at = np.searchsorted(ctx, own >> np.uint64(BITS))
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
            back[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
            p[np.searchsorted(keys, own), j] = np.maximum(n - discount, 0)
            at = np.searchsorted(ctx, keys >> np.uint64(BITS))
            p[:, j] = p[:, j] / np.maximum(total[at], 1) + back[at, j] * (below[np.searchsorted(lower, keys & low(k - 1)), j] if k > 1 else 1 / letters)
        lower, below = keys, p
        for table, key, value in ((tables.grams, keys, p), (tables.contexts, ctx, back)):
            h = key * SPREAD
            table.append((np.sort(h), np.log2(value[np.argsort(h)]).astype(np.float32)))
    return tables


def ngrams(parts: list[str], ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order - 1: grams and their counts; below the highest order the number of different grams that end so."""
    raw = [p.encode("utf-8", "replace") for p in parts]
    seq, bounds, _ = sequences(b"".join(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(int), ids)
    out = [np.unique(keyed(seq), return_counts=True)]
    for k in range(ORDER - 1, 0, -1):
        out.append(np.unique(out[-1][0] & low(k), return_counts=True))
    return out[::-1]


def entropies(model: Model, seq: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cross-entropy per character of each text by language."""
    return per_character(model.evaluate(seq), seq, bounds)


def per_character(logs: np.ndarray, seq: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return -np.add.reduceat(logs, np.minimum(bounds[:-1], max(len(seq) - 1, 0)), axis=0, dtype=np.float64) / np.maximum(np.diff(bounds), 1)[:, None]


def windows(seq: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of words begin, and how many each text has; leading blanks belong to the first word."""
    word = (seq > 0) & np.append(True, seq[:-1] == 0)
    lead = bounds[:-1][seq[bounds[:-1]] == 0] + 1
    word[lead[lead < len(word)]] = False
    word[bounds[:-1]] = True
    at = np.flatnonzero(word)
    first = np.searchsorted(at, bounds)
    n = np.diff(first)
    k = np.arange(len(at)) - np.repeat(first[:-1], n)
    step = np.maximum(INNER, -(-n // WINDOWS))
    kept = (k < ENDS) | (np.repeat(n, n) - k <= ENDS) | ((k - ENDS) % np.repeat(step, n) == 0)
    return at[kept], np.add.reduceat(kept, first[:-1], dtype=np.int64)


def costs(logs: np.ndarray, seq: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits that each language loses as the one around all quotations: the cheapest way through a text's windows."""
    at, n = windows(seq, bounds)
    loss = np.add.reduceat(logs, at, axis=0, dtype=np.float64)
    again = np.append(False, (loss[1:] == loss[:-1]).all(1))
    again[np.cumsum(n)[:-1]] = False
    loss = np.where(again[:, None], 0, loss.max(1, keepdims=True) - loss)  # a word said again and again tells nothing new
    stay = np.maximum(STAY, STAY_CHARACTER * np.diff(np.append(at, len(seq))))[:, None]
    order = np.argsort(n, kind="stable")
    n, first = n[order], (np.cumsum(n) - n)[order]
    own = loss[first]
    quoted = 2 * QUOTED + np.repeat(stay[first], own.shape[1], 1)
    for i in range(1, n[-1]):  # all texts at once that have so many windows
        a = np.searchsorted(n, i, side="right")
        own[a:], quoted[a:] = np.minimum(own[a:], quoted[a:]) + loss[first[a:] + i], np.minimum(quoted[a:], own[a:] + QUOTED) + stay[first[a:] + i]
    out = np.empty_like(own)
    out[order] = np.minimum(own, quoted + QUOTED)
    return out


def calibrate(model: Model, kept: list[tuple[str, str]]) -> None:
    """The sharpness that makes the right language likeliest, and as limit twice the entropy that one right hit in 200 exceeds."""
    raw = [t.encode("utf-8", "replace") for _, t in kept]
    seq, bounds, ok = sequences(b"".join(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(int), model.ids())
    logs = model.evaluate(seq)
    h, cost = per_character(logs, seq, bounds), costs(logs, seq, bounds)
    truth = np.array([model.languages.index(lang) for lang, _ in kept])
    loss = []
    grid = (0.0625, 0.125, 0.25, 0.5, 1.0)
    for s in grid:
        z = -s * (cost - cost.min(1, keepdims=True))
        loss.append(-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(1)))[ok].sum())
    model.sharpness = grid[int(np.argmin(loss))]
    right = h.min(1)[ok & (h.argmin(1) == truth) & (np.diff(bounds) >= 100)]
    model.limit = 2 * float(np.quantile(right, 0.995)) if len(right) else 1e9


def sampled(docs: DataFrame, held_out) -> list[tuple[str, str]]:
    """The bounded sample of (lang, text): of each language the rows of least hash among about twice as many, up to its share of the bytes."""
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= ROW_BYTES)).select("doc_id", "lang", "text")
    count = cut(labelled.groupBy("lang").agg(F.count("*").alias("_n")))
    languages = count.count()
    if not languages:
        return []
    rank = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(4))
    share = F.least(F.lit(1.0), (2 * ROWS + 20) / F.col("_n"))
    near = labelled.join(few(count, 100_000), "lang").where(F.pmod(rank, F.lit(1_000_003)) < share * 1_000_003)
    up = W.partitionBy("lang").orderBy(rank, "doc_id").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumns({"_r": F.count("*").over(up), "_bytes": F.sum(F.octet_length("text")).over(up)})
    some = near.where((F.col("_r") == 1) | (F.col("_r") <= ROWS) & (F.col("_bytes") <= BYTES // languages))
    return [tuple(x) for x in some.select("lang", "text").orderBy("lang", "_r").collect()]


def held_out(docs: DataFrame) -> Column:
    """Whether a row is kept from the models: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Judge:
    """The models with what telling the language of rows needs; made once in each task."""

    def __init__(self, model: bytes):
        self.model: Model | None = pickle.loads(model)
        self.ids = self.model.ids() if self.model else None
        self.names = np.array([*self.model.languages, "und"] if self.model else ["und"], object)
        self.bytes = CHUNK * 16 // max(16, len(self.names))  # of text at once: each character has a number for each language

    def __call__(self, data: np.ndarray, offsets: np.ndarray, told: bool = True) -> tuple[np.ndarray, ...]:
        """Language, score, entropy and rejection of each text; the first two only if they are to be told."""
        n, m = len(offsets) - 1, self.model
        best, score, h, reject = np.full(n, len(self.names) - 1), np.zeros(n), np.full(n, np.nan), np.full(n, m is not None)
        if m and n:
            seq, at, ok = sequences(data[offsets[0] : offsets[-1]].tobytes(), offsets - offsets[0], self.ids)
            logs = m.evaluate(seq)
            h = np.where(ok, per_character(logs, seq, at).min(1), h)
            reject = ~ok | (h > m.limit * (1 + 10 / np.maximum(np.diff(at), 1)))
            if told:
                cost = costs(logs, seq, at)
                z = np.exp(-m.sharpness * (cost - cost.min(1, keepdims=True)))
                best, score = np.where(ok, cost.argmin(1), best), np.where(ok, 1 / z.sum(1), 0)
        return self.names[best], score, h, reject


def trained(docs: DataFrame):
    """The models of docs (doc_id, text, lang), broadcast as bytes, so that executors needn't have this module."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(sampled(docs, held_out(docs)))))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, entropy, rejected."""
    model = trained(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in chunks(offsets, judge.bytes):
                names, score, h, reject = judge(data, offsets[a : b + 1])
                cols = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("held_out").slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(h, from_pandas=True), pa.array(reject)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text", held_out(docs).alias("held_out")).mapInArrow(rows, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't rejected, whatever their ids; filtered where they are, so that no text is shuffled."""
    model, text = trained(docs), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model.value)
        for batch in batches:
            data, offsets = texts(batch.column(text))
            gone = [judge(data, offsets[a : b + 1], told=False)[3] for a, b in chunks(offsets, judge.bytes)]
            yield batch.filter(pa.array(~np.concatenate(gone) if gone else np.zeros(0, bool)))

    return docs.mapInArrow(rows, docs.schema)
