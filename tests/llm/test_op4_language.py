import zlib

from kgloom.llm import op4_language as op


def rows_of(prose, n=240):
    langs = ["en", "fr", "de"]
    return [(i, prose.text(prose.r.randint(20, 120), langs[i % 3])) for i in range(n)], (lambda i: langs[i % 3])


def test_held_out_accuracy_and_folds(prose, docs_of):
    rows, lang = rows_of(prose)
    out = op.identify(docs_of(rows, lang=lang)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == lang(r["doc_id"]) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in out)


def test_undetermined_and_foreign_texts(prose, docs_of):
    rows, lang = rows_of(prose)
    odd = [(900, None), (901, ""), (902, "12 34 -- !!"), (903, "слово и ещё много слов здесь " * 5), (904, "the and ing " * 40_000)]
    out = {r["doc_id"]: r for r in op.identify(docs_of(rows + odd, lang=lambda i: lang(i) if i < 900 else "xx" if i == 904 else None)).collect()}
    for i in (900, 901, 902):
        assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"]
    assert out[903]["rejected"] and out[903]["lang_pred"] in ("en", "fr", "de")
    assert out[904]["lang_pred"] == "en"


def test_nothing_labelled_and_empty_table(docs_of, prose):
    assert {r["lang_pred"] for r in op.identify(docs_of([(1, prose.text(30))])).collect()} == {"und"}
    assert op.identify(docs_of([])).collect() == []


def test_probabilities_sum_to_one():
    import numpy as np

    model = op.fit([("a", "banana bandana " * 5), ("b", "cocoa coco nono " * 5)])
    seq = np.array([2, 3], np.uint8)
    total = np.zeros(2)
    for c in range(256):
        total += 2.0 ** model.evaluate(np.append(seq, c).astype(np.uint8))[-1]
    assert np.allclose(total, 1, atol=1e-3)


def test_stage_keeps_columns(spark, prose, docs_of):
    rows, lang = rows_of(prose, 60)
    df = docs_of([*rows, (999, "---")], lang=lang)
    out = op.stage(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(60))


def test_rare_languages_are_told_however_many_there_are(prose, docs_of):
    """Ninety languages, each of syllables of its own, most with a few rows only: none is left out."""
    syllables = [["".join(prose.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(8)] for _ in range(90)]
    words = lambda k, i: " ".join("".join(prose.r.choice(syllables[k]) for _ in range(2)) for _ in range(30)) + f" {i}"
    rows = [(i, words(i % 90, i)) for i in range(900)] + [(2000 + i, prose.text(40)) for i in range(300)]
    lang = lambda i: f"l{i % 90:02}" if i < 900 else "en"
    out = op.identify(docs_of(rows, lang=lang)).collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang(r["doc_id"]) for r in held) >= 0.95 * len(held)


def test_sample_is_bounded_by_bytes(prose, docs_of, monkeypatch):
    monkeypatch.setattr(op, "BYTES", 3000)
    rows, lang = rows_of(prose)
    df = docs_of(rows, lang=lang)
    some = op.sampled(df, op.held_out(df))
    assert {x for x, _ in some} == {"en", "fr", "de"} and sum(len(t.encode()) for _, t in some) <= 3000


def brute(sample, text):
    """Interpolated Kneser-Ney by its formula, with dictionaries: the language of the lowest cross-entropy."""
    import math
    from collections import Counter

    def seq(t):
        out = []
        for c in t.lower() + "\n":
            c = c if c.isalpha() else " "
            if not (c == " " and out and out[-1] == " "):
                out.append(c)
        return out

    best = []
    for lang in sorted({x for x, _ in sample}):
        own = [t for x, t in sample if x == lang]
        own = [t for i, t in enumerate(own) if i % 5 or len(own) < 5]
        s = [c for t in own for c in seq(t)]
        grams = {4: Counter(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))}
        for k in (3, 2, 1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])

        def p(g, grams=grams):
            if not g:
                return 1 / 256
            n = grams[len(g)]
            ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
            d = ones / (ones + 2 * twos) if ones else 0.5
            after = [v for h, v in n.items() if h[:-1] == g[:-1]]
            if not after:
                return p(g[1:])
            return max(n[g] - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

        s = seq(text)
        best.append((-sum(math.log2(p(tuple(s[max(0, i - 3) : i + 1]))) for i in range(len(s))) / len(s), lang))
    return min(best)


def test_entropy_against_brute_force(prose):
    import numpy as np

    sample = [(x, prose.text(30, x)) for x in ("de", "en", "fr") for _ in range(5)]
    model = op.fit(sample)
    ids = model.ids()
    for lang in ("de", "en", "fr"):
        text = prose.text(12, lang)
        raw = text.encode()
        seq, bounds, _ = op.sequences(raw, np.array([0, len(raw)]), ids)
        h = op.entropies(model, seq, bounds)[0]
        want = brute(sample, text)
        assert model.languages[int(h.argmin())] == want[1] == lang and abs(h.min() - want[0]) < 0.25


def test_stage_filters_rows_by_their_own_text(spark, prose, docs_of):
    rows, lang = rows_of(prose, 60)
    df = docs_of([*rows, (1, "---"), (None, "12"), (None, prose.text(30))], lang=lambda i: lang(i) if i is not None else None).withColumns({c: op.F.lit(1) for c in ("_id", "rejected", "held_out", "_n", "_r")})
    out = op.stage(spark, df, "")
    got = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns and sorted(got, key=lambda i: -1 if i is None else i) == [None, *range(60)]


def test_languages_of_large_alphabets_are_told_apart(prose, docs_of):
    """Two languages of 1,500 letters each beside one of few: all their letters count."""
    r = prose.r
    word = lambda k: "".join(chr(0x4E00 + 2 * r.randrange(1500) + k) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word(i % 3) for _ in range(60)) if i % 3 < 2 else prose.text(60)) for i in range(300)]
    lang = lambda i: ("x", "y", "en")[i % 3]
    held = [r for r in op.identify(docs_of(rows, lang=lang)).collect() if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == lang(r["doc_id"]) for r in held) >= 0.95 * len(held)


def test_a_corpus_without_labels_passes_whole(spark, prose, docs_of):
    df = docs_of([(1, prose.text(30)), (2, None), (3, "--")])
    assert op.stage(spark, df, "").count() == 3
    assert not any(r["rejected"] for r in op.identify(df).collect())


def test_a_text_is_of_the_language_around_its_quotations(prose, docs_of):
    """Longer passages of another language inside a text, up to its second and last but one word, don't make it one of that language."""
    rows, lang = rows_of(prose)
    langs = ["en", "fr", "de"]
    quoting = [(1000 + i, " ".join([prose.text(prose.r.randint(6, 30), langs[i % 3]), prose.text(70, langs[(i + 1) % 3]), prose.text(prose.r.randint(6, 30), langs[i % 3])])) for i in range(60)]
    # two passages, and texts of a single word
    quoting += [(1100 + i, " ".join(prose.text(12 if k % 2 == 0 else 40, langs[(i + k % 2) % 3]) for k in range(5))) for i in range(9)]
    true = lambda i: lang(i) if i < 1000 else langs[(i - 1000) % 3] if i < 1100 else langs[(i - 1100) % 3]
    out = op.identify(docs_of([*rows, *quoting], lang=lambda i: lang(i) if i < 1000 else None)).collect()
    told = [r["lang_pred"] == true(r["doc_id"]) for r in out if r["doc_id"] >= 1000]
    assert len(told) == 69 and sum(told) >= 66
    assert all(0 <= r["score"] <= 1 for r in out)


def test_costs_against_every_way_through(prose):
    """All assignments of a short text's words to its language or to a quotation, which costs twice as much at an end."""
    from itertools import groupby, product

    import numpy as np

    sample = [(x, prose.text(40, x)) for x in ("de", "en", "fr") for _ in range(5)]
    model = op.fit(sample)
    parts = ["12 " + prose.text(3, "en") + " " + prose.text(4, "fr") + " " + prose.text(2, "en"), "", prose.text(1, "de"), "?!", prose.text(8, "de")]
    raw = [p.encode() for p in parts]
    seq, bounds, _ = op.sequences(b"".join(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), model.ids())
    logs = model.evaluate(seq)
    at, n = op.windows(seq, bounds)
    assert n.tolist() == [9, 1, 1, 1, 8]
    cost = op.costs(logs, seq, bounds)
    ends = np.append(at, len(seq))
    for i in range(len(parts)):
        a = n[:i].sum()
        part = np.array([logs[ends[k] : ends[k + 1]].sum(0, dtype=np.float64) for k in range(a, a + n[i])])
        loss = part.max(1, keepdims=True) - part
        for k in range(1, n[i]):
            loss[k] *= not np.allclose(part[k], part[k - 1], atol=1e-9)
        for x in range(3):
            price = lambda w: op.QUOTED * (sum(g for g, _ in groupby(w)) + w[0] + w[-1])
            best = min(sum(max(op.STAY, op.STAY_CHARACTER * (ends[a + k + 1] - ends[a + k])) if q else loss[k, x] for k, q in enumerate(w)) + price(w) for w in product((False, True), repeat=int(n[i])))
            assert abs(cost[i, x] - best) < 1e-6


def test_windows_of_long_texts_are_bounded(monkeypatch):
    import numpy as np

    monkeypatch.setattr(op, "WINDOWS", 20)
    seq = np.tile([3, 4, 0], 5000)
    at, n = op.windows(np.concatenate((seq, seq[:60], [0])), np.array([0, 15000, 15060, 15061]))
    assert op.ENDS * 2 < n[0] <= op.ENDS * 2 + 21 and n[1:].tolist() == [20, 1]
    assert at[:3].tolist() == [0, 3, 6] and at[n[0] - 2 : n[0] + 2].tolist() == [14994, 14997, 15000, 15003]
