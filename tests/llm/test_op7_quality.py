import random
import re

import pytest

from kgloom.llm import op7_quality as op


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    rep = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_base_against_brute_force(prose, docs_of):
    line = prose.text(12).replace("\n", " ")
    texts = [None, "", " ", "a", "ab\n\ncd\nab", line + "\n" + line + "\n \n\n" + prose.text(60), "ü # * é " * 9, "x y z " * 50, "\n".join([line] * 7), "a b c d e a b c d e", "a\u00a0b c", prose.text(300), "nul\x00byte " * 3]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    for r in op.judge(docs_of(rows)).collect():
        assert tuple(r)[1:7] == brute(texts[r["doc_id"] % len(texts)]), r


@pytest.mark.parametrize("size", [40, 150, 700, 5000])
def test_clean_prose_is_kept(prose, docs_of, size):
    out = op.judge(docs_of([(i, prose.text(size)) for i in range(5)])).collect()
    assert all(r["kept"] for r in out)


def test_bands_reject_repetitive_and_incompressible(prose, docs_of):
    r = random.Random(1)
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=-_.,:;!?") for _ in range(60)) for _ in range(300))
    lines = "".join(f"item number {i % 10} of the list with the very same words in other places {i}\n" for i in range(2000))
    half = prose.text(1500) + noise
    out = {x["doc_id"]: x for x in op.judge(docs_of([(1, noise), (2, lines), (3, half)])).collect()}
    assert not out[1]["kept"] and not out[1]["base_failed"] and out[1]["ratio"] < 1.4
    assert not out[2]["kept"]
    assert not out[3]["kept"] and out[3]["n_chunks_out"] > 0


def test_empty_table_and_long_text(prose, docs_of):
    assert op.judge(docs_of([])).collect() == []
    out = op.judge(docs_of([(1, prose.text(40_000))])).first()
    assert out["n_words"] == 40_000 and out["kept"]


def base64(r, n, width=60):
    text = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(width)) for _ in range(n // width + 1))
    return text[:n]


def test_short_base64_is_rejected(prose, docs_of):
    rows = [(i, base64(prose.r, size, width)) for i, (size, width) in enumerate((n, w) for n in (260, 400, 500, 700, 1000, 1023, 1500, 2047, 3000, 4000) for w in (8, 20, 60) if n >= 11 * w)]
    out = op.judge(docs_of(rows)).collect()
    assert not any(r["kept"] or r["base_failed"] for r in out)


def test_every_byte_lies_in_a_chunk(prose, docs_of):
    assert [op.spans(n) for n in (4095, 4096, 4351, 4352, 9000)] == [[], [(0, 4096)], [(0, 4351)], [(0, 4096), (4096, 4352)], [(0, 4096), (4096, 8192), (8192, 9000)]]
    text = prose.text(4000)
    rows = [(1, text[:4096] + base64(prose.r, 4000)), (2, text[:8192] + base64(prose.r, 4096)), (3, text[:8192] + base64(prose.r, 600)), (4, text[:8192])]
    out = {r["doc_id"]: (r["kept"], r["base_failed"], r["n_chunks"], r["n_chunks_out"]) for r in op.judge(docs_of(rows)).collect()}
    assert out == {1: (False, False, 2, 1), 2: (False, False, 3, 1), 3: (False, False, 3, 1), 4: (True, False, 2, 0)}


def test_fitted_limits_are_those_of_the_corpus(prose, docs_of):
    """Words with a random symbol behind each compress better than prose, by less than the fixed bands tell; so do shouted repeats."""
    odd = lambda n: " ".join(w + prose.r.choice(["###", "***", "%%%", "$$$"]) for w in prose.words(n))
    rows = [(i, prose.text(prose.r.randint(300, 400))) for i in range(400)] + [(1000 + i, odd(250)) for i in range(20)]
    with_fit = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in op.judge(docs_of(rows)).collect()}
    without = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in op.judge(docs_of(rows), least=10**9).collect()}
    assert all(without[i] == (True, False) for i in without)
    assert all(with_fit[i] == (False, False) for i in range(1000, 1020))
    assert sum(with_fit[i] != (True, False) for i in range(400)) <= 2


def test_limits_against_brute_force(prose, docs_of):
    import math

    import numpy as np
    import zstandard

    rows = [(i, prose.text(prose.r.randint(60, 3000))) for i in range(150)]
    measured = docs_of(rows + rows[:40]).select("doc_id", "text").mapInArrow(op.rows, op.MEASURES)
    squeeze = zstandard.ZstdCompressor(level=op.LEVEL)
    by = {}
    for _, t in rows:
        raw = t.encode()
        for chunk, part in [(False, raw)] + [(True, raw[a:b]) for a, b in op.spans(len(raw))]:
            if len(part) >= 256:
                by.setdefault((chunk, math.floor(math.log2(len(part)) * 2) * 16 + 4 * len(part) // len(part.decode()) - 4), []).append(math.log(len(part) / len(squeeze.compress(part))))
    want = {}
    for k, v in by.items():
        if len(v) >= 5:
            a, m, b = (sorted(v)[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.5, 0.75))
            want[k] = (min(a - op.FENCE * (b - a), m - op.BELOW), max(b + op.FENCE * (b - a), m + op.ABOVE))
    got = {(c, k): (lo, hi) for c, k, lo, hi in op.limits(measured, 5)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=0.005) for k in want)


def test_copies_count_once_for_the_limits(prose, docs_of):
    """A hot group of copies doesn't become the norm."""
    text = prose.text(200)
    rows = [(i, text) for i in range(300)] + [(1000 + i, prose.text(200)) for i in range(100)]
    assert sum(not r["kept"] for r in op.judge(docs_of(rows)).collect()) <= 1


def cyrillic(t):
    """The same text, letter by letter in another script."""
    return t.translate({**{ord("a") + i: 0x430 + i for i in range(26)}, **{ord("A") + i: 0x410 + i for i in range(26)}})


@pytest.mark.parametrize("n", [20, 120])
def test_a_rare_script_is_kept(prose, docs_of, n):
    """Prose in another script, in a class of its own or too rare for one; its noise and its repeats go nevertheless."""
    rows = [(i, prose.text(prose.r.randint(60, 900))) for i in range(500)]
    rare = [(1000 + i, cyrillic(prose.text(prose.r.randint(60, 900)))) for i in range(n)]
    letters = [chr(c) for c in range(0x410, 0x450)]
    noise = " ".join("".join(prose.r.choice(letters) for _ in range(40)) for _ in range(60))
    lines = "".join(f"{cyrillic('item number')} {i % 10} {cyrillic('of the list with the very same words')} {i}\n" for i in range(900))
    out = {r["doc_id"]: r["kept"] for r in op.judge(docs_of(rows + rare + [(3000, noise), (3001, lines)])).collect()}
    assert sum(not out[i] for i, _ in rare) <= n // 100
    assert sum(not out[i] for i, _ in rows) <= 5
    assert not out[3001]
