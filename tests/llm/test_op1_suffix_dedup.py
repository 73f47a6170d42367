import hashlib

import numpy as np

from kgloom.llm import op1_suffix_dedup as op
from kgloom.llm.suffix_array import common_prefixes, eights, suffix_array


def brute(rows):
    first, place = {}, {}
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda x: x[0]):
        b = t.encode()
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (i, k))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] != (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(bool(gone[k]) and not (k and gone[k - 1]) for k in range(len(gone)))
        place[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return place


def got(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 500)).astype(np.uint8)
        order, raw = suffix_array(text), text.tobytes()
        assert sorted(order) == list(range(len(text)))
        keys = [raw[i : i + 100] for i in order]
        assert keys == sorted(keys)
        shared = common_prefixes(order, eights(text), 100)
        for k in range(1, len(keys)):
            n = min(len(keys[k - 1]), len(keys[k]))
            true = next((i for i in range(n) if keys[k - 1][i] != keys[k][i]), n)
            assert shared[k] == true or true == n <= shared[k]
    assert len(suffix_array(np.zeros(0, np.uint8))) == 0


def rows_of(prose):
    passage, long = prose.text(60), prose.text(400)
    rows = [(i, prose.text(prose.r.randint(1, 150))) for i in range(12)]
    rows += [(20 + i, prose.text(20) + " " + passage + " " + prose.text(20)) for i in range(8)]
    rows += [(30, long), (31, long), (32, long[:900] + "é" + long[900:]), (33, long[50:]), (34, "ab" * 300), (35, "a" * 100), (36, "a" * 101), (37, "a" * 99)]
    return rows + [(40, None), (41, ""), (42, "\x00" * 250), (43, "ü" * 120), (44, passage + passage)]


def test_against_brute_force(prose, docs_of):
    rows = rows_of(prose)
    assert got(op.dedup(docs_of(rows))) == brute(rows)


def test_crowded_anchors_are_split(prose, docs_of):
    rows = rows_of(prose)
    for most in (1, 2, 5):
        assert got(op.dedup(docs_of(rows), max_pieces=most)) == brute(rows)


def test_one_passage_in_many_contexts_is_split_by_longer_anchors(prose, docs_of):
    """The same 40 bytes, and the same 90 and 150 bytes, in hundreds of different surroundings: more pieces of an anchor than fit."""
    shared = [prose.text(40)[:n] for n in (40, 90, 150)]
    rows = [(i, prose.text(25) + shared[i % 3] + prose.text(25) + (shared[2] if i % 7 == 0 else "")) for i in range(240)]
    assert got(op.dedup(docs_of(rows), max_pieces=8)) == brute(rows)


def test_very_long_text(prose, docs_of, monkeypatch):
    half = prose.text(15_000)
    rows = [(1, half + " " + prose.text(15_000) + half), (2, prose.text(30) + half[5000:9000])]
    monkeypatch.setattr(op, "CHUNK", 1 << 13)
    assert got(op.dedup(docs_of(rows))) == brute(rows)


def test_empty_table_repeated_rows_and_null_ids(prose, docs_of):
    assert op.dedup(docs_of([])).collect() == []
    text = prose.text(80)
    rows = op.dedup(docs_of([(1, text), (1, text), (None, text), (2, text)])).collect()
    assert sorted(((r["doc_id"], r["n_removed"] > 0) for r in rows), key=lambda x: x[0] or 0) == [(None, False), (1, False), (1, False), (2, True)]
