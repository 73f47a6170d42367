import hashlib
import re

import pytest

from kgloom.llm import op8_decontamination as op


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    window = {}
    for i, t in bench:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            window.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes, out = {len(x) for x in window}, {}
    for i, t in docs:
        w, hit, items = tokens(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := window.get(tuple(w[k : k + n])):
                    items |= x
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def bench_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "w") for r in rows], "item_id long, text string, doc_id int, words string")


@pytest.mark.parametrize("limit", [0, op.MAX_BROADCAST_ROWS])
def test_against_brute_force(spark, prose, docs_of, monkeypatch, limit):
    monkeypatch.setattr(op, "MAX_BROADCAST_ROWS", limit)
    items = [(i, prose.text(prose.r.randint(8, 40))) for i in range(12)] + [(20, "One"), (21, "two three"), (22, None), (23, "--"), (24, prose.text(9)), (25, "the the the the the the the the the the the the"), (26, "ÉT é")]
    items.append((30, items[0][1]))
    rows = []
    for i in range(30):
        body = prose.words(60)
        if i % 3 == 0:
            w = (items[i % 12][1] or "").upper().split()
            a = prose.r.randint(0, 6)
            body[20:20] = w[a : a + prose.r.randint(5, 25)]
        rows.append((i, " ".join(body)))
    rows += [(40, items[0][1]), (41, items[3][1] + " " + items[3][1]), (42, None), (43, ""), (44, "a One-two three"), (45, "the " * 40), (46, "ét É ét é")]
    got = {r["doc_id"]: tuple(r)[1:6] for r in op.decontaminate(docs_of(rows), bench_of(spark, items)).collect()}
    assert got == brute(rows, items)


def test_empty_tables_and_repeated_rows(spark, prose, docs_of):
    some = docs_of([(1, prose.text(30)), (1, "x"), (2, None)])
    assert {r["n_hit"] for r in op.decontaminate(some, bench_of(spark, [])).collect()} == {0}
    assert op.decontaminate(docs_of([]), bench_of(spark, [(1, "a b")])).collect() == []
    text = prose.text(12)
    out = op.decontaminate(docs_of([(1, text), (1, text)]), bench_of(spark, [(5, text)])).collect()
    assert [r["n_hit"] for r in out] == [12, 12]


def near(docs, bench):
    """Items whose 3 rarest words lie within 25 words of one place of the rarest, by document."""
    words = {i: tokens(t) for i, t in docs}
    out = dict.fromkeys(words, 0)
    for _, t in bench:
        terms = sorted(set(tokens(t)), key=lambda w: (sum(v.count(w) for v in words.values()), w.encode()))[:3]
        for i, v in words.items():
            at = [[p for p, w in enumerate(v) if w == x] for x in terms]
            out[i] += bool(at) and any(all(any(abs(p - q) <= 25 for q in o) for o in at[1:]) for p in at[0])
    return out


@pytest.mark.parametrize("limit", [0, op.MAX_BROADCAST_ROWS])
def test_proximity_against_brute_force(spark, prose, docs_of, monkeypatch, limit):
    monkeypatch.setattr(op, "MAX_BROADCAST_ROWS", limit)
    items = [(i, " ".join(prose.words(prose.r.choice([1, 2, 6, 15])))) for i in range(15)] + [(20, None), (21, "a a")]
    rows = []
    for i in range(25):
        body = prose.words(80)
        some = tokens(items[i % 15][1])
        prose.r.shuffle(some)
        for w in some:
            body.insert(prose.r.randint(0, 80 if i % 2 else 20), w)
        rows.append((i, " ".join(body)))
    rows += [(90, None), (91, ""), (92, "a")]
    assert {r["doc_id"]: r["n_near"] for r in op.decontaminate(docs_of(rows), bench_of(spark, items)).collect()} == near(rows, items)


def test_rows_without_ids_and_repeated_ids(spark, prose, docs_of):
    """Each row is judged by its own text."""
    text = prose.text(12)
    rows = [(None, text), (None, prose.text(20)), (None, None), (3, text + " and more"), (3, prose.text(9)), (None, text)]
    out = op.decontaminate(docs_of(rows), bench_of(spark, [(5, text), (5, "Another one"), (None, "un nommé")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in out) == [(0, 0), (0, 0), (0, 12), (0, 12), (3, 0), (3, 12)]
    assert [r["n_items"] for r in op.decontaminate(docs_of([(1, "x another one"), (2, "un nommé")]), bench_of(spark, [(5, text), (5, "Another one"), (None, "un nommé")])).orderBy("doc_id").collect()] == [1, 0]


def test_one_word_item_in_a_long_document(spark, prose, docs_of):
    """Every place is an alignment of its own; nothing gathers them."""
    out = op.decontaminate(docs_of([(1, "the cat " * 60_000), (2, "cat")]), bench_of(spark, [(1, "the")])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_near"]) for r in out] == [(120_000, 60_000, 1), (1, 0, 0)]


def test_stage_drops_contaminated_documents(spark, prose, docs_of, tmp_path):
    item = prose.text(20)
    bench_of(spark, [(1, item)]).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs_of([(1, prose.text(50)), (2, prose.text(10) + " " + item), (3, None)])
    out = op.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_stage_with_clashing_names(spark, prose, docs_of, tmp_path):
    item = prose.text(20)
    bench_of(spark, [(1, item)]).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs_of([(1, prose.text(50)), (2, item), (None, item), (None, "x")]).withColumns({c: op.F.lit(1) for c in ("_doc", "_h", "h", "_gone0", "_gone1", "words", "_id")})
    out = op.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "None"]
    assert len(op.decontaminate(df, bench_of(spark, [(1, item)])).collect()) == 4
