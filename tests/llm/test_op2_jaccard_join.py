import re

import pytest

from kgloom.llm import op2_jaccard_join as op


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def changed(prose, words, n):
    words = list(words)
    for _ in range(n):
        k = prose.r.randrange(len(words))
        what = prose.r.random()
        if what < 0.4:
            words[k] = prose.word()
        elif what < 0.7:
            del words[k]
        else:
            words.insert(k, prose.word())
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(prose, docs_of, seed):
    prose.r.seed(seed)
    passage, rows = prose.words(40), []
    for g in range(6):
        base = prose.words(prose.r.choice([3, 5, 12, 60, 200, 400]))
        for _ in range(prose.r.choice([1, 3, 30])):
            rows.append(" ".join(changed(prose, base, prose.r.randint(0, max(1, len(base) // 25)))))
    rows += [" ".join([*prose.words(30), *passage, *prose.words(30)]) for _ in range(25)] + [" ".join(passage)] * 3
    rows += ["one two", "One  Two", "two one", "x", "X", "", None, " \t\n"]
    prose.r.shuffle(rows)
    rows = list(enumerate(rows))
    assert got(op.classes(docs_of(rows))) == brute(rows)


def test_threshold_is_inclusive(prose, docs_of):
    w = [f"w{i}" for i in range(123)]  # 120 shingles
    rows = [(1, " ".join(w)), (2, " ".join(w[:105])), (3, " ".join(w[:104]))]  # 102 / 120 = 0.85, 101 / 120
    found = got(op.classes(docs_of(rows)))
    assert found == brute(rows) and found[2][1] == 1


def test_long_documents_and_many_copies(prose, docs_of):
    base = prose.words(3000)
    rows = [(i, " ".join(changed(prose, base, 40))) for i in range(14)] + [(20 + i, " ".join(base)) for i in range(30)]
    assert got(op.classes(docs_of(rows))) == brute(rows)


def test_empty_table_and_repeated_rows(docs_of):
    assert op.classes(docs_of([])).collect() == []
    rows = op.classes(docs_of([(5, "a b c d e"), (5, "a b c d e"), (7, "A b c d e"), (None, "a b c d e")])).collect()
    assert sorted((tuple(r) for r in rows), key=str) == [(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, None)]


def test_stage_with_null_ids_and_clashing_names(spark, docs_of):
    df = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]).withColumns({c: op.F.lit(1) for c in ("_id", "_gone0", "rep", "token", "component_id")})
    out = op.stage(spark, df, "")
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "None", "None"]


def test_stage_keeps_the_least_of_each_component(spark, docs_of):
    df = docs_of([(3, "a b c d e f"), (1, "a b c d e f"), (2, "something else than that here"), (4, None)])
    out = op.stage(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4]


def test_index_entries_are_shared_by_similar_sets():
    """Whatever the frequencies, sets at the threshold share an entry."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(2, 700))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        lost = rng.integers(0, op.misses(len(x)) + 1)
        y = rng.permutation(x)[: len(x) - lost]
        often = {int(t): int(rng.choice([2, 3, 9, 50, 3000], p=rng.dirichlet(np.ones(5)))) for t in x}

        def entries(s):
            inside = s[s < op.top(op.PERCENT)]
            full = not op.fits(np.array([len(s)]), np.array([len(inside)]))[0]
            counted = np.sort(s if full else inside)
            return set(op.entries(len(s), len(inside), counted, np.array([often[int(t)] for t in counted], int)).tolist())

        if len(y):
            assert entries(x) & entries(np.sort(y)) or len(x) == len(y) == 1


def test_width_and_percent_against_brute_force(prose, docs_of):
    rows = []
    for n in [3, 5, 12, 60, 200, 400, 1500]:
        base = prose.words(n)
        rows += [" ".join(changed(prose, base, prose.r.randint(0, max(1, n // 18)))) for _ in range(12)]
    rows = list(enumerate(rows))
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    at = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((at[i], at[j]))
                at = {k: low if c == high else c for k, c in at.items()}
    assert got(op.classes(docs_of(rows), 5, 80)) == {i: (len(s), at[i]) for i, s in sets.items()}


def test_stage_drops_copies_of_four_fifths(spark, docs_of):
    w = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(w[:400])), (2, " ".join(w[:499])), (3, " ".join([*w, "a", "b", "c"]))]  # 396 / 495 = 0.8, 396 / 499
    out = op.stage(spark, docs_of([rows[0], rows[1]]), "").collect()
    assert [r["doc_id"] for r in out] == [1]
    out = op.stage(spark, docs_of([rows[0], rows[2]]), "").collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3]


def test_clusters_beside_the_pivots_against_brute_force(prose, docs_of):
    """Families that share a long passage, each of copies near to one another and not to the others, with bridges between some."""
    passage, rows = prose.words(150), []
    for _ in range(4):
        own = prose.words(150)
        rows += [" ".join([*passage, *changed(prose, own, prose.r.randint(0, 8))]) for _ in range(12)]
        rows += [" ".join([*passage[: prose.r.randint(60, 150)], *own]) for _ in range(6)]
        rows += [" ".join([*changed(prose, passage, 12), *own]) for _ in range(4)]
    prose.r.shuffle(rows)
    rows = list(enumerate(rows))
    assert got(op.classes(docs_of(rows))) == brute(rows)
