import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgloom.operators import coverage, entities, failure, grading, kg, matching, metrics, prompts, scorers, stats, translate
from kgloom.plans.reports import fixed_width


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# metrics
def graded(spark, data):
    return spark.createDataFrame(data, "model string, LoE string, LoQ string, eval string, eval_type string, provenance string")


def test_f1_edges(spark):
    data = [("a", "x", "y", "TP", "exact_match", "auto")] * 5 + [("b", "x", "y", "FP", "no_match", "judge")] * 3 + [("b", "x", "y", "FN", "", "")] * 2
    got = {r["model"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.report(graded(spark, data), "country", "model").collect()}
    assert got == {"a": (1.0, 1.0, 1.0), "b": (0.0, 0.0, 0.0)}


def test_empty_cells_lower_the_macro_mean(spark):
    data = [("a", "x", "y", "TP", "exact_match", "auto"), ("b", "z", "y", "TP", "exact_match", "auto")]
    assert rows(metrics.macro(graded(spark, data), "country")) == [("x", "y", 0.5), ("z", "y", 0.5)]


def test_weights_replace_hits_only(spark):
    data = [("a", "x", "y", "TP", t, "auto") for t in ("exact_match", "substring_match", "historical_match", "llm_match")] + [("a", "x", "y", "FP", "no_match", "judge")]
    r = metrics.report(graded(spark, data), "country", "model", weighted=True).first()
    assert r["w_tp"] == pytest.approx(2.6) and r["precision"] == pytest.approx(2.6 / 3.6) and r["recall"] == 1


def test_f1_stays_in_bounds(spark):
    r = random.Random(1)
    data = [(r.choice("ab"), r.choice("xy"), r.choice("pq"), e := r.choice(["TP", "FP", "FN"]), "exact_match" if e == "TP" else "", r.choice(["auto", "judge", ""])) for _ in range(300)]
    for df in (metrics.grouping_sets(graded(spark, data), "pob"), metrics.by_provenance(graded(spark, data), "pob", "model")):
        assert all(0 <= x["f1"] <= 1 for x in df.collect())
    assert {x["level"] for x in metrics.grouping_sets(graded(spark, data), "pob").collect()} == {0, 1, 2, 3}
    wide = metrics.wide(metrics.matrix(graded(spark, data), "pob", "LoE", "LoQ"), "LoE", "LoQ", ["p", "q", "none"])
    assert wide.columns == ["LoE", "p", "q", "none"] and {x["none"] for x in wide.collect()} == {0.0}


# graders
@pytest.mark.parametrize(
    "output,want",
    [
        ("1901-03-07", ("TP", "exact_match", 1.0)), ("1901-07-03", ("TP", "swap_match", 1.0)), ("1901-03-21", ("TP", "year_month_match", 0.7)), ("1901-11-03", ("TP", "year_month_swap_match", 0.7)), ("1901-12-25", ("FP", "year_match", 0.5)), ("1901-45-03", ("TP", "year_month_swap_match", 0.7)), ("1901-07-13", ("FP", "year_match", 0.5)), ("1901-31-03", ("TP", "year_month_swap_match", 0.7)), ("1901-03-07T12", ("TP", "exact_match", 1.0)),
        ("born on 1901-03-07.", ("TP", "exact_match", 1.0)), ("1902-03-07", ("FP", "no_match", 0.0)), ("1901", ("FP", "no_match", 0.0)), ("none", ("FN", "empty", 0.0)), (" ", ("FN", "empty", 0.0)), (None, ("FN", "empty", 0.0)),
    ],
)
def test_dates_of_birth(spark, output, want):
    df = spark.createDataFrame([("1901-03-07T00:00:00Z", output)], "gt string, llm_output string")
    r = grading.grade_dob(df).first()
    assert (r["eval"], r["eval_type"], r["eval_score"]) == want


@pytest.mark.parametrize("gt,output,want", [("1990-03-07T00:00:00Z", "1990-45-03", ("TP", "year_month_swap_match")), ("1990-12-31", "1990-31-12", ("TP", "swap_match")), ("1990-32-12", "1990-12-32", ("FP", "year_match")), ("1990-12-32", "1990-32-12", ("TP", "year_month_swap_match"))])
def test_swaps_worked_out_by_hand(spark, gt, output, want):
    """The whole swap asks for an answer's day up to 12 and month up to 31; that of year and month for the day alone."""
    r = grading.grade_dob(spark.createDataFrame([(gt, output)], "gt string, llm_output string")).first()
    assert (r["eval"], r["eval_type"]) == want


def test_date_without_truth(spark):
    r = grading.grade_dob(spark.createDataFrame([("unknown", "1901-01-01")], "gt string, llm_output string")).first()
    assert (r["eval"], r["eval_type"]) == ("FP", "no_match")


def test_countries(spark):
    outputs = ["[France]", "Spain, France", "French Republic", "Vichy France", "French", "Peru", "['']", "N/A", "Atlantis", "Lemuria"]
    answers = spark.createDataFrame([("Q1", str(i), "['France']", o) for i, o in enumerate(outputs)], "Q_number string, i string, gt string, llm_output_en string")
    vocab = spark.createDataFrame([("Q1", ["French"], ["French Republic"], [])], "entity_q string, demonyms array<string>, aliases array<string>, labels array<string>")
    verdicts = spark.createDataFrame([("Atlantis", "['France']", "historical_match"), ("Lemuria", "['France']", "made up")], "llm_output string, gt_raw string, match_type string")
    got = {int(r["i"]): (r["eval"], r["eval_type"], r["provenance"]) for r in grading.grade_country(answers, vocab, verdicts).collect()}
    kinds = ["exact_match", "exact_match", "alias_match", "substring_match", "demonym_match"]
    assert got == {i: ("TP", k, "auto") for i, k in enumerate(kinds)} | {5: ("FP", "no_match", "judge"), 6: ("FN", "", ""), 7: ("FN", "", ""), 8: ("TP", "historical_match", "judge"), 9: ("FP", "no_match", "judge")}
    graded_ = grading.grade_country(answers, vocab, verdicts)
    assert [r["llm_output"] for r in grading.open_questions(graded_, verdicts).collect()] == ["Peru"]


def test_places(spark):
    outputs = ["Paris", "Paris (city)", "near Paris", "Lutetia", "Lyon", "Rome", "", "NONE", "..."]
    answers = spark.createDataFrame([(str(i), "['Paris']", o) for i, o in enumerate(outputs)], "Q_number string, gt string, llm_output_en string")
    places = spark.createDataFrame([("paris", "Q90", ["F"]), ("lutetia", "Q90", ["F"]), ("lyon", "Q456", ["F"]), ("rome", "Q220", ["I"])], "name_key string, q string, countries array<string>")
    verdicts = spark.createDataFrame([], "llm_output string, gt_raw string, match_type string")
    got = [r["eval_type"] for r in grading.grade_place(answers, places, verdicts).orderBy("Q_number").collect()]
    assert got == ["exact_match"] * 4 + ["country_match", "no_match", "", "", ""]


def test_resume_grades_only_what_is_new(spark):
    answers = spark.createDataFrame([("a", "en", "en", "1901-01-01", "1901-01-01"), ("b", "en", "en", "1901-01-01", "1901-01-01")], "Q_number string, LoQ string, LoE string, gt string, llm_output string")
    old = grading.grade_dob(answers.where("Q_number = 'a'")).withColumn("eval_type", F.lit("kept"))
    unfinished = grading.grade_dob(answers.where("Q_number = 'b'")).withColumn("eval", F.lit(""))
    out = grading.resume(answers, old.unionByName(unfinished), grading.grade_dob)
    assert {r["Q_number"]: r["eval_type"] for r in out.collect()} == {"a": "kept", "b": "exact_match"}


def test_failure_modes(spark):
    outs = ["YYYY-MM-DD", "1999", "1999-01-02", "x" * 41, "nan", None, "N/A", "soon"]
    df = spark.createDataFrame([(o,) for o in outs], "o string").select(failure.mode("o"))
    assert [r[0] for r in df.collect()] == ["literal_format_echo", "year_only_no_format", "wrong_date_correct_format", "verbose_response", "empty/nan", "empty/nan", "empty/nan", "other_format"]


# translation
def test_lookup_order(spark):
    table = spark.createDataFrame([("fr", "Norvège", "Norway", 2), ("de", "Norvège", "Norwegen?", 1), ("fr", "[Allemagne]", '["Germany"]', 3), ("de", "x", "y", 4)], "loq string, text string, en string, pos long")
    data = [("fr", "Norvège"), ("it", "Norvège"), ("fr", "[Norvège, Allemagne]"), ("fr", "[Norvège, zz]"), ("en", "x"), ("fr", " none "), ("pl", "zz")]
    answers = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, LoQ string, llm_output string")
    got = [r["llm_output_en"] for r in translate.lookup(answers, table).orderBy("i").collect()]
    assert got == ["Norway", "Norwegen?", '["Norwegen?", "Germany"]', None, "x", "NONE", None]

    class Upper:
        def translate(self, misses):
            return misses.withColumn("en", F.when(F.col("loq") == "pl", F.upper("text")))

    out, merged = translate.translate(answers, table, Upper())
    assert [r["llm_output_en"] for r in out.orderBy("i").collect()][-1] == "ZZ" and merged.count() == 6


# statistics and matching
def test_summary_of_small_samples(spark):
    df = spark.createDataFrame([("a", x) for x in (9, 10, 12, 20, 65)] + [("b", 7), ("b", None)], "g string, x int")
    got = {r["g"]: r for r in stats.summarize(df, "x", "g").collect()}
    assert got["a"]["p90"] == pytest.approx(47) and got["a"]["p99"] == pytest.approx(63.2) and got["a"]["std"] == pytest.approx(23.763417, abs=1e-5)
    assert (got["b"]["n"], got["b"]["std"], got["b"]["p95"]) == (1, 0.0, 7)


def test_matching_invariants(spark):
    r = random.Random(4)
    data = [(g, f"{g}{i}", int(r.expovariate(1 / 30))) for g, n in (("a", 300), ("b", 120), ("c", 60)) for i in range(n)]
    df = spark.createDataFrame(data, "lang string, qid string, links int")
    got = matching.hard_match(df, "lang", "qid", "links", 5)
    by = Counter((x["lang"], x["bin_lo"]) for x in got.collect())
    assert len({n for _, n in Counter({g: sum(v for (h, _), v in by.items() if h == g) for g in "abc"}).items()}) == 1
    assert {x["n"] for x in matching.violations(got, df, "lang", "qid", "links", 5).collect()} == {0}
    broken = got.unionByName(got.limit(1))
    assert {x["rule"] for x in matching.violations(broken, df, "lang", "qid", "links", 5).where("n > 0").collect()} >= {"duplicate", "histogram", "totals"}
    assert rows(got.select("qid")) == rows(matching.hard_match(df.repartition(5), "lang", "qid", "links", 5).select("qid"))


def test_ks_distance(spark):
    r = random.Random(5)
    sample = {g: [r.randint(0, m) for _ in range(n)] for g, m, n in (("a", 20, 50), ("b", 30, 70), ("c", 5, 9))}
    df = spark.createDataFrame([(g, x) for g, xs in sample.items() for x in xs], "g string, x int")
    for row in stats.ks_pairwise(df, "g", "x").collect():
        a, b = sample[row["A"]], sample[row["B"]]
        assert row["KS_D"] == pytest.approx(max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in a + b))


def test_coverage_is_all_subsets(spark):
    r = random.Random(6)
    baskets = [[p for p in "abcdefgh" if r.random() < 0.6] for _ in range(60)]
    df = spark.createDataFrame([(b,) for b in baskets], "props array<string>")
    want = {", ".join(s): n for k in (3, 4, 5) for s in itertools.combinations("abcdefgh", k) if (n := sum(set(s) <= set(b) for b in baskets)) >= 12}
    assert {x["properties"]: x["coverage"] for x in coverage.property_coverage(df, 12, 3, 5).collect()} == want
    assert coverage.property_coverage(df.limit(0), 1).collect() == []
    assert coverage.property_coverage(df, 61, 1, 2).collect() == []
    table = coverage.coverage_table(spark.createDataFrame([("x", "a, b", 2, 200), ("y", "a, b", 2, 100), ("x", "c", 1, 500)], "lang string, properties string, num_properties int, coverage long"), ["x", "y"])
    assert rows(table) == [("a, b", 2, 200, 100, 150.0, 600.0)]


@pytest.mark.parametrize(("least", "most", "threshold"), [(1, 2, 3), (2, 9, 2), (4, 22, 1), (5, 5, 4)])
def test_coverage_of_odd_baskets(spark, least, most, threshold):
    """Nulls, repeats, empty baskets and more properties than a word has bits."""
    r = random.Random(least)
    names = [f"P{i}" for i in range(80)]
    common = names[::20] + names[5::30]
    baskets = [[p for p in common if r.random() < 0.7] + r.sample(names, 2) for _ in range(40)]
    baskets += [[], None, [None], ["P1", "P1", None], common, common, list(reversed(common))]
    got = coverage.property_coverage(spark.createDataFrame([(b,) for b in baskets], "props array<string>"), threshold, least, most)
    want = {}
    for b in baskets:
        for k in range(least, most + 1):
            for s in itertools.combinations(sorted({p for p in b or [] if p}), k):
                want[", ".join(s)] = want.get(", ".join(s), 0) + 1
    assert sorted((x["properties"], x["num_properties"], x["coverage"], x["score"]) for x in got.collect()) == sorted((s, s.count(",") + 1, n, n * (s.count(",") + 1)) for s, n in want.items() if n >= threshold)


# graph
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_terminals(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "x"), ("p", "q"), ("q", "p"), ("s", "s")])
    roots = spark.createDataFrame([("a",), ("p",), ("s",), ("d",), ("zz",)], "node string")
    assert rows(kg.terminals(e, roots)) == [("a", "d"), ("a", "x")]
    assert ("p", "p") in rows(kg.closure(e, roots)) and ("s", "s") in rows(kg.closure(e, roots))


def test_vocabulary_of_successors(spark):
    vocab = spark.createDataFrame([("new", "en", "demonym", "Newish"), ("new", "en", "label", "New"), ("old", "en", "label", "Old"), ("own", "en", "demonym", "Own")], "country_q string, lang string, kind string, value string")
    e = edges(spark, [("old", "mid"), ("mid", "new"), ("own", "new")])
    out = kg.with_successors(vocab, e)
    assert {r["value"] for r in out.where("country_q = 'old'").collect()} == {"Old", "New", "Newish"}
    assert {r["value"] for r in out.where("country_q = 'own'").collect()} == {"Own"}


def test_presence_matrix(spark):
    t = spark.createDataFrame([("e1", "P1", "x"), ("e1", "P1", "y"), ("e2", "P2", "x"), ("e4", "P1", "x")], "s string, p string, o string")
    ids = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "entity_id string")
    m = kg.presence_matrix(ids, t, {"one": "P1", "two": "P2"})
    assert rows(m) == [("e1", 1, 0), ("e2", 0, 1), ("e3", 0, 0)]
    assert rows(entities.present(m, ["has_one"])) == [("e1",)]


def test_subclasses_at_exact_depth(spark):
    t = spark.createDataFrame([("b", "P279", "a"), ("c", "P279", "b"), ("d", "P279", "c"), ("c", "P279", "a")], "s string, p string, o string")
    roots = spark.createDataFrame([("a",)], "class string")
    assert rows(kg.subclasses(t, roots, 2)) == [("a", "c"), ("a", "d")]
    assert rows(kg.expanded(t, roots, 1)) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_bindings_and_merge(spark):
    df = spark.createDataFrame([([{"qid": ("http://x/Q1",)}, {"qid": ("http://x/Q2",), "v": ("7",)}],)], "b array<map<string,struct<value:string>>>")
    assert rows(kg.bindings(df, "b", ["qid", "v"])) == [("http://x/Q1", None), ("http://x/Q2", "7")]
    parts = spark.createDataFrame([("q", "p", ["a"]), ("q", "p", ["b"])], "qid string, property string, values array<string>")
    assert sorted(kg.merge_facts(parts).first()["values"]) == ["a", "b"]


def test_entity_documents_and_prompts(spark):
    t = spark.createDataFrame([("Q1", "P19", "http://e/Q9"), ("Q1", "P569", "1901-03-07T00:00:00Z"), ("Q2", "P19", "http://e/Q8")], "s string, p string, o string")
    labels = spark.createDataFrame([("Q1", "label", "en", "Ada"), ("Q1", "label", "fr", "Ada F"), ("http://e/Q9", "label", "fr", "Londres")], "entity string, kind string, lang string, value string")
    ids = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "qid string")
    docs = entities.documents(kg.facts(t, labels, ids, ["P19", "P569"], ["en", "fr"]))
    doc = docs.where("qid = 'Q1'").first()
    assert doc["labels"] == {"en": "Ada", "fr": "Ada F"} and doc["props"]["P19"]["count"] == 1 and doc["props"]["P19"]["values"][0]["value_id"] == "Q9"
    table = prompts.template_table(spark)
    assert table.count() == 36
    grid = prompts.grid(docs.withColumn("sitelinks", F.lit(9)), table, ["en", "fr", "de"])
    got = {(r["lang"], r["property"]): (r["ground_truth"], r["prompt"]) for r in grid.where("ent_ID = 'Q1'").collect()}
    assert got["fr", "pob"][0] == ["Londres"] and "Ada F" in got["fr", "pob"][1] and got["en", "pob"] == ([], "") and got["de", "dob"][0] == ["1901-03-07T00:00:00Z"] and "Ada" in got["de", "dob"][1]
    assert grid.where("ent_ID = 'Q2'").isEmpty()
    samples = prompts.samples(prompts.wide(grid), F.lit("en"))
    assert {(r["LoQ"], r["property"]) for r in samples.collect()} == {("fr", "pob"), ("en", "dob"), ("fr", "dob"), ("de", "dob")}
    assert prompts.samples(prompts.wide(grid), F.lit("en"), ["pob"]).count() == 1
    chat = samples.where("property = 'pob'").select(*(prompts.chat(F.lit(x)).alias(x) for x in prompts.LAYOUTS)).first()
    assert [m["role"] for m in chat["system"]] == ["system", "user"] and chat["no_think"][0]["content"] == "/no_think" and json.loads(chat["typed"][0]["content"])[0]["type"] == "text"
    assert prompts.decoding("deepseek-ai/DeepSeek-V2-Lite-Chat")["max_new_tokens"] == 1024
    with pytest.raises(ValueError):
        prompts.layout_of("nobody/none")


def test_completeness(spark):
    v = lambda *langs: {"values": [("x", "x", {c: "n" for c in langs}, len(langs))], "count": 1}
    from kgloom.schemas import ENTITIES

    data = [("Q1", {"en": "a"}, {"P1": v("en", "fr")}, 1, 9), ("Q2", {}, {"P1": v("en")}, 0, 20), ("Q3", {}, {}, 0, None), ("Q4", {}, {"P1": v("en", "fr")}, 0, 3)]
    df = spark.createDataFrame(data, ENTITIES).withColumn("lang", F.lit("x"))
    assert rows(entities.completeness(df, ["P1"], ["en", "fr"])) == [("x", 4, 1, 1)]
    assert rows(entities.complete(df, ["P1"], ["en", "fr"]).select("qid")) == [("Q1",)]
    with pytest.raises(Exception, match="negative"):
        entities.valid_numbers(spark.createDataFrame([(-1,)], "x int"), "x").collect()
    assert rows(entities.valid_numbers(spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double"), "x")) == [(1.0,)]


# scorers and reports
def test_overlap_scores(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(8)
    data = [(" ".join(r.choice("abc") for _ in range(r.randint(0, 8))), " ".join(r.choice("abc") for _ in range(r.randint(0, 8)))) for _ in range(60)] + [("a b c d", "a b c d")]
    out = scorers.score(spark.createDataFrame(data, "gt string, llm_output string"), "overlap").collect()
    for row in out:
        a, b = row["llm_output"].split(), row["gt"].split()
        n = lcs(a, b)
        assert row["ROUGE_L"] == pytest.approx((1 + 1.44) * (n / len(a)) * (n / len(b)) / (n / len(b) + 1.44 * n / len(a)) if n else 0)
        hit = sum(min(c, Counter(b)[x]) for x, c in Counter(a).items())
        if a and b:
            assert row["Bleu_1"] == pytest.approx(hit / len(a) * min(1, 2.718281828 ** (1 - len(b) / len(a))), abs=1e-6)
    assert out[-1]["Bleu_4"] == pytest.approx(1) and out[-1]["METEOR"] == pytest.approx(1)
    with pytest.raises(ValueError):
        scorers.score(spark.createDataFrame([(1,)], "x int"), "overlap")
    with pytest.raises(ValueError):
        scorers.score(spark.createDataFrame([(1,)], "x int"), "none")


def test_cider_prefers_the_truth(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "e f g h", "a b"), (3, "i j k l", "x y z w")], "k int, gt string, llm_output string")
    got = {r["k"]: r["CIDEr"] for r in scorers.cider(df, "k").collect()}
    assert got[1] == pytest.approx(10) and got[3] == 0 and got[1] > got[2]


def test_fixed_width(spark):
    text = fixed_width(spark.createDataFrame([("a", 1.0), ("bb", 0.5)], "m string, f1 double"), "T")
    assert text.splitlines() == ["T", "=", "m       f1", "a   1.0000", "bb  0.5000"]


def test_harvest_by_hand(spark):
    """Humans of the class or its direct subclasses who speak a language, with nine Wikipedia links; nobody else of those classes."""
    people = {"a": ("Q5", "writer", "de", 9, 0), "b": ("Q5", "poet", "de", 12, 0), "c": ("Q5", "lyricist", "de", 12, 0), "d": ("Q5", "writer", "fr", 12, 0), "e": ("Q7", "writer", "de", 12, 0), "f": ("Q5", "writer", "de", 8, 5), "g": ("Q5", "baker", "de", 12, 0), "h": ("Q5", "poet", "at", 9, 0)}
    t = [(s, p, o) for s, (kind, job, lang, *_) in people.items() for p, o in (("P31", kind), ("P106", job), ("P1412", lang))] + [("poet", "P279", "writer"), ("lyricist", "P279", "poet")]
    links = [(s, f"https://{x}x.wikipedia.org/") for s, (*_, n, _) in people.items() for x in "abcdefghijkl"[:n]] + [(s, f"https://{x}.wikiquote.org/") for s, (*_, n) in people.items() for x in "abcde"[:n]]
    triples = spark.createDataFrame(t, "s string, p string, o string")
    classes, langs = spark.createDataFrame([("writer",)], "class string"), spark.createDataFrame([("de",), ("at",)], "lang string")
    for wanted in (["de", "at"], langs):
        assert rows(kg.harvest(triples, spark.createDataFrame(links, "entity string, site string"), classes, wanted)) == [("a",), ("b",), ("h",)]


def test_links_count_on_wikipedia_only(spark):
    links = spark.createDataFrame([("a", u) for u in ("https://en.wikipedia.org/", "https://zh-yue.wikipedia.org/", "https://en.wikiquote.org/", "http://en.wikipedia.org/", "https://en.wikipedia.org/wiki/X", "https://www.wikidata.org/", "https://en.wikipedia.org/")], "entity string, site string")
    assert rows(kg.link_counts(links)) == [("a", 3)] and rows(kg.sitelinks(links, "a")) == [("https://en.wikipedia.org/",), ("https://zh-yue.wikipedia.org/",)]


def test_common_subsequences_and_runs():
    r = random.Random(8)
    for _ in range(200):
        a, b = (["abcd"[r.randrange(4)] for _ in range(r.randint(0, 90))] for _ in "xy")
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, x=x, row=row: row[j - 1] + 1 if b[j - 1] == x else max(row[j], left), initial=0))
        assert scorers.common_subsequence(a, b) == row[-1]
    assert scorers.runs("a b c d".split(), "a b x c d".split()) == 2 and scorers.runs("b a".split(), "a b".split()) == 2 and scorers.runs(["a"], ["b"]) == 0 and scorers.runs("a a b".split(), "a b a".split()) == 3


def test_order_lowers_meteor(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("a b c d", "d c b a"), ("a b c d", "")], "gt string, llm_output string")
    got = [(round(r["METEOR"], 6), round(r["METEOR_ordered"], 6)) for r in scorers.score(df, "overlap").collect()]
    assert got == [(1.0, round(1 - 0.5 / 64, 6)), (1.0, 0.5), (0.0, 0.0)]


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """10,000 successors one after another, with a cycle beside them: rounds go by the logarithm."""
    rounds, write = [], kg.kept
    monkeypatch.setattr(kg, "kept", lambda df: rounds.append(1) or write(df))
    n = 10_000
    edges = spark.range(n).selectExpr("concat('x', id) AS a", "concat('x', id + 1) AS b").union(spark.createDataFrame([("p", "q"), ("q", "p"), ("q", "z"), ("r", None)], "a string, b string"))
    roots = spark.createDataFrame([("x0",), ("x7",), ("p",), (f"x{n}",), ("nowhere",)], "node string")
    assert rows(kg.terminals(edges, roots)) == [("p", "z"), ("x0", f"x{n}"), ("x7", f"x{n}")]
    assert len(rounds) <= 2 + 2 * 14


def test_bert_score_against_plain_numpy(spark):
    import numpy as np

    r = np.random.default_rng(1)
    sides = {k: [(int(key), p, f"w{r.integers(4)}", [float(x) for x in r.normal(size=5)]) for key in range(4) for p in range(int(r.integers(1, 9)))] for k in "to"}
    sides["t"].append((9, 0, "w1", [1.0, 0.0, 0.0, 0.0, 0.0]))
    frames = [spark.createDataFrame(sides[k], "key long, pos int, token string, vector array<double>") for k in "to"]
    for weighted in (False, True):
        df = {w: len({x[0] for x in sides["t"] if x[2] == w}) for w in "w0 w1 w2 w3".split()}
        n = len({x[0] for x in sides["t"]})
        want = {}
        for key in (0, 1, 2, 3, 9):
            t, o = ([x for x in sides[k] if x[0] == key] for k in "to")
            unit = lambda rows_: np.array([np.array(x[3]) / np.linalg.norm(x[3]) for x in rows_]).reshape(-1, 5)
            like = unit(t) @ unit(o).T if t and o else np.zeros((len(t), len(o)))
            w = lambda rows_: np.array([np.log((n + 1) / (df[x[2]] + 1)) if weighted else 1.0 for x in rows_])
            share = lambda rows_, best: float((w(rows_) * best).sum() / w(rows_).sum()) if len(rows_) and w(rows_).sum() else 0.0
            p, q = share(o, like.max(0) if like.size else 0), share(t, like.max(1) if like.size else 0)
            want[key] = (p, q, 2 * p * q / (p + q) if p + q else 0.0)
        for block in (256, 3):
            got = {x["key"]: tuple(x)[1:] for x in scorers.bert_score(*frames, weighted, block).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_labels_of_one_language(spark):
    from pyspark.sql import functions as F

    schema = "qid string, labels map<string,string>, props map<string, struct<values: array<struct<value:string, value_id:string, labels: map<string,string>, labels_count:int>>, count:int>>"
    value = lambda labels: ("u", "v", labels, len(labels))
    df = spark.createDataFrame([("a", {"en": "A"}, {"P1": ([value({}), value({"fr": "x"})], 2)}), ("b", {}, {}), ("c", None, {"P1": ([], 0)})], schema)
    got = df.select("qid", F.coalesce(entities.has_label("en"), F.lit(False)), entities.has_value_in("P1", "fr"), entities.has_value_in("P1", "de"), entities.has_value_in("P2", "fr")).collect()
    assert [tuple(r) for r in got] == [("a", True, True, False, False), ("b", False, False, False, False), ("c", False, False, False, False)]


def test_what_a_judge_is_asked(spark):
    from pyspark.sql import functions as F

    from kgloom import providers

    df = spark.createDataFrame([("{truth}", "['x']", [f"d{i}" for i in range(30)], None)], "o string, t string, d array<string>, a array<string>")
    said = df.select(providers.asked_of_judge("country", output=F.col("o"), truth=F.col("t"), demonyms=F.col("d"), aliases=F.col("a"))).first()[0]
    assert "Answer: {truth}\nTruth: ['x']\n" in said and "d19" in said and "d20" not in said and said.endswith("Aliases: ") and "historical_match" in said
    assert df.select(providers.asked_of_judge("pob", output=F.col("o"), truth=F.col("t"))).first()[0].endswith("Truth: ['x']")


def all_alignments(pred, truth, worth):
    """Every way to match words one to one, with its matches, chunks and worth."""
    out = []

    def go(i, used, last, m, chunks, w):
        if i == len(pred):
            out.append((-m, chunks, -w))
            return
        go(i + 1, used, None, m, chunks, w)
        for j in range(len(truth)):
            v = worth(pred[i], truth[j])
            if v and j not in used:
                go(i + 1, used | {j}, j, m + 1, chunks + (last is None or j != last + 1), w + v)

    go(0, frozenset(), None, 0, 0, 0.0)
    m, chunks, w = min(out)
    return -m, pytest.approx(-w), chunks


def test_alignment_of_fewest_chunks_against_all():
    import random

    r = random.Random(8)
    sets = {"cat": {"1"}, "kitty": {"1", "2"}, "pet": {"2"}}
    kinds = [(1.0, lambda x: frozenset([x])), (0.6, lambda x: frozenset([scorers.s_stem(x)])), (0.8, lambda x: frozenset(sets.get(x, ())))]
    worth = lambda x, y: next((v for v, k in kinds if k(x) & k(y)), 0)
    words = ["cat", "cats", "kitty", "pet", "the", "dog", "dogs"]
    for _ in range(300):
        pred, truth = ([r.choice(words) for _ in range(r.randint(0, 6))] for _ in range(2))
        assert scorers.alignment(pred, truth, kinds) == all_alignments(pred, truth, worth), (pred, truth)
    assert scorers.alignment("a b a b c".split(), "b c a b a".split(), kinds[:1]) == (5, 5.0, 2)
    assert [scorers.s_stem(x) for x in "ponies cats glass bus toes plates".split()] == ["pony", "cat", "glass", "bus", "toe", "plate"]


def test_meteor_with_stems_and_synonyms(spark):
    df = spark.createDataFrame([("the cat sat", "the kitty sat"), ("dogs run", "dog run"), ("a b", "c"), ("", "x"), (None, None)], "gt string, llm_output string")
    synonyms = spark.createDataFrame([("cat", 1), ("kitty", 1)], "word string, synset int")
    full = [r["METEOR_full"] for r in scorers.meteor(df, synonyms=synonyms).collect()]
    f = lambda w, n, m, c: 10 * (w / n) ** 2 / (10 * w / n) * (1 - 0.5 * (c / m) ** 3)
    assert full == pytest.approx([f(2.8, 3, 3, 1), f(1.6, 2, 2, 1), 0, 0, 0])
    assert [r["METEOR_full"] for r in scorers.score(df, "meteor", stages=("exact",)).collect()][0] == pytest.approx(f(2, 3, 2, 2))
    with pytest.raises(ValueError):
        scorers.meteor(df, synonyms=synonyms, most=1)
