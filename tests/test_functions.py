import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from kgloom.functions import bins, dates, ks, text

ALPHABET = "abAB ßςΣσ éÉ हिन्दी 中文 الع ٣4_-.,/'\"[]()\n\t 　x"


def strings(n, seed, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 18))) for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


def column(spark, values, col):
    return [r["y"] for r in frame(spark, values).select("i", col.alias("y")).orderBy("i").collect()]


def test_casefold_is_pythons(spark):
    values = strings(3000, 1)
    want = [re.sub(r"[^\w\s]", "", v.casefold()).strip() for v in values]
    assert column(spark, values, text.casefold("x")) == want
    assert column(spark, ["ﬁn", "Straße", "ΣΟΦΟΣ", "ŉ ǰ ΐ", "ſt ẞ", "𐐀 ﬃ"], text.casefold("x")) == [re.sub(r"[^\w\s]", "", v.casefold()).strip() for v in ["ﬁn", "Straße", "ΣΟΦΟΣ", "ŉ ǰ ΐ", "ſt ẞ", "𐐀 ﬃ"]]


def test_folding_of_every_character(spark):
    """Of all characters that fold, but those whose lower case differs between Java's Unicode version and Python's."""
    chars = [chr(c) for c in range(0x20, 0x1F000) if chr(c).casefold() != chr(c) and not 0xD800 <= c < 0xE000]
    got = column(spark, chars, text.folded(F.col("x")))
    wrong = [c for c, f in zip(chars, got, strict=True) if f != c.casefold()]
    assert len(wrong) <= 10, wrong


def plain_candidates(raw):
    if not raw.strip():
        return []
    s = re.sub(r"^\[?\s*['\"]?", "", raw.strip())
    s = re.sub(r"['\"]?\s*\]?\Z", "", s).strip()
    s = re.sub(r"\s*\([^)]*\)\s*\Z", "", s).strip()
    if " - " in s:
        left, right = (p.strip() for p in s.split(" - ", 1))
        s = re.sub(r"\s*\[.*?\]\s*\Z", "", right if len(left) > len(right) else s).strip()
    out = [re.sub(r"['\"\[\]()]+", "", c.strip()).strip().split("/")[0].strip() for c in s.split(",")]
    return [c for c in out if c]


def test_candidates(spark):
    values = strings(2000, 2) + ['["Paris (France)"]  ', "Ana Lima - Rio [x]", "A/B, C", "", " ", "['']"] + [f"{a} - {b}" for a, b in zip(strings(400, 3), strings(400, 4), strict=True)]
    assert column(spark, values, text.candidates("x")) == [plain_candidates(v) for v in values]


def test_clean_place(spark):
    def plain(raw):
        s = raw.strip().split("\n")[0].strip()
        s = re.sub(r"['\"\[\]]+", "", s).strip()
        s = re.sub(r"\s*\([^)]*\)\s*\Z", "", s).strip().split(",")[0].strip()
        return s.rstrip(".").strip()

    values = strings(2000, 5)
    assert column(spark, values, text.clean_place("x")) == [plain(v) for v in values]


def test_parse_list(spark):
    r = random.Random(6)
    values = [repr(["".join(r.choice("ab 'é\"\\\n 中") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 3))]) for _ in range(1000)]
    assert column(spark, values, text.parse_list("x")) == [ast.literal_eval(v) for v in values]
    assert column(spark, ["", " ", "plain", "['a', 'b'", "1999-01-01T00:00:00Z", None], text.parse_list("x")) == [[], [], ["plain"], ["a', 'b"], ["1999-01-01T00:00:00Z"], []]


def test_lists_of_translations(spark):
    assert column(spark, ["[a, 'b' ]", "a, b", "[]", '["x"]'], text.split_list("x")) == [["a", "b"], None, [], ["x"]]
    assert column(spark, ['["a"]', '["a","b"]', "[a", "z"], text.unwrap_one("x")) == ["a", '["a","b"]', "[a", "z"]


def test_empty(spark):
    values = ["", "  ", "none", "N/A", "['']", '[""]', "[]", "Null", "no", None]
    assert column(spark, values, text.is_empty("x")) == [True] * 8 + [False, True]
    assert column(spark, values, text.is_empty("x", text.EMPTY_WORD)) == [True, True, True] + [False] * 6 + [True]


def test_prompt_parts(spark):
    values = ["## Do this.  ## Who is it?", "## Do ## Q ## Example"]
    got = column(spark, values, text.split_prompt("x"))
    assert [tuple(r) for r in got] == [("##  Do this.", "##  Who is it?"), ("##  Do ", "##  Q ##  Example")]


def test_model_output(spark):
    assert column(spark, ["a</think>\n b </think>c", "x\n y", "z"], text.without_thoughts("x")) == ["b", "y", "z"]
    assert column(spark, ["prompt and answer"], text.without_echo("x", F.lit("prompt"))) == [" and answer"]
    assert column(spark, ["property_pob_Qwen3-8B_prov.csv", "property_pob_phi-4.csv", "other.csv"], text.model_of("x", "property_pob")) == ["Qwen3-8B", "phi-4", ""]
    assert column(spark, ["Hi {} $1"], text.fill("x", F.lit("$0 {}"))) == ["Hi $0 {} $1"]


def test_dates(spark):
    values = ["1901-03-07T00:00:00Z", " 1901-03-07 ", "born 1901-03-07.", "1923-02-30", "1901", "01901-03-07", "", None]
    part = lambda c: [None if v is None else tuple(v) for v in column(spark, values, c)]
    assert part(dates.parse_date("x")) == [("1901", "03", "07")] * 2 + [None, ("1923", "02", "30")] + [None] * 4
    assert part(dates.find_date("x"))[2] == ("1901", "03", "07") and part(dates.find_date("x"))[5] == ("1901", "03", "07")
    assert column(spark, ["1901x", "190", "abcd"], dates.year("x")) == [1901, None, None]


def test_buckets(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 10, 11, 500, 501, 5000, 5001)], "d int")
    assert [r[0] for r in df.select(bins.year_bucket("d")).collect()] == [None, "0-1", "2-5", "2-5", "6-10", "6-10", "11-50", "101-500", "500+", "500+", None]
    assert bins.edges(9, 23, 5) == [5, 10, 15, 20, 25, 30]
    with pytest.raises(ValueError):
        bins.edges(1, 2, 0)
    assert [tuple(r) for r in df.limit(4).select(bins.left_closed("d", 5), bins.interval(bins.left_closed("d", 5), 5)).collect()] == [(0, "[0, 5)")] * 3 + [(5, "[5, 10)")]


def test_ks_p_values(spark):
    assert ks.p_value(0.053593028170040365, 514, 267) == pytest.approx(0.6674575049226625, rel=1e-10)
    assert ks.p_value(0, 3, 4) == 1 and ks.p_value(1, 3, 3) == pytest.approx(2 / 20)
    brute = paths(4, 5, 0.45)
    assert ks.two_sample(0.45, 4, 5) == pytest.approx(brute)
    assert ks.one_sample(0.274, 10) == pytest.approx(1 - 0.6284796154565043, rel=1e-9)
    # large samples agree with the exact count where both apply
    assert ks.one_sample(0.05, 400) == pytest.approx(0.2623, abs=0.01)
    df = spark.createDataFrame([(0.5, 4, 4)], "d double, n int, m int")
    assert df.select(ks.ks_p("d", "n", "m")).first()[0] == pytest.approx(ks.p_value(0.5, 4, 4))


def paths(n, m, d):
    """Share of all orders of two samples whose distance reaches d."""
    from itertools import combinations

    reach = total = 0
    for at in combinations(range(n + m), n):
        i = j = 0
        most = 0.0
        for k in range(n + m):
            i, j = (i + 1, j) if k in at else (i, j + 1)
            most = max(most, abs(i / n - j / m))
        reach += most >= d - 1e-10
        total += 1
    return reach / total
