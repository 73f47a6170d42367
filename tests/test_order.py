import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import order, stats


@pytest.fixture
def spread(spark):
    """Many small ranges, so that numbers have to go on over them."""
    for k, v in (("spark.sql.shuffle.partitions", "13"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    yield spark
    for k, v in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.enabled", "true")):
        spark.conf.set(k, v)


def test_numbers_have_no_gaps_and_follow_the_order(spread):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 3]), f"id{i}") for i in range(500)]
    df = spread.createDataFrame(rows, "n int, id string").repartition(6)
    got = [x["id"] for x in order.numbered(df, F.desc_nulls_last("n"), "id").orderBy("rank").collect()]
    assert got == [i for n, i in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))]
    assert sorted(x["rank"] for x in order.numbered(df, "n").collect()) == list(range(1, 501))


def test_one_value_in_all_rows_is_dealt_out(spread):
    df = order.in_ranges(spread.range(4000).select(F.lit(7).alias("x"), "id"), "x")
    sizes = [r["count"] for r in df.groupBy("_range").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 2000
    assert sorted(r["rank"] for r in order.numbered(df.select("x", "id"), "x").collect()) == list(range(1, 4001))


def test_batches_of_all_ids(spread):
    ids = spread.createDataFrame([(f"Q{i}",) for i in range(1234)], "qid string").repartition(5)
    got = order.batched(ids, 100, F.length("qid"), "qid").collect()
    assert {r["qid"]: r["batch"] for r in got} == {f"Q{i}": i // 100 for i in range(1234)}
    assert order.batched(ids.limit(0), 100, "qid").collect() == []


@pytest.mark.parametrize("kind", ["int", "double"])
def test_quantiles_equal_percentile(spread, kind):
    r = random.Random(3)
    value = (lambda: r.choice([None, r.randint(0, 50), 7, 7])) if kind == "int" else (lambda: r.choice([None, r.random() * 1e6, 0.5]))
    rows = [(g, value()) for g in ["a"] * 900 + ["b"] * 7 + [None] * 60 + ["c"] for _ in (0,)] + [("none", None)]
    df = spread.createDataFrame(rows, f"g string, x {kind}").repartition(5)
    want = df.where("x IS NOT NULL").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.99, 1.0)))).alias("p")).collect()
    got = order.quantiles(df, "x", {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.99, "hi": 1.0}, "g").collect()
    assert {r["g"]: tuple(r)[1:] for r in got} == {r["g"]: tuple(r["p"]) for r in want}
    whole = order.quantiles(df, "x", {"m": 0.5}).first()["m"]
    assert whole == df.agg(F.percentile("x", 0.5)).first()[0]


def test_summaries_of_several_keys(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0), ("a", 2, 1.0), (None, 1, 4.0), (None, 1, None)], "g string, h int, x double")
    got = {(r["g"], r["h"]): (r["n"], r["median"], r["std"], r["p90"]) for r in stats.summarize(df, "x", "g", "h").collect()}
    assert got == {("a", 1): (2, 6.0, pytest.approx(2**0.5), pytest.approx(6.8)), ("a", 2): (1, 1.0, 0.0, 1.0), (None, 1): (1, 4.0, 0.0, 4.0)}
