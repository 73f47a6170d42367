from pyspark.sql import functions as F

import corpus_pipeline
from kgloom.llm import registry
from kgloom.llm.common import components


def test_stages_and_run(spark, prose, docs_of, tmp_path):
    item, base = prose.text(25), prose.text(60)
    rows = [(i, prose.text(prose.r.randint(30, 80), "en" if i % 2 else "fr")) for i in range(40)] + [(50, base), (51, base), (52, prose.text(10) + " " + item), (53, "-- 12"), (54, None)]
    docs = docs_of(rows, lang=lambda i: "en" if i % 2 or i >= 50 else "fr", source=lambda i: f"s{i % 3}").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    assert sorted(r["doc_id"] for r in at.collect()) == [*range(40), 50]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {*range(40), 50} and all(0 <= r["shard"] < 24 for r in out)


def test_odd_tables_run_through(spark, prose, docs_of, tmp_path):
    """No rows; and rows with null and repeated ids, further columns of clashing names and no label at all."""
    item = prose.text(25)
    for name, rows in (("none", []), ("odd", [(None, prose.text(40)), (None, None), (3, prose.text(50)), (3, prose.text(50)), (4, "x " + item), (5, "")] + [(i, prose.text(40)) for i in range(10, 20)])):
        at = tmp_path / name
        docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("_id", "law", "shard", "slot", "grown_shard", "entropy", "component_id", "taken")})
        docs.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(1, item)] if rows else [], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        ids = [r["doc_id"] for r in out]
        assert set(ids) <= {i for i, _ in rows} - {4} and (not rows or {3, 10, 19} <= set(ids))


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 14)] == [1] * 13


def test_components_against_union_find(spark, prose):
    edges = [(prose.r.randrange(200), prose.r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in at}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
