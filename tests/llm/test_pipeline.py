from collections import Counter

import corpus_pipeline
from tidemark.llm import exact_dedup, near_dedup, packing, quality
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    before = first
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
        if name == "quality rules":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            want = {r["doc_id"] for r in quality.judge(before, labels).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        elif name == "exact dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["keep_id"] for r in exact_dedup.exact_groups(before).collect()}
        elif name == "near dedup":
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in near_dedup.near_groups(before).collect()}
        elif name == "packing":
            n = Counter(r["doc_id"] for r in before.collect())
            firsts = Counter(r["doc_id"] for r in docs.where("piece = 0").collect())
            assert firsts == n
            assert docs.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
