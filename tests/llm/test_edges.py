"""Every query, operator and stage on odd rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from massloom import llm
from massloom.llm import decontaminate, line_dedup, ngram_join, pii, quality_rules

DOCUMENT_QUERIES = [q for q in llm.queries() if q not in ("op10_url_filters", "op11_prefix_trie")]


@pytest.fixture(scope="session", autouse=True)
def benchmarks(spark, odd_dir, none_dir):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    items.write.parquet(f"{odd_dir}/benchmark.parquet")
    items.where("false").write.parquet(f"{none_dir}/benchmark.parquet")
    marks = spark.createDataFrame([(k, k % 2, "x") for k in range(1, 9)] + [(4, 1, "x"), (None, 1, "x"), (5, None, "x"), (6, 7, "x")], "doc_id long, toxic int, text string")
    marks.write.parquet(f"{odd_dir}/labels.parquet")
    marks.where("false").write.parquet(f"{none_dir}/labels.parquet")


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_rows(spark, odd_dir, name):
    got = llm.queries()[name](spark, odd_dir)
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted([1, 2, 3, None, 4, 4, 5, 6, 7, 8, -9], key=str)


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_tables(spark, none_dir, name):
    assert llm.queries()[name](spark, none_dir).count() == 0


def test_odd_and_empty_pages(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "http://a.com/en/1"), (3, "http://a.com/en/1"), (3, "http://a.com/en/1"), (4, "http://" + "x" * 100_000 + ".net/de/" + "y" * 100_000), (5, "no host"), (6, "://"), (7, "http://Ü.org/es/\n")]
    pages = spark.createDataFrame([(i, u, "k", True, "h", "p") for i, u in rows], "page_id long, url string, key string, listed boolean, host string, path string")
    pages.write.parquet(f"{tmp_path}/odd/pages.parquet")
    pages.where("false").write.parquet(f"{tmp_path}/none/pages.parquet")
    query = llm.queries()["op10_url_filters"]
    got = query(spark, f"{tmp_path}/odd").collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert {r.page_id: r.verdict for r in got} == {1: "allow", 2: "allow", None: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block"}
    assert query(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, none, odd_dir, none_dir, name, stage):
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    out = stage(spark, odd, odd_dir)
    assert out.count() >= 1
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
        assert stage(spark, odd.select(keep), odd_dir).columns == keep
    assert stage(spark, none, none_dir).count() == 0


def test_pipeline_runs(spark, odd_dir, none_dir):
    assert corpus_pipeline.run(spark, odd_dir).where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, none_dir).count() == 0


def test_other_columns_pass(odd):
    others = [c for c in odd.columns if c != "text"]
    for f in (line_dedup.dedup, lambda d: pii.pseudonymise(d, b"k").drop("pii__kinds")):
        assert sorted(map(str, f(odd).select(others).collect())) == sorted(map(str, odd.select(others).collect()))
    kept = ngram_join.keep_one(odd).select("doc_id").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, 3, None, 4, 4, 6, 7, 8, -9], key=str)
    assert quality_rules.keep_good(odd).where(F.col("doc_id") == 5).count() == 1
    assert decontaminate.remove(odd, odd.where("doc_id = 5")).where("doc_id in (4, 5)").count() == 0
