"""The jobs: two runs over growing input, reruns, stopped runs, command lines, and the checked index they use."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import candidate_rankings, provenance_catalogue
from jobs.common import config_of
from massloom.sources.index_store import load_index, save_index

DATA = "/root/testdata/sf0.001"
CONFIG = config_of("provenance_catalogue")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def growing(spark, tmp_path):
    """A folder of copies that starts with a part of the documents, and a function that adds the others."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    folder = str(tmp_path / "documents")
    first, later = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    first.coalesce(2).write.parquet(folder)
    return folder, first, docs, lambda: later.coalesce(2).write.mode("append").parquet(folder)


def catalogue(spark, docs, config=CONFIG):
    return rows(provenance_catalogue.catalogue_of(provenance_catalogue.records_of(docs), config))


def test_two_runs_over_growing_documents(spark, tmp_path, growing):
    folder, first, docs, grow = growing
    run = lambda: provenance_catalogue.run(spark, folder, str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG)
    now = lambda: rows(provenance_catalogue.read_catalogue(spark, str(tmp_path / "out")))
    assert run()["new"] == first.count() and now() == catalogue(spark, first)
    assert run() == {"new": 0, "records": first.count(), "catalogue": len(now())} and now() == catalogue(spark, first)
    grow()
    counts = run()
    assert counts["new"] == docs.count() - first.count() and counts["records"] == docs.count()
    assert now() == catalogue(spark, docs) != catalogue(spark, first)
    assert run()["new"] == 0 and now() == catalogue(spark, docs)
    assert {p.name.split("=")[0] for p in (tmp_path / "out" / "catalogue").iterdir() if p.is_dir()} == {"disposition"}


def test_a_later_collection_changes_what_an_earlier_record_is_for(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("documents", "out", "mark"))
    put = lambda *r: spark.createDataFrame(r, provenance_catalogue.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: {(r.first_doc, r.n_records, r.n_words, r.collections, r.disposition) for r in provenance_catalogue.read_catalogue(spark, out).collect()}
    put((5, "a  b", "fr", "src3"), (6, None, None, None), (7, " \n", "fr", None))
    provenance_catalogue.run(spark, folder, out, mark, CONFIG)
    assert read() == {(5, 1, 2, "fr|src3", "excluded"), (6, 2, 0, "fr", "excluded")}
    put((2, "a b ", "fr", "src1"), (8, "new", "xx", "src2"))
    assert provenance_catalogue.run(spark, folder, out, mark, CONFIG)["new"] == 2
    assert read() == {(2, 2, 2, "fr|src1|src3", "approved"), (6, 2, 0, "fr", "excluded"), (8, 1, 1, "src2|xx", "needs_review")}


def test_a_run_that_stopped_before_its_catalogue_is_mended_by_the_next(spark, tmp_path, growing, monkeypatch):
    folder, first, *_ = growing
    args = (spark, folder, str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG)
    with monkeypatch.context() as broken:
        broken.setattr(provenance_catalogue, "catalogue_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            provenance_catalogue.run(*args)
    assert provenance_catalogue.run(*args)["new"] == 0
    assert rows(provenance_catalogue.read_catalogue(spark, args[2])) == catalogue(spark, first)


def test_an_empty_folder_gives_an_empty_catalogue(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    args = (spark, str(tmp_path / "documents"), str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG)
    assert provenance_catalogue.run(*args) == {"new": 0, "records": 0, "catalogue": 0}


def test_rankings_are_the_same_on_a_rerun(spark, tmp_path):
    args = (spark, f"{DATA}/orders.parquet", f"{DATA}/lineitem.parquet", str(tmp_path), config_of("candidate_rankings"))
    counts = candidate_rankings.run(*args)
    before = rows(candidate_rankings.read_rankings(spark, str(tmp_path)))
    assert candidate_rankings.run(*args) == counts and counts["rankings"] == len(before) > 0
    assert rows(candidate_rankings.read_rankings(spark, str(tmp_path))) == before
    got = candidate_rankings.read_rankings(spark, str(tmp_path))
    assert got.groupBy("query").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m > 25 or m <> n").isEmpty()


@pytest.mark.parametrize("job, paths", [("provenance_catalogue", ["documents", "output", "checkpoint"]), ("candidate_rankings", ["orders", "lineitem", "output"])])
def test_command_lines(tmp_path, job, paths):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(config_of(job)))
    args = [a for p in paths for a in (f"--{p}", f"{DATA}/{p}.parquet" if p in ("documents", "orders", "lineitem") else f"{tmp_path}/{p}")]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--config", str(config)], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote" in done.stderr and any((tmp_path / "output").rglob("*.parquet"))


def test_an_index_that_is_not_what_its_manifest_says_is_refused(spark, tmp_path):
    binned = spark.createDataFrame([(1, 0, 1.0, "A"), (2, 3, 0.5, "A"), (2, 4, 0.5, "B")], "spectrum long, bin int, weight double, mode string")
    path = str(tmp_path / "index")
    save_index(binned, path, "spectrum", settings="w=1")
    assert rows(load_index(spark, path, "spectrum", "w=1")) == rows(binned)
    with pytest.raises(ValueError, match="other settings"):
        load_index(spark, path, "spectrum", "w=2")
    binned.where("spectrum = 1").write.mode("overwrite").partitionBy("mode").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="rows is 1, not 3"):
        load_index(spark, path, "spectrum")
    binned.withColumn("bin", F.col("bin") + 1).write.mode("overwrite").partitionBy("mode").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="low_bin is 1, not 0"):
        load_index(spark, path, "spectrum")
    binned.withColumn("spectrum", F.col("spectrum") * 5).write.mode("overwrite").partitionBy("mode").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="digest"):
        load_index(spark, path, "spectrum")
