"""Each stage against a plain version, on documents that hold something for each."""

import corpus_pipeline
from massloom.llm import pieces, quality_rules

from . import test_decontaminate, test_line_dedup, test_ngram_join
from .conftest import prose


def test_stages_match_plain_versions(spark, tmp_path):
    bench = prose(500, 30)
    texts = [f"{prose(k, 60)}.\n{prose(k + 50, 60)}." for k in range(20)]
    texts += [texts[0].replace("garden", "forest", 1), texts[1] + " one more", "### &&& $$$ *** %%% " * 30, "TEN WORDS!! " * 40, "short text", None, f"{prose(90, 40)} {bench} {prose(91, 40)}."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    texts_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = stages["quality rules"](spark, docs, str(tmp_path))
    want = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert set(texts_of(good)) == want and not want & {22, 23, 24, 25} and set(range(20)) <= want
    lines = stages["line dedup"](spark, good, str(tmp_path))
    assert texts_of(lines) == {i: t for i, t in test_line_dedup.brute(sorted(texts_of(good).items())).items() if t.strip()}
    once = stages["n-gram Jaccard join"](spark, lines, str(tmp_path))
    classes = test_ngram_join.brute(sorted(texts_of(lines).items()))
    assert set(texts_of(once)) == {i for i, (_, c) in classes.items() if i == c}
    clean = stages["benchmark decontamination"](spark, once, str(tmp_path))
    assert set(texts_of(clean)) == {i for i, t in texts_of(once).items() if not test_decontaminate.brute(t, [bench])} and 26 not in texts_of(clean)
    ids = stages["SentencePiece encoding"](spark, clean, str(tmp_path))
    assert texts_of(pieces.decode(ids, pieces.default_model())) == texts_of(clean)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts_of(clean)) and all(r.n_pieces for r in out)
