"""The stages one after another against what each must do to its own input."""

import corpus_pipeline
from codefacts.llm.common import saved
from tests.llm.test_lsm_dedup import brute
from tests.llm.test_simhash_copies import slow_kept
from tests.llm.test_toxicity_knn import corpus


def test_stages(spark, frame, tmp_path):
    rows, labels, toxic = corpus(500, 3)
    rows += [(1000 + i, t) for i, t in rows[:60]] + [(2000 + i, t.replace(" ", "\n ", 3)) for i, t in rows[100:140]] + [(3000, "REHA!! " * 60), (None, "ha re ti"), (3001, None)]
    docs = frame(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    before, pairs = docs, lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, before, str(tmp_path)), name)
        was = pairs(before)
        if name != "packing":
            assert after.columns == docs.columns
            assert set(pairs(after)) <= set(was)
        if name == "toxicity":
            left = {i for i, _ in pairs(after)}
            assert len(toxic & left) <= 0.05 * len(toxic) and len({i for i, _ in was} - toxic - left - {1000 + i for i in toxic} - {2000 + i for i in toxic}) <= 5
        if name == "quality":
            assert len(pairs(after)) >= 0.9 * len(was)
        if name == "exact_dedup":
            assert sorted((i for i, _ in pairs(after)), key=repr) == sorted((b[0] for b in brute(was) if b[3]), key=repr)
        if name == "near_dedup":
            assert pairs(after) == slow_kept(was)
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {i for i, _ in was}
        before = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == before.count()
