import re

import corpus_pipeline
from fragmill.llm import pii
from tests.llm.test_classifiers import corpus
from tests.llm.test_decontaminate import MORE
from tests.llm.test_minhash import brute


def tables(spark, folder):
    rows, labels = corpus(300)
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows if i is not None]
    rows += [(1000 + i, rows[i][1], "en", "s", len(rows[i][1])) for i in range(5)]
    rows += [(2000, "x " + MORE + " y", "en", "s", 1), (2001, "mail me at jo@ex.org or call +1 (988) 555-2485 now", "de", "t", 50), (2002, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, MORE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, {i: t for i, _, t in labels}


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    rows, toxic = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            seen[name] = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None)
    left = {i for i, _ in seen["toxicity"]}
    clean = [i for i, t in toxic.items() if not t]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    assert sum(i in left for i, t in toxic.items() if t) <= 0.2 * sum(toxic.values())
    kept = {x[0] for x in brute(sorted({i: t for i, t in seen["toxicity"]}.items())) if x[3]}
    assert {i for i, _ in seen["near_dedup"]} == kept and len(seen["near_dedup"]) == len(kept)
    assert {i for i, _ in seen["near_dedup"]} - {i for i, _ in seen["decontamination"]} == {2000}
    assert [i for i, _ in seen["pii"]] == [i for i, _ in seen["decontamination"]]
    assert dict(seen["pii"])[2001] == "mail me at <EMAIL> or call <PHONE> now"
    for _, t in seen["pii"]:
        assert not pii.base_spans(t)
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in seen["pii"]} | {2002} | ({r[0] for r in rows if r[1] is None})
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stage_names():
    assert [re.sub("_", " ", n) for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near dedup", "decontamination", "pii", "packing"]


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
