from __future__ import annotations

from texts import documents, empty, prose, saved

import corpus_pipeline
from cellweave.llm import decontamination, packing, quality, simhash
from cellweave.llm.common import written


def tables(spark, tmp_path):
    item = prose(900, 30)
    docs = [(k, prose(k, 60).capitalize() + ".", "en", f"s{k % 3}", 1) for k in range(150)] + [(200 + k, "spam " * 20 + "!!!", "en", "bad", 1) for k in range(50)]
    docs += [(300 + k, prose(7, 60).capitalize() + ".", "en", "s1", 1) for k in range(40)] + [(400, prose(901, 30) + " " + item + ".", "en", "s0", 1)]
    labels = [(i, int(i < 200), 0) for i, *_ in docs if i < 250 and i % 2]
    return saved(
        tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"),
    )


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    d = tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()}
    labels, bench = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    scores = {r["doc_id"]: r["keep"] for r in quality.scored(docs, labels).collect()}
    kept = written(docs.where(docs["doc_id"].isin([i for i, k in scores.items() if k])), "kept")
    low = {r["doc_id"] for r in simhash.near_duplicates(kept).collect() if r["doc_id"] == r["component_id"]}
    hit = {r["doc_id"] for r in decontamination.benchmark_hits(docs, bench).collect() if len(r["hits"])}
    assert ids == low - hit and hit == {400} and 7 in ids and not any(300 <= i < 340 for i in ids) and not any(200 <= i < 250 for i in ids)
    packed = packing.best_fit_packing(docs.where(docs["doc_id"].isin(list(ids))))
    assert packed.count() == corpus_pipeline.run(spark, d).count()


def test_every_stage_but_the_last_returns_the_columns_of_documents(spark, tmp_path):
    d = tables(spark, tmp_path)
    for table in (documents(spark), empty(spark)):
        columns = table.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = written(stage(spark, table, d), "stage")
            assert table.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, d).columns[:2] == ["doc_id", "piece"]
