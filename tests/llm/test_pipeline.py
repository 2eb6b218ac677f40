"""The pipeline: its stages chain, and it loses no clean document."""

import corpus_pipeline
from meshloom.llm import decontamination, packing, quality, simhash


def test_stages_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    sets = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs.where(docs.doc_id.isin(list(kept)))).collect()}
    kept &= {i for i, c in sets.items() if i == c}
    held = {r["doc_id"] for r in decontamination.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == kept - held
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1
