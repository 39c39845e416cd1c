"""The pipeline's stages, one after the other, on the smallest of the given tables."""

import corpus_pipeline
from pagelode.llm.queries import QUERIES, table
from pagelode.llm.tables import written

SF = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_the_one_before_has_kept(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SF))
        kept = [r.doc_id for r in made.select("doc_id").collect()]
        assert set(kept) <= ids and len(kept) == len(set(kept)) and kept
        if name != "source mix":
            assert made.columns == columns
        if name == "near duplicates":
            by = {r.doc_id: r.component_id for r in classes_of(docs)}
            assert set(kept) == set(by.values())
        docs, ids = made, set(kept)
    assert {"block", "slot", "position", "balanced"} <= set(docs.columns)
    assert docs.select("position").distinct().count() == docs.count()


def classes_of(docs):
    """Operator 1's classes of these documents."""
    from pagelode.llm import jaccard
    return jaccard.similar_documents(docs).select("doc_id", "component_id").collect()


def test_the_pipeline_is_registered():
    assert "pipeline" in corpus_pipeline.QUERIES and len(QUERIES) == 13


def test_training_gives_its_memory_back():
    """Many blocks that the C library keeps, with one in use above them."""
    import numpy as np

    from pagelode.llm.toxicity import give_back_memory
    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024
    blocks = [np.ones(12_000) for _ in range(2_000)]  # 192 MB
    last = np.ones(12_000)
    held = rss()
    del blocks
    give_back_memory()
    assert rss() < held - 120 and last.sum() == 12_000
