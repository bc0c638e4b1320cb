"""The pipeline's stages one after the other."""
import corpus_pipeline
from stratapanel.llm.common import staged


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, staged(stage(spark, docs, sf), name)
        assert docs.columns == was.columns and docs.join(was, "doc_id", "left_anti").count() == 0
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_registered(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
