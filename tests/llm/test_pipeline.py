"""The stages keep what they should, and each works on what the one before kept."""

import corpus_pipeline as p


def test_stages(spark, docs, labels, none, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= kept.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
        out.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert p.STAGES[-1][1](spark, kept, str(tmp_path)).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
