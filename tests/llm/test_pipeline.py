import pytest
from pyspark.sql import functions as F

from .conftest import CLASHING


def test_pipeline_stages(spark, tmp_path, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert docs.count() and not docs.where("NOT round_trip").count()


def test_stages_leave_clashing_columns_alone(spark, tmp_path, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    path = str(tmp_path / "documents.parquet")
    odd.select("*", *(F.lit(name).alias(name) for name in CLASHING)).write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in rows] == [CLASHING], name
