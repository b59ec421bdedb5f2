"""The pipeline on odd and empty tables."""
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SCHEMA, odd_documents  # noqa: E402


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, data):
    import corpus_pipeline
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, rows in (("odd", odd_documents()), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert {p.doc_id for p in pieces} <= {r[0] for r in rows}
        for group in {p.sequence_id for p in pieces}:
            parts = sorted((p.offset, p.length) for p in pieces if p.sequence_id == group)
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
