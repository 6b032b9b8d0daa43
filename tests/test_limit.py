"""The row limit on a table longer than it."""

from contrail.plans.registry import QUERIES


def test_first_rows(spark, tmp_path):
    spark.range(6000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r[0] for r in QUERIES["row_limit_first_5000"](spark, str(tmp_path)).collect()]
    assert got == list(range(5000))
