"""Kernels outside Spark on tables of few bytes."""

from pyspark.sql import functions as F

from assay.functions import kernels


def test_kernel_meets_one_file_in_many_tasks(spark, tmp_path):
    spark.range(200).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))

    def kernel(frame):
        if (frame["id"] % 5 == 0).any():
            raise ValueError("five")
        return frame.assign(twice=frame["id"] * 2)

    out = kernels.evaluated(rows, kernel, ["id", "twice"], "id long, twice long")
    got = {r.id: (r.twice, r.oracle_error) for r in out.collect()}
    assert got == {k: (None, "ValueError: five") if k % 5 == 0 else (2 * k, None) for k in range(200)}
    assert out.select(F.spark_partition_id()).distinct().count() > 1
