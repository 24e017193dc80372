"""Readers see what is in a table now."""

from tabtrail.sources.tables import read_table


def test_a_table_written_again_is_read_anew(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").count() == 3
    spark.range(5).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").count() == 5
    spark.range(5, 6).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert sorted(r.id for r in read_table(spark, str(tmp_path), "t").collect()) == list(range(6))
