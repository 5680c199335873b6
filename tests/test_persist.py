import pytest
from pyspark.sql import functions as F

from tessera import persist


def test_cut_drop_and_bounded_groups(spark):
    import pyarrow.parquet as pq

    df = spark.range(100).coalesce(1)
    a = persist.cut(df, "a", rows_together=8)
    files = [f.removeprefix("file://") for f in a.inputFiles()]
    assert max(pq.ParquetFile(f).metadata.row_group(0).num_rows for f in files) == 8
    assert a.agg(F.sum("id")).first()[0] == 4950
    b = persist.cut(df.limit(0), "b")
    assert b.count() == 0 and b.dtypes == df.dtypes
    persist.drop_cut(a)
    with pytest.raises(Exception):
        a.count()
    persist.drop_all(spark)
    with pytest.raises(Exception):
        spark.read.parquet(files[0])
