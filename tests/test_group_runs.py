"""Runs of labels over more ids than one cell holds."""

import duckdb

from codegrain.plans import numeric


def test_runs_cross_cells(spark, tmp_path):
    ids = [*range(99_990, 100_010), 199_999, 200_000, *range(499_998, 500_003), 900_000]
    label = lambda i: None if i in (99_995, 500_000, 500_001) else 3 if i < 100_003 else 4 if i < 500_002 else 5
    rows = [(i, label(i)) for i in ids] + [(100_000, 3), (None, 5)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(numeric.SQL["N23_group_runs"]).fetchall()
    got = [tuple(r) for r in numeric.N23_group_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (99_996, 3, 7) in got and (100_003, 4, 11) in got
