"""Every registered query of the subpackage runs over the smallest tables and keeps its columns."""

import pytest

from codegrain.llm.queries import queries

FOUND = {"p1_found": ["file_id_a", "file_id_b"], "p2_found": ["file_id"], "p3_found": ["file_id"], "p4_found": ["file_id"], "p5_found": ["file_id_a", "file_id_b"], "p8_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and {t for _, t in df.dtypes} == {"bigint"}
        assert len(rows) == len(set(rows)) and all(r[0] < r[1] for r in rows if len(r) == 2)


@pytest.mark.parametrize("name", sorted(__import__("codegrain.llm.sql", fromlist=["SQL"]).SQL))
def test_query_equals_sql(spark, sf_dir, name):
    from pathlib import Path

    import duckdb

    from codegrain.llm.sql import SQL

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    df = queries()[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))
