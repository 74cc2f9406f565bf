"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from compare import frames_equal

from terragrain import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(name, spark, data, duck):
    got = q.QUERIES[name](spark, data).toPandas()
    assert len(got)
    assert name in q.ORACLES
    frames_equal(got, duck.sql(q.ORACLES[name]).df())


def test_window_then_rows_where_no_point_reaches(spark, tmp_path):
    """Points so far out that some rows between them have no populated node, only nodes that the window has filled."""
    rows = [(k, [0.03 * (k % 5), 0.05 * (k // 5) + 0.2 * (k // 15), 0.1 * k], k % 10) for k in range(30)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = q.QUERIES["grid_fill_window_then_rows"](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
        frames_equal(got, c.sql(q.ORACLES["grid_fill_window_then_rows"]).df())
        reached = {j for (j,) in c.sql(q.grid_sql("emb", 2.0) + "SELECT DISTINCT j FROM n").fetchall()}
    assert set(got.j) == reached and len(reached) <= max(reached)  # some row is not reached


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
