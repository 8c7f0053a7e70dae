"""Numbers written with nine decimals, as SQL writes them."""

import duckdb

from textassay.plans import catalog


def test_dataset_hash_rounds_as_sql_does(spark, tmp_path):
    """Binary halves at the tenth decimal, signed zeros, odd numbers, nulls."""
    halves = [k / 1024 for k in (1, 3, 5, -1, -3, 7)]
    rows = [
        (1, 10, halves), (1, 9, [0.1, None, -0.0]), (1, 9, [-1e-12, 0.3]), (2, 1, [float("nan"), float("inf"), float("-inf")]), (2, None, [1.0]), (2, 0, None),
        (3, 5, None), (3, 6, []), (4, 7, [None, None]), (None, 8, [0.5]), (None, None, None), (5, 11, [1e30, 123456.789]),
    ]
    spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.sql("SELECT label, dataset_hash FROM (" + catalog.oracle_sql()["dataset_hash"] + ")").fetchall()}
    found = [(r.label, r.dataset_hash) for r in catalog.queries()["dataset_hash"](spark, str(tmp_path)).collect()]
    assert len(found) == len(want) == 6 and dict(found) == want
