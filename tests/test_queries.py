"""Every named query against its SQL on the smallest tables; those without SQL must give rows."""

import json
import math
import os

import duckdb
import pytest

from textassay.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.12g}" if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = rows(df.columns, df.collect())
    if name not in SQL:
        assert found
        return
    relation = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert found == rows(relation.columns, relation.fetchall())


def test_rows_without_sql_by_python(spark):
    """Queries that SQL cannot express, row by row."""
    import hashlib
    import hmac
    import zlib

    import numpy as np

    from textassay.functions import signals as S

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r.r for r in QUERIES["compression_ratio"](spark, SF).collect()}
    assert found == {i: round(min(1.0, len(zlib.compress(t, 6)) / len(t)), 9) if t else 1.0 for i, t in texts.items()}
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in QUERIES["signed_records"](spark, SF).collect():
        p = parts[r.p_partkey]
        record = f'{{"name":{json.dumps(p.p_name, ensure_ascii=False)},"price":{p.p_retailprice:.9f}}}'
        assert r.valid and r.signature == hmac.new(b"test-key", hashlib.sha256(record.encode()).digest(), hashlib.sha256).hexdigest()
    for r in QUERIES["thompson_draws"](spark, SF).collect():
        assert r.draw == float(np.random.default_rng(int(r.alpha * 1000 + r.beta)).beta(r.alpha, r.beta))
    windows = {}
    for r in sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        windows.setdefault((r.label, r.vec_id // 2560), []).append(r.embedding)
    got = {(r.label, r.part): (r.n, r.coh_star, r.r, r.pca95) for r in QUERIES["vector_signals"](spark, SF).collect()}
    assert got == {k: (len(v), S.coherence(np.array(v, float))[0], S.quantised_ratio(np.array(v, float)), S.pca_dimension(np.array(v, float))) for k, v in windows.items()}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))


def test_whole_boxes_use_every_dimension(spark, tmp_path):
    """Vectors that differ only after the third dimension fall into boxes of their own."""
    rows = [(k, [0.0, 0.0, 0.0, *(float(k >> d & 1) for d in range(4)), 5.0], 1) for k in range(16)] + [(99, [1.0] * 8, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(tuple(r) for r in QUERIES["voxel_counts_whole"](spark, str(tmp_path)).select("label", "scale", "boxes").collect())
    assert found == [(1, 2, 16), (1, 4, 16), (1, 8, 16), (2, 2, 1), (2, 4, 1), (2, 8, 1)]
