"""Rows that fill no quarter: the queries work at any number of rows, as their SQL does."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import difference
from helpers import frame

from marginwise import catalog
from marginwise.operators import pairs, ranks


@pytest.mark.parametrize("name", ["kernel_pairs_blocked", "replicate_sum"])
@pytest.mark.parametrize("n", [102, 105])
def test_queries_at_uneven_numbers(spark, tmp_path, name, n):
    rng = np.random.default_rng(n)
    X = rng.normal(size=(n, 6)) * 0.4
    table = {"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(X.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(rng.integers(0, 10, n), pa.int64())}
    pq.write_table(pa.table(table), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert difference(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path)) is None


def test_the_remainder_begins_a_replicate(spark):
    rows = ranks.positions(frame(spark, np.zeros((43, 1))).select("id"), "id")
    got = {r["id"]: (r["replicate"], r["block"]) for r in pairs.assign_replicates(rows, 43, remainder=True).collect()}
    assert len(got) == 43 and [got[k] for k in (0, 39, 40, 41, 42)] == [(0, 0), (3, 3), (4, 0), (4, 0), (4, 0)]
    with pytest.raises(ValueError, match="multiple of four"):
        pairs.assign_replicates(rows, 43)
