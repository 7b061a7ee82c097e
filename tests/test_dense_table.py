"""Queries over order lines that fill their volume with one value but for a voxel, and whose ranges tie: large tables come to that."""

import duckdb
import pytest
from compare import assert_same, connect

from voxlake.plans.registry import QUERIES, SQL

LINES = """SELECT (55 * (z + 63)) % 64 * 65 AS l_orderkey, (x + 59) % 64 AS l_partkey, (y + 192 - 3 * ((x + 59) % 64)) % 64 AS l_suppkey, CAST(1 AS INTEGER) AS l_linenumber,
50.0e0 AS l_quantity, CASE WHEN z = 24 AND y = 3 AND x = 18 AND {hole} THEN 'N' ELSE 'A' END AS l_returnflag FROM range(64) a(z), range(64) b(y), range(64) c(x)"""


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    out = {}
    for hole in (True, False):
        out[hole] = str(tmp_path_factory.mktemp("dense"))
        duckdb.execute(f"COPY ({LINES.format(hole=hole)}) TO '{out[hole]}/lineitem.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("hole", [True, False])
@pytest.mark.parametrize("name", ["a20_append_last_wins", "b1_encode_decode_bound", "p8_signed_distance", "s11_coalesce_ranges", "s11_coalesce_ranges_capped"])
def test_same_rows_where_the_volume_is_full(spark, dense, name, hole):
    con = connect(dense[hole])
    if name.startswith("s11"):
        assert con.execute("SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey % 4, l_orderkey)").fetchone()[0] == 1024
    assert_same(QUERIES[name](spark, dense[hole]), con, SQL[name])


def test_the_capped_runs_of_tied_ranges_don_t_depend_on_their_order(dense):
    con = connect(dense[True])
    for name in ("s11_coalesce_ranges", "s11_coalesce_ranges_capped"):
        assert con.execute(f"SELECT count(*), min(n), max(n), max(run_end - run_start) FROM ({SQL[name]})").fetchone() == (256, 1024, 1024, 500)


@pytest.mark.parametrize("name", ["s11_coalesce_ranges", "s11_coalesce_ranges_capped"])
def test_equal_ranges_are_in_one_run(spark, tmp_path, name):
    """Sparse ranges of which many are equal, in no order: a running sum by rows leaves one of two equals in the run before."""
    lines = "SELECT CAST(hash(i) % 20000 AS BIGINT) * 4 AS l_orderkey, CAST(hash(i + 7) % 4 AS BIGINT) AS l_suppkey, CAST(1 + hash(i * 3) % 2 AS DOUBLE) AS l_quantity FROM range(60000) t(i)"
    duckdb.execute(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert_same(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), SQL[name])
