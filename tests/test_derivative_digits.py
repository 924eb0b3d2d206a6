"""Higher derivatives keep the digits that their SQL asks for when sums are as large as on larger tables."""

import duckdb
import pytest

from mwspark.jobs.queries import ORACLES, QUERIES


@pytest.mark.parametrize(("name", "times"), [("i2_second_low_noise", 60), ("i3_third_spline", 600)])
def test_digits_of_large_sums(spark, tmp_path, name, times):
    duck = duckdb.connect()
    path = str(tmp_path / "supplier.parquet")
    duck.execute(f"COPY (SELECT * REPLACE (s_acctbal * {times} AS s_acctbal) FROM '/root/testdata/sf0.01/supplier.parquet') TO '{path}' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW supplier AS FROM '{path}'")
    want = dict(duck.sql(f"SELECT pid, value FROM ({ORACLES[name]})").fetchall())
    got = {r.pid: r.value for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) == 0
