"""Driver contract smoke test and a DuckDB spot check on sf0.001."""
import duckdb

import __spark_entry__ as E
from panelkit.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "adjusted_sharpe" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


def test_oracle_spot_check(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("s5_adjusted_sharpe", "w3_rolling_std", "f13_corr_matrix", "v1_time_folds"):
        a = E.queries()[name](spark, SF).collect()
        b = con.execute(E.oracle_sql()[name]).fetchall()
        assert _norm(a) == _norm(b), name
