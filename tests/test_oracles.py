"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from support import ROOT, SF

sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402
from epochgraph.plans import queries as core  # noqa: E402

SQL = core.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(con, df, sql, folder):
    df.write.parquet(f"{folder}/found")
    con.sql(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    con.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{folder}/found/*.parquet'")
    columns = {t: {r[0]: r[1] for r in con.sql(f"DESCRIBE {t}").fetchall()} for t in ("want", "got")}
    assert sorted(columns["want"]) == sorted(columns["got"])
    select = {t: ", ".join(f"{c}::TIMESTAMP" if "TIMESTAMP" in columns[t][c] else c for c in sorted(columns[t])) for t in columns}
    for a, b in (("want", "got"), ("got", "want")):
        rest = con.sql(f"SELECT {select[a]} FROM {a} EXCEPT ALL SELECT {select[b]} FROM {b}").fetchall()
        assert not rest, (len(rest), a, rest[:3])


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, tmp_path, name):
    compare(duck, entry.queries()[name](spark, SF), SQL[name], tmp_path)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
