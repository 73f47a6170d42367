"""Every query with an oracle against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def values(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, db, name):
    df = entry_module.queries()[name](spark, str(DATA))
    want = db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert values(tuple(r) for r in df.select(columns).collect()) == values(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry_module.queries() if n not in ORACLES and not n.startswith("op") and n != "pipeline"))
def test_rows_only(spark, name):
    assert entry_module.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["LoE", "LoQ", "f1"]
