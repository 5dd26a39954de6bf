"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from evidencelake import plans
from evidencelake.tables import TABLES


#: What these report is not there on tables as small as these.
MAY_BE_EMPTY = {"rate_limit_audit", "top_growth"}


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, duck, tiny, tmp_path, name):
    out = str(tmp_path / name)
    plans.QUERIES[name](spark, tiny).write.parquet(out)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE o AS {plans.ORACLE[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE g AS SELECT * FROM '{out}/*.parquet'")
    types = [dict(duck.execute(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall()) for t in "og"]
    assert set(types[0]) == set(types[1])
    cols = ", ".join(f'"{c}"' for c in sorted(types[0]))
    if name not in MAY_BE_EMPTY:
        assert duck.execute("SELECT count(*) > 0 FROM g").fetchone()[0]
    for a, b in ("og", "go"):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchone() == (0,)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_has_rows(spark, tiny, name):
    """Their operators are held against literal rows and brute force in the other tests; here the query finds something on the tables."""
    rows = plans.QUERIES[name](spark, tiny).limit(5).collect()
    assert rows and any(v not in (None, "", 0) for v in rows[0])


def test_entry(spark):
    import __spark_entry__ as e


    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_training_data_package():
    import re
    from pathlib import Path

    root = Path(plans.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"evidencelake\.llm|corpus_pipeline", p.read_text()), p
