"""Every query against its SQL on the smallest tables, and the driver contract."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from terraloom.plans import catalog
from terraloom.session import TABLES

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cursor.fetchall(), names)


def test_queries_without_sql_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_no_nested_loop_joins(spark):
    """Apart from joins with one-row tables (extents, ranges) and the wanted fan-out, no plan pairs everything with everything."""
    one_row = {"infiltration_index", "pixel_centres", "snapshot_fanout"}
    for name, query in catalog.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan or name in one_row or "x0#" in plan and "y1#" in plan, name
        physical = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in physical, name
        assert "BroadcastNestedLoopJoin" not in physical or name in one_row or "y1#" in physical, name


def test_entry_works_without_the_text_operators(tmp_path):
    """Only the files outside the text operators' folders."""
    import shutil

    shutil.copytree(REPO / "terraloom", tmp_path / "terraloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'strata_from_points' in q and not any(n.startswith('op1') for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
