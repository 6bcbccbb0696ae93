import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_core_never_imports_the_subpackage():
    for path in (ROOT / "pitlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "pitlake").parts:
            assert not re.search(r"import.*\bllm\b|from pitlake\.llm", path.read_text()), path


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m == "__spark_entry__" or m.startswith("pitlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pitlake.llm", None)
    import __spark_entry__ as e

    assert "p5_found" in e.queries() and "p1_found" not in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["p4_found", "p6_found", "momentum_rank_ic", "selector_arm", "brake_overlay", "sessions", "graph_neighbours", "box_breakouts", "pair_trades", "bootstrap_blocks", "paper_trading", "fundamentals_known"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e
    import verify

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in folder.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    df, rel = e.queries()[name](spark, str(folder)), db.sql(e.oracle_sql()[name])
    assert verify.rows(df.columns, [tuple(r) for r in df.collect()]) == verify.rows(rel.columns, rel.fetchall())


def test_pushdown_and_pruning(spark):
    import __spark_entry__ as e

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    plan = e.queries()["pricing_summary"](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_suppkey" not in plan
