"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_on_smoke_data(spark):
    df = _entry_module().entry(spark)
    assert df.columns == ["o_custkey", "total_spent"] and df.count() > 0


def test_every_query_has_sql_with_matching_keys():
    mod = _entry_module()
    q, sql = mod.queries(), mod.oracle_sql()
    from quarry.plans.catalogue import QUERIES

    assert len(QUERIES) >= 91 and set(QUERIES) <= set(sql) <= set(q)
    assert all(callable(f) for f in q.values()) and all(s.strip() for s in sql.values())


def test_study_runner_usage_and_one_question(spark, capsys):
    from quarry.plans import run

    assert run.main([]) == 2
    assert "python -m quarry.plans.run" in capsys.readouterr().out
    assert run.main(["restaurant", "DD1"]) == 0
    out = capsys.readouterr().out
    assert "DD1" in out and "76" in out
