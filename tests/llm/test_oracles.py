"""Operators that SQL can express, against their statements run by DuckDB."""

import duckdb
import pytest

from quarry.llm import queries
from quarry.plans.verify import compare, duck_views
from tests.conftest import SF0001

SQL_ON_TEXTS = ("op1_substring_dedup", "op3_decontaminate", "op9_jaccard_join")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    duck_views(con, SF0001, ("documents", "benchmark", "embeddings"))
    res = compare(spark, con, SF0001, name, queries.QUERIES[name], queries.SQL[name])
    assert res["cols_match"] and res["rows_match"], res
    assert res["rows"] >= 200


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and short texts, repeated ids and rows, odd white space and letters, chains of near copies."""
    words = [f"Wort{i}" for i in range(260)]
    passage = words[40:95]
    near = [" ".join(words[:100][:k] + ["x"] * (k < 100) + words[:100][k + 1 :]) for k in range(88, 101)]
    texts = [None, "", " \t\n", "one", "ONE", "one two\x0bthree four", *near, " ".join(passage), "Vor \n" + "  ".join(passage) + " nach", "ÄÖ äö " + " ".join(passage).upper(), "a-b c_d " * 40, "a-b c_d " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[8]), (7, " ".join(words)), (3, " ".join(words))]
    items = [("b2", " ".join(passage[:14])), ("b1", " ".join(passage[:14])), ("b3", "Four"), ("b4", None), ("b5", "?!"), (None, "one"), ("b6", "a b c")]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", SQL_ON_TEXTS)
def test_odd_rows_against_sql(spark, odd, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{odd}/{table}.parquet/*.parquet')")
    res = compare(spark, con, odd, name, queries.QUERIES[name], queries.SQL[name])
    assert res["cols_match"] and res["rows_match"], res
