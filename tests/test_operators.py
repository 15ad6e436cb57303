"""Operator edge cases, and ordered operators against one-task SQL windows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import SF001, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import has_token, measure, money_amount, money_currency, null_if_token, split_list, ts_text
from quarry.functions.numeric import exact_mean, round_ratio
from quarry.operators import audit, lists, rank, sequence, summary
from quarry.sources import table


def test_round_ratio_half_up_exact(spark):
    df = spark.createDataFrame([(D(2003), 200), (D(-2003), 200), (D(1), 3), (D(5), 0), (D(10**20 + 1), 2)],
                               "a decimal(38,0), b long")
    got = [r[0] for r in df.select(round_ratio("a", "b")).collect()]
    assert got == [D(10), D(-10), D(0), None, D(5 * 10**19 + 1)]
    m = spark.range(1).select(exact_mean(F.lit(2003), F.lit(2))).first()[0]
    assert m == D("10.02")  # 2003 cents / 2 = 10.015 -> 10.02


def test_cleaning_expressions(spark):
    df = spark.createDataFrame(
        [("23.4 km", "null", "$ 91000350"), ("15 minute", "2021-01-01 18:15:34", "INR 500"), ("null", "bad", None)],
        "m string, ts string, money string")
    got = df.select(measure("m").alias("m"), ts_text("ts").alias("ts"),
                    money_currency("money").alias("cur"), money_amount("money").alias("amt")).collect()
    assert got[0].m == D("23.40") and got[0].ts is None and got[0].cur == "$" and got[0].amt == D(91000350)
    assert got[1].m == D("15.00") and got[1].ts == dt.datetime(2021, 1, 1, 18, 15, 34) and got[1].cur == "INR"
    assert got[2].m is None and got[2].ts is None and got[2].amt is None


def test_lists_zero_one_many_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "7"), (4, " 1, 2 ,3 ")], "k int, l string")
    assert rows(lists.explode_list(df, "l", out="tok")) == [(3, 7), (4, 1), (4, 2), (4, 3)]
    flags = df.select("k", has_token("l", "2").alias("h"), F.size(split_list("l")).alias("n")).collect()
    assert [(r.k, r.h, r.n) for r in flags] == [(1, None, None), (2, False, 0), (3, False, 1), (4, True, 3)]


def test_null_tokens_exact_match(spark):
    df = spark.createDataFrame([("",), ("null",), ("NaN",), ("NULL",), ("x",)], "v string")
    assert [r[0] for r in df.select(null_if_token("v")).collect()] == [None, None, None, "NULL", "x"]


@pytest.fixture(scope="module")
def groups(spark):
    data = [(f"g{i % 37}", (i * 7919) % 23, i) for i in range(400)] + [(None, 5, 1000), ("gx", None, 1001)]
    return spark.createDataFrame(data, "g string, v int, id int")


def test_global_rank_distributed_equals_window(spark, groups):
    for method, fn in [("rank", F.rank), ("dense_rank", F.dense_rank)]:
        order = [("v", True), ("g", False)]
        want = groups.withColumn("r", fn().over(Window.orderBy(F.col("v").desc_nulls_last(), F.col("g").asc_nulls_first())))
        dist = sequence.global_rank(groups, order, method, "r")
        small = sequence.global_rank(groups, order, method, "r")
        assert rows(dist) == rows(want) == rows(small)


def test_cumulative_distributed_equals_window(spark, groups):
    per = groups.groupBy("g").agg(F.sum("v").cast("decimal(18,2)").alias("m"))
    w = Window.orderBy(F.col("g").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    dist = sequence.cumulative(per, [("g", False)], "m")
    small = sequence.cumulative(per, [("g", False)], "m")
    want = per.select("g", "m", F.sum("m").over(w).alias("running_total"))
    mean = per.select("g", F.round(F.avg("m").over(w), 2).alias("moving_avg"))
    assert rows(dist, "g", "moving_avg") == rows(mean)
    assert rows(dist, "g", "running_total") == rows(small, "g", "running_total") == rows(want, "g", "running_total")
    assert rows(dist) == rows(small)


def test_cumulative_peers_share_total(spark):
    df = spark.createDataFrame([(1, D(1)), (2, D(2)), (2, D(3)), (3, D(4))], "k int, m decimal(10,2)")
    got = rows(sequence.cumulative(df, [("k", False)], "m"), "k", "m", "running_total")
    assert got == [(1, D(1), D(1)), (2, D(2), D(6)), (2, D(3), D(6)), (3, D(4), D(10))]


def test_gap_summary_telescopes(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("a", d(2020, 1, 1)), ("a", d(2020, 1, 1)), ("a", d(2020, 1, 11)), ("b", d(2020, 5, 5)), ("c", None),
         ("c", d(2020, 1, 1)), ("c", d(2020, 1, 4))], "k string, day date")
    got = {r.k: r.avg_gap_days for r in sequence.gap_summary(df, "k", "day").collect()}
    assert got == {"a": D("5.00"), "b": None, "c": D("3.00")}


def test_top_k_ties(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2), ("d", 1)], "k string, n int")
    assert rows(rank.top_k(df, [F.desc("n")], 1, "first", ["k"])) == [("a", 3)]
    assert rows(rank.top_k(df, [("n", True)], 1, "all")) == [("a", 3), ("b", 3)]
    assert rows(rank.top_k(df, [("n", True)], 2, "dense")) == [("a", 3), ("b", 3), ("c", 2)]


def test_rank_of_counts_larger_groups(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", 1)], "g string, n int")
    assert rows(rank.rank_of(df, "g", "n", "a")) == [("a", 5, 3)]


def test_audits(spark):
    fact = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (9, "yy")], "k int, s string")
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(audit.duplicate_keys(fact, ["k"])) == [(1, 2)]
    assert rows(audit.null_keys(fact, ["s"])) == [(2, None)]
    assert rows(audit.orphans(fact, dim, "k")) == [(9, "yy")]
    assert rows(audit.too_long(fact, "s", 1)) == [(9, "yy", 2)]


def test_pivot_counts_zero_for_absent_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(summary.pivot_counts(df, "k", "v", {"n_a": "a", "n_b": "b", "n_c": "c"})) == [(1, 2, 0, 0), (2, 0, 1, 0)]


def test_hot_key_top_per_group(spark):
    """A third of all rows on one key: the top-k per group still keeps k rows."""
    li = table(spark, SF001, "lineitem")
    hot = li.withColumn("l_suppkey", F.when(F.col("l_linenumber") <= 2, F.lit(0)).otherwise(F.col("l_suppkey")))
    best = rank.top_per_group(hot, "l_suppkey", [F.desc("l_extendedprice")], 3, "first", ["l_orderkey", "l_linenumber"])
    counts = dict(best.groupBy("l_suppkey").count().collect())
    assert counts[0] == 3 and max(counts.values()) == 3


@pytest.fixture(scope="module")
def skewed(spark):
    # key 'hot' holds about a third of all rows; a NULL key and NULL values included
    data = []
    for i in range(900):
        k = "hot" if i % 3 == 0 else f"k{i % 41}"
        data.append((k, dt.date(2020, 1, 1) + dt.timedelta(days=(i * 37) % 200), i, None if i % 17 == 0 else i % 11))
    data += [(None, dt.date(2020, 2, 2), 5000, 1), (None, dt.date(2020, 2, 3), 5001, 2)]
    return spark.createDataFrame(data, "k string, day date, id int, v int")


def test_group_rank_distributed_equals_window(spark, skewed):
    order = [("v", True), ("day", False)]
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), F.col("day").asc_nulls_first())
    for method, fn in [("rank", F.rank), ("dense_rank", F.dense_rank)]:
        want = skewed.withColumn("r", fn().over(w))
        got = sequence.group_rank(skewed, "k", order, method, "r")
        assert rows(got) == rows(want)


def test_next_value_distributed_equals_lead(spark, skewed):
    w = Window.partitionBy("k").orderBy(F.col("day").asc_nulls_first(), F.col("id").asc_nulls_first())
    want = skewed.withColumn("nxt", F.lead("v", 1).over(w))
    got = sequence.next_value(skewed, "k", [("day", False), ("id", False)], "v", "nxt")
    assert rows(got) == rows(want)
    gaps = sequence.event_gaps(skewed, "k", "day", ["id"])
    want_days = skewed.withColumn("next_date", F.lead("day", 1).over(w))
    assert rows(gaps) == rows(want_days)


def test_read_text_table_and_stage(spark):
    import pathlib
    import tempfile

    from quarry.sources import read_text_table, save, stage
    from quarry.sources.fixtures import SCHEMAS

    tmp_path = pathlib.Path(tempfile.mkdtemp(prefix="quarry-test-"))
    path = tmp_path / "sales.csv"
    path.write_text("customer_id,order_date,product_id\nA,2021-01-01,1\nB,not a date,x\n")
    df = read_text_table(spark, str(path), SCHEMAS["sales"])
    assert rows(df) == [("A", dt.date(2021, 1, 1), 1), ("B", None, None)]
    stage(df, "sales_stage")
    assert spark.sql("SELECT count(*) FROM sales_stage").first()[0] == 2
    out = str(tmp_path / "saved")
    save(df, out)
    assert spark.read.parquet(out).count() == 2


def test_rate_zero_duration_is_null(spark):
    from quarry.operators import rules

    df = spark.createDataFrame([(D("20.00"), D("32.00")), (D("10.00"), D("0.00"))], "d decimal(10,2), t decimal(10,2)")
    sp = rules.rate("d", "t")
    got = [tuple(r) for r in df.select(sp["speed_kph"], sp["speed_mph"]).collect()]
    assert got == [(D("37.50"), D("23.31")), (None, None)]


def test_round_ratio_large_values_exact(spark):
    big = 10**30 + 7
    df = spark.createDataFrame([(D(big), D(3)), (D(-big), D(3)), (D(10**18 - 1), D(2))], "a decimal(38,0), b decimal(38,0)")
    got = [r[0] for r in df.select(round_ratio("a", "b")).collect()]
    # half away from zero: (10^30 + 7) / 3 = 333...335.67 -> ...336
    assert got == [D((big * 2 + 3) // 6), D(-((big * 2 + 3) // 6)), D((2 * (10**18 - 1) + 2) // 4)]


def test_bucketed_tables_join_without_shuffle(spark):
    import contextlib
    import io

    from conftest import SF0001
    from quarry.sources import save_bucketed

    li = save_bucketed(table(spark, SF0001, "lineitem").select("l_orderkey", "l_extendedprice"), "li_b", ["l_orderkey"], 8)
    o = save_bucketed(table(spark, SF0001, "orders").select("o_orderkey", "o_custkey"), "o_b", ["o_orderkey"], 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.sum("l_extendedprice"))
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            j.explain()
        plan = buf.getvalue()
        assert "SortMergeJoin" in plan
        # the only exchange left is the aggregation on o_custkey, none under the join
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(o_custkey" in plan
        assert j.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_range_split_spreads_a_hot_key(spark, skewed):
    """The distributed paths sort slices, not groups: a key with a third of all
    rows is cut across several range partitions."""
    ranged = sequence._range_split(skewed, ["k"], [F.col("day").asc_nulls_first(), F.col("id").asc_nulls_first()])
    parts = {r["_range_part"]: r["count"] for r in ranged.filter("k = 'hot'").groupBy("_range_part").count().collect()}
    total = skewed.count()
    hot = skewed.filter("k = 'hot'").count()
    assert hot >= total // 3 - 1
    assert len(parts) >= 2 and max(parts.values()) < hot


def plan_text(df, mode="simple"):
    """The static plan with broadcasts and AQE off."""
    import contextlib
    import io

    spark = df.sparkSession
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.select("*").explain(mode)
        return buf.getvalue()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_joins_carry_no_hint(spark):
    from quarry.operators.joins import join_dim

    fact = spark.range(1000).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" not in plan_text(join_dim(fact, fact.limit(5).distinct(), "k"))


def test_hot_user_is_reduced_before_the_anchor_join(spark):
    """Whatever a join on the entity alone receives is aggregated per (entity, day) first."""
    import re

    from quarry.operators import anchor

    ev = spark.range(3000).selectExpr("id AS event_id", "IF(id % 3 = 0, 0, id % 50) AS user_id",
                                      "date_add(DATE'2024-01-01', CAST(id % 45 AS INT)) AS day", "id % 97 AS v").repartition(4)
    anchors = ev.groupBy("user_id").agg(F.date_add(F.min("day"), 20).alias("a"))
    for res in (
        anchor.first_on_or_after(ev, anchors, "user_id", "day", "a"),
        anchor.last_before(ev, anchors, "user_id", "day", "a"),
        anchor.totals_before(ev, anchors, "user_id", "day", "a", "n", {"v": "v"}),
    ):
        lines = plan_text(res).splitlines()
        for k, line in enumerate(lines):
            if m := re.search(r"Exchange hashpartitioning\((user_id#\d+L?), \d+\)", line):
                assert "HashAggregate" in lines[k + 1], (m.group(0), lines[k + 1])


def test_top_k_ties_across_partitions(spark):
    """All rows tied: every one is kept, by a join, and no window holds more than k rows."""
    df = spark.range(2000).selectExpr("id", "CAST(5 AS BIGINT) AS n", "CAST(NULL AS INT) AS z").repartition(6)
    for ties in ("all", "dense"):
        got = rank.top_k(df, [("n", True), ("z", False)], 3, ties, out="r")
        assert got.count() == 2000 and [r["r"] for r in got.select("r").distinct().collect()] == [1]
    df = spark.createDataFrame([(1, 9), (2, 9), (3, 7), (4, 7), (5, 7), (6, 3), (7, None)], "id int, n int")
    assert rows(rank.top_k(df, [("n", True)], 3, "all", out="r"), "id", "r") == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    assert rows(rank.top_k(df, [("n", True)], 3, "dense", out="r"), "id", "r") == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3)]
    assert rows(rank.top_k(df, [("n", False)], 1, "all"), "id") == [(7,)]


def test_cumulative_rounds_last(spark):
    """Three means of a third: rounded first they would add up to 0.99."""
    units = spark.createDataFrame([(g, D(3333333333)) for g in "abc"], "g string, u decimal(38,0)")
    got = rows(sequence.cumulative(units, [("g", False)], "u", units_scale=10), "g", "running_total", "moving_avg")
    assert [(g, str(t), str(m)) for g, t, m in got] == [("a", "0.33", "0.33"), ("b", "0.67", "0.33"), ("c", "1.00", "0.33")]


def test_rank_of_ignores_case_and_reads_the_groups_once(spark):
    df = spark.createDataFrame([("Drama", 5), ("THRILLER", 3), ("War", 9)], "genre string, n int")
    assert rows(rank.rank_of(df, "genre", "n", "thriller", "r"), "genre", "n", "r") == [("THRILLER", 3, 3)]
    assert rank.rank_of(df, "genre", "n", "none").count() == 0


def test_ranks_are_long(spark):
    df = spark.range(5)
    assert dict(sequence.global_rank(df, [("id", False)], out="r").dtypes)["r"] == "bigint"


def test_a_file_added_to_a_table_is_read(spark, tmp_path):
    from quarry.sources import table

    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    assert table(spark, str(tmp_path), "t").count() == 10
    spark.range(5).write.mode("append").parquet(path)
    assert table(spark, str(tmp_path), "t").count() == 15


def test_anchor_operators_with_a_hot_user(spark):
    """One user owns a third of all events; results equal brute-force SQL."""
    import duckdb

    from quarry.operators import anchor

    rows_ = []
    for i in range(1500):
        user = 0 if i % 3 == 0 else 1 + i % 50
        kind = "signup" if i % 11 == 0 else "purchase"
        rows_.append((i, user, kind, dt.date(2024, 1, 1) + dt.timedelta(days=(i * 7) % 45), float(i % 97)))
    schema = "event_id long, user_id long, event_type string, day date, value double"
    ev = spark.createDataFrame(rows_, schema)
    anchors = anchor.first_anchor(ev, "user_id", "day", "join_date", F.col("event_type") == "signup")
    buys = ev.filter("event_type = 'purchase'")
    first = anchor.first_on_or_after(buys, anchors, "user_id", "day", "join_date").select("user_id", "event_id")
    last = anchor.last_before(buys, anchors, "user_id", "day", "join_date").select("user_id", "event_id")
    tot = anchor.totals_before(buys, anchors, "user_id", "day", "join_date", "n", {})

    con = duckdb.connect()
    con.execute(f"CREATE TABLE ev ({schema.replace('long', 'BIGINT').replace('string', 'VARCHAR')})")
    con.executemany("INSERT INTO ev VALUES (?, ?, ?, ?, ?)", rows_)
    base = """WITH a AS (SELECT user_id, MIN(day) AS j FROM ev WHERE event_type = 'signup' GROUP BY user_id),
              b AS (SELECT ev.*, a.j FROM ev JOIN a USING (user_id) WHERE event_type = 'purchase')"""
    want_first = con.execute(base + """ SELECT user_id, event_id FROM b WHERE day >= j
        QUALIFY RANK() OVER (PARTITION BY user_id ORDER BY day) = 1""").fetchall()
    want_last = con.execute(base + """ SELECT user_id, event_id FROM b WHERE day < j
        QUALIFY RANK() OVER (PARTITION BY user_id ORDER BY day DESC) = 1""").fetchall()
    want_tot = con.execute(base + " SELECT user_id, COUNT(*) FROM b WHERE day < j GROUP BY user_id").fetchall()
    assert rows(first) == sorted(want_first)
    assert rows(last) == sorted(want_last)
    assert rows(tot) == sorted(want_tot)
    assert any(u == 0 for u, _ in want_first)  # the hot user is in the answer


def test_decode_list_separator_with_quote(spark):
    df = spark.createDataFrame([(1, "2,1")], "k int, l string")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    got = lists.decode_list(df, "k", "l", dim, "id", "name", out_sep="' \\\\ ").collect()
    assert got[0]["labels"] == "a' \\\\ b"


def test_decoded_list_takes_the_name_of_its_column(spark):
    df = spark.createDataFrame([(1, "2,1", "x")], "k int, l string, other string")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert rows(lists.decode_list(df, "k", "l", dim, "id", "name", out="l")) == [(1, "a, b")]
    assert rows(lists.decode_list(df, "k", "l", dim, "id", "name", out="Other")) == [(1, "a, b")]


# ---- orderings: boundary rows --------------------------------------------------------


@pytest.fixture(scope="module")
def long_runs(spark):
    """Runs of equal keys and groups that span many slices, single-row groups, NULLs."""
    data = [("a", 5, i, i % 7) for i in range(150)] + [("a", i % 3, 200 + i, None) for i in range(60)]
    data += [("b", 1, 300 + i, 2) for i in range(40)] + [(None, None, 400 + i, 1) for i in range(30)]
    data += [(f"s{i}", i % 2, 500 + i, i) for i in range(25)]
    return spark.createDataFrame(data, "g string, k int, id int, v int").repartition(3)


@pytest.fixture(params=[1, 3, 16, 61])
def slices(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("desc", [False, True])
def test_ranks_over_runs_that_span_slices(spark, long_runs, slices, desc):
    order = [F.col("k").desc_nulls_last() if desc else F.col("k").asc_nulls_first()]
    for method, fn in (("rank", F.rank), ("dense_rank", F.dense_rank)):
        want = long_runs.withColumn("r", fn().over(Window.orderBy(*order)).cast("bigint"))
        assert rows(sequence.global_rank(long_runs, [("k", desc)], method, "r")) == rows(want)
        want = long_runs.withColumn("r", fn().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
        assert rows(sequence.group_rank(long_runs, "g", [("k", desc)], method, "r")) == rows(want)


def test_totals_over_runs_that_span_slices(spark, long_runs, slices):
    df = long_runs.select("k", "id", F.col("v").cast("decimal(10,2)").alias("m"))
    w = Window.orderBy(F.col("k").asc_nulls_first())
    want = df.withColumn("running_total", F.sum("m").over(w))
    assert rows(sequence.cumulative(df, [("k", False)], "m"), "k", "id", "running_total") == rows(want, "k", "id", "running_total")


def test_next_value_over_slices(spark, long_runs, slices):
    w = Window.partitionBy("g").orderBy(F.col("k").desc_nulls_last(), F.col("id").asc_nulls_first())
    want = long_runs.withColumn("nxt", F.lead("v", 1).over(w))
    assert rows(sequence.next_value(long_runs, "g", [("k", True), ("id", False)], "v", "nxt")) == rows(want)


@pytest.mark.parametrize("run", [
    lambda df: sequence.global_rank(df, [("k", False)], out="r"),
    lambda df: sequence.group_rank(df, "g", [("k", False)], "dense_rank", "r"),
    lambda df: sequence.cumulative(df.withColumn("m", F.col("v").cast("decimal(10,2)")), [("k", False)], "m"),
    lambda df: sequence.next_value(df, "g", [("id", False)], "v"),
])
def test_orderings_pin_once_and_join_back_nothing(spark, long_runs, run, monkeypatch):
    pins = []
    pinned = sequence._pinned
    monkeypatch.setattr(sequence, "_pinned", lambda df: pins.append(df) or pinned(df))
    res = run(long_runs)
    assert len(pins) == 1 and run(long_runs.limit(0)).collect() == []
    # the rows meet only the broadcast carry, one row per slice; none of them moves again
    plan = plan_text(res)
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    big = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in big
    first = plan_text(pins[0])
    assert first.count("Exchange rangepartitioning") == 1 and first.count("Exchange hashpartitioning") == 1


# ---- what reaches a shuffle -----------------------------------------------------------


def test_key_filter_keeps_all_matches(spark):
    from quarry.operators import prefilter

    keys = spark.range(0, 5000, 7).union(spark.createDataFrame([(-5,), (2**62,), (None,)], "id long"))
    facts = spark.range(-100, 6000).union(spark.createDataFrame([(None,), (2**62,)], "id long")).withColumn("x", F.lit(1))
    for bits in (64, 1 << 12, 1 << 25):
        kept = [r["id"] for r in prefilter.may_match(facts, "id", keys, "id", bits).collect()]
        wanted = {r["id"] for r in facts.join(keys, "id", "left_semi").collect()}
        assert wanted <= set(kept) and None not in kept and len(kept) == len(set(kept))
    assert set(kept) == wanted  # few keys, many bits
    assert prefilter.key_filter(spark.range(100_000), "id", 1 << 10).count() == 16  # bounded by the bits


def test_count_distinct_whole(spark):
    values = [0, 1, 63, 64, 64, -1, -64, -65, 2**63 - 1, -(2**63), None, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    assert summary.count_distinct_whole(df, "k").collect()[0][0] == len({v for v in values if v is not None})
    assert summary.count_distinct_whole(df.limit(0), "k").collect()[0][0] == 0
    dense = summary.count_distinct_whole(spark.range(64_000).withColumnRenamed("id", "k"), "k")
    assert dense.collect()[0][0] == 64_000


def test_footer_profile_reads_footers_only(spark, tmp_path):
    from quarry.operators import profile

    path = str(tmp_path / "t.parquet")
    data = [(i, None if i % 3 else i - 50, float("nan")) for i in range(100)]
    spark.createDataFrame(data, "a long, b int, x double").repartition(4).write.parquet(path)
    res = profile.footer_profile(spark, path, ["a", "b"])
    assert rows(res) == [("a", 100, 100, 0, 99), ("b", 100, 34, -50, 49)]
    assert "PushedAggregation: [COUNT(*), COUNT(a), MIN(a), MAX(a)" in plan_text(res, mode="formatted")
    counts = profile.row_counts_from_footers(spark, {"t": path})
    assert rows(counts) == [("t", 100)] and "PushedAggregation: [COUNT(*)]" in plan_text(counts, mode="formatted")
    with pytest.raises(ValueError):
        profile.footer_profile(spark, path, ["x"])  # NaN is not in the footers


def test_each_list_is_translated_once(spark):
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string")
    df = spark.createDataFrame([(i, "3, 1,9" if i % 2 else "4") for i in range(1000)] + [(1001, None), (1002, "9"), (1003, "")], "k int, l string")
    got = lists.decode_list(df, "k", "l", dim, "id", "name")
    assert rows(got) == [(i, "n1, n3" if i % 2 else "n4") for i in range(1000)]
    exploded = got._jdf.queryExecution().optimizedPlan().toString()
    below = exploded[exploded.index("Generate explode"):]
    assert "Aggregate [_of" in below  # only distinct lists are exploded


# ---- replacing a table -----------------------------------------------------------------


def test_replace_reads_the_table_it_replaces(spark, tmp_path):
    from quarry.sources import replace

    path = str(tmp_path / "t")
    first = replace(spark.range(10).withColumn("x", F.lit("old")), path)
    assert first.count() == 10
    second = replace(first.filter("id >= 4").select("id", F.lit("new").alias("x")), path)
    assert rows(second) == [(i, "new") for i in range(4, 10)] == rows(spark.read.parquet(path))
    third = replace(second.groupBy("x").count(), path, partition_by=["x"])
    assert rows(third, "x", "count") == [("new", 6)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # nothing left beside it


def test_failed_replace_keeps_the_old_rows(spark, tmp_path):
    from quarry.sources import replace

    path = str(tmp_path / "t")
    old = replace(spark.range(100), path)
    broken = old.select(F.when(F.col("id") > 50, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        replace(broken, path)
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(100)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
