"""Property tests: column helpers against plain-Python references on random inputs.

Each property evaluates one Spark job over a batch of generated rows, so the
number of Spark jobs stays small."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import split_list
from quarry.functions.numeric import exact_mean, round_ratio

SETTINGS = settings(max_examples=15, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.integers(-(10**30), 10**30), st.integers(1, 10**12)), min_size=1, max_size=40))
def test_round_ratio_is_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame([(Decimal(a), b) for a, b in pairs], "a decimal(38,0), b long")
    got = [r[0] for r in df.select(round_ratio("a", "b")).collect()]
    want = [Decimal(a) / Decimal(b) for a, b in pairs]
    for g, (a, b) in zip(got, pairs):
        q, r = divmod(abs(a), b)
        exp = q + (1 if 2 * r >= b else 0)
        assert g == (exp if a >= 0 else -exp)
    assert len(want) == len(got)


@SETTINGS
@given(st.lists(st.lists(st.integers(0, 10**9), min_size=1, max_size=8), min_size=1, max_size=20))
def test_exact_mean_matches_decimal(spark, groups):
    rows = [(gi, Decimal(v).scaleb(-2)) for gi, g in enumerate(groups) for v in g]
    df = spark.createDataFrame(rows, "g int, x decimal(18,2)")
    agg = df.groupBy("g").agg(F.sum((F.col("x") * 100).cast("decimal(18,0)")).alias("s"), F.count("x").alias("n"))
    got = {r.g: r.m for r in agg.select("g", exact_mean("s", "n").alias("m")).collect()}
    for gi, g in enumerate(groups):
        want = (sum(Decimal(v).scaleb(-2) for v in g) / len(g)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert got[gi] == want


token = st.text(alphabet="ab1 ", min_size=0, max_size=4)


@SETTINGS
@given(st.lists(st.lists(token, max_size=5).map(lambda ts: ",".join(ts)), min_size=1, max_size=20))
def test_split_list_trims_and_drops_empty(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.toks for r in df.select("i", split_list("t", ",", None).alias("toks")).collect()}
    for i, t in enumerate(texts):
        want = [p.strip() for p in t.split(",") if p.strip() != ""]
        assert got[i] == want
