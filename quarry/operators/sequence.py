"""Order-dependent operators that must not run in one task: whole-table ranks,
running totals over ordered groups, and gaps between consecutive events.

A window with ORDER BY and no PARTITION BY sends every row to a single task, and one
with PARTITION BY sends a hot group to one. Both are computed in slices instead:

  1. the rows are range-partitioned on (group, order keys) into slices; where the
     operator allows it, also on a random number, so that a very long run of equal keys
     spans several slices like any other stretch;
  2. a window inside each slice gives the local result (rank, running total, next
     value) and marks the slice's first and last row; this is pinned with
     `checkpoint()` in the session's checkpoint folder, because a range split that is
     computed twice may fall differently;
  3. only the boundary rows, at most two of each slice, tell what a slice continues:
     just the first group of a slice can have begun before it, and just its first
     and last run of equal keys can be shared with a neighbour. Windows over these few
     rows give each slice its carry;
  4. the carries, one row for each slice (bounded by the partition count), are
     broadcast to the pinned rows and added.

So the input is computed once, its rows move twice (range split, slice) and are pinned
once, and no result is joined back to them. There is one path, whatever the size
of the input.

Pinned tables are checkpoints in `spark.checkpoint.dir`; with
`spark.cleaner.referenceTracking.cleanCheckpoints` (set by `build_session`) Spark
deletes them once the result that reads them is no longer referenced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

_PART, _FIRST, _LAST, _SPREAD = "_range_part", "_slice_first", "_slice_last", "_spread"


def _sort_cols(order_by: list[tuple[str, bool]]):
    # descending keys put NULLs last, ascending keys put NULLs first (SQL default
    # of the studied engine and of Spark)
    return [
        F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first()
        for c, desc in order_by
    ]


def _pinned(df: DataFrame) -> DataFrame:
    """`df` computed once, in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_split(df: DataFrame, partition_by: list[str], order, spread_peers: bool = False) -> DataFrame:
    """Range-partition `df` on (partition_by, order) and tag each row with its slice.
    With `spread_peers` a run of equal keys may be cut anywhere. The split must be used
    in one place only, and pinned."""
    by = [F.col(c).asc_nulls_first() for c in partition_by] + list(order)
    if spread_peers:
        df, by = df.withColumn(_SPREAD, F.rand(0)), [*by, F.col(_SPREAD)]
    return df.repartitionByRange(_partitions(df), *by).withColumn(_PART, F.spark_partition_id()).drop(_SPREAD)


def _in_slice(groups: list[str], order):
    """The order of a whole slice. A window by (slice, group) has the same sort."""
    return Window.partitionBy(_PART).orderBy(*[F.col(c).asc_nulls_first() for c in groups], *order)


def _marked(df: DataFrame, whole) -> DataFrame:
    """Adds marks of the first and the last row of each slice."""
    first, last = F.row_number().over(whole) == 1, F.lead(F.lit(1)).over(whole).isNull()
    return df.select("*", first.alias(_FIRST), last.alias(_LAST))


def _ends(marked: DataFrame, cols: list[str], amounts: list[str]) -> DataFrame:
    """The boundary rows: (slice, end, cols), end 0 for the first and 1 for the last row,
    which alone carries the `amounts` out of the slice, as `_out<amount>`."""
    end = F.explode(F.array_compact(F.array(F.when(F.col(_FIRST), 0), F.when(F.col(_LAST), 1))))
    rows = marked.filter(F.col(_FIRST) | F.col(_LAST)).select(_PART, end.alias("_end"), *cols)
    carried = [F.first(F.when(F.col("_end") == 1, F.col(c))).alias(f"_out{c}") for c in amounts]
    return rows.groupBy(_PART, "_end").agg(*[F.first(c).alias(c) for c in cols], *carried)


def _same(names: list[str], other: str = "_c_"):
    """Null-safe equality of the named columns with those of the carry."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(other + c))
    return same


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(carry), _PART)  # one row per slice: bounded by the partition count


def global_rank(
    df: DataFrame,
    order_by: list[tuple[str, bool]],
    method: str = "rank",
    out: str = "rnk",
    partition_by: list[str] | tuple = (),
) -> DataFrame:
    """RANK / DENSE_RANK over `order_by` [(column, descending)], over the whole
    table or within each `partition_by` group.

    Equal keys share a rank, as the SQL functions do. The result keeps every
    input row and adds `out` (BIGINT). No task sorts more than its slice,
    however large one group or one run of equal keys is.

    Carry of a slice: for its first group, the rows (dense: the keys) of the
    group in earlier slices; for its first run of equal keys, the rank at which that run
    began (dense: one key less, if the previous slice ended in the same run).
    """
    if method not in ("rank", "dense_rank"):
        raise ValueError("global_rank supports 'rank' and 'dense_rank'")
    dense = method == "dense_rank"
    groups, keys = list(partition_by), [c for c, _ in order_by]
    order = _sort_cols(order_by)
    local = Window.partitionBy(_PART, *groups).orderBy(*order)
    # the marks first: rows dealt by slice are also dealt by (slice, group), not the other way round
    marked = _marked(_range_split(df, groups, order, spread_peers=True), _in_slice(groups, order))
    # what the group holds of the slice up to this run: keys, or rows with all peers
    place = (F.dense_rank() if dense else F.rank()).over(local).cast("bigint")
    ranked = _pinned(marked.select("*", place.alias("_r"), (place if dense else F.count(F.lit(1)).over(local)).alias("_upto")))

    ends = _ends(ranked, [*groups, *keys, "_r", "_upto"], ["_upto"])
    along = Window.partitionBy(*groups).orderBy(_PART, "_end")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_out_upto").over(earlier), F.lit(0))
    previous = F.lag(F.struct(*keys)).over(along)
    ends = ends.withColumn("_before", before).withColumn("_previous", previous)
    if dense:
        shared = F.col("_previous").isNotNull() & (F.col("_end") == 0)
        for c in keys:
            shared = shared & F.col("_previous").getField(c).eqNullSafe(F.col(c))
        ends = ends.withColumn("_shared", shared.cast("bigint"))
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = ends.withColumn("_before", F.col("_before") - F.sum("_shared").over(upto))
        ends = ends.withColumn("_began", F.col("_before") + 1)
    else:
        began = F.min(F.col("_before") + F.col("_r")).over(Window.partitionBy(*groups, *keys))
        ends = ends.withColumn("_began", began)
    carry = ends.filter("_end = 0").select(_PART, *[F.col(c).alias(f"_c_{c}") for c in groups], "_before", "_began")
    result = F.when(~_same(groups), F.col("_r")).when(F.col("_r") == 1, F.col("_began")).otherwise(F.col("_before") + F.col("_r"))
    return _with_carry(ranked, carry).select(*df.columns, result.cast("bigint").alias(out))


def group_rank(
    df: DataFrame, partition_by, order_by: list[tuple[str, bool]], method: str = "rank",
    out: str = "rnk",
) -> DataFrame:
    """Full per-group RANK / DENSE_RANK (no top-k cut), safe for a group that
    holds a large share of all rows. See `global_rank`."""
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    return global_rank(df, order_by, method, out, groups)


def cumulative(
    df: DataFrame,
    order_by: list[tuple[str, bool]],
    metric: str,
    total_col: str = "running_total",
    mean_col: str = "moving_avg",
    mean_scale: int | None = 2,
    units_scale: int | None = None,
) -> DataFrame:
    """Running total and cumulative mean of `metric` in `order_by` order.

    RANGE semantics of an ordered window with no frame: a row's total includes
    every row with an equal sort key (peers). The mean is total / rows so far;
    with `mean_scale` it is rounded half up exactly from the decimal total.

    With `units_scale` the metric is in whole 10^-units_scale units (e.g. means that
    must not be rounded before they are summed); the total is summed in them and
    rounded half up to `mean_scale` last, as is the mean.

    Carry of a slice: the totals of all earlier slices, and for its last run of
    equal keys the total at the end of that run, in whichever slice it ends.
    """
    from quarry.functions.numeric import exact_mean, round_ratio, units_to_decimal

    def finish(res: DataFrame) -> DataFrame:
        # SUM and AVG skip NULL metrics: the mean divides by the non-NULL count,
        # and a total over no non-NULL value is NULL.
        total = F.when(F.col("_cnt") > 0, F.col("_total"))
        if units_scale is not None:
            step = F.lit(Decimal(10 ** (units_scale - mean_scale))).cast("decimal(38,0)")
            mean = exact_mean(total, F.col("_cnt").cast("decimal(20,0)") * step, mean_scale)
            total = units_to_decimal(round_ratio(total, step), mean_scale)
        elif mean_scale is None:
            mean = total / F.col("_cnt")
        else:
            units = (total * F.lit(10**mean_scale)).cast("decimal(38,0)")
            mean = exact_mean(units, F.col("_cnt"), mean_scale)
        return res.select(*df.columns, total.alias(total_col), mean.alias(mean_col))

    keys = [c for c, _ in order_by]
    order = _sort_cols(order_by)
    whole = _in_slice([], order)  # no frame: peers of the slice are included
    summed = _range_split(df, [], order, spread_peers=True)
    summed = summed.withColumn("_sum", F.coalesce(F.sum(metric).over(whole), F.lit(0))).withColumn("_n", F.count(metric).over(whole))
    summed = _pinned(_marked(summed, whole))

    ends = _ends(summed, [*keys, "_sum", "_n"], ["_sum", "_n"])
    earlier = Window.orderBy(_PART, "_end").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*keys).orderBy(_PART, "_end").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    amounts = ("_sum", "_n")
    ends = ends.select("*", *[F.coalesce(F.sum(f"_out{v}").over(earlier), F.lit(0)).alias(f"_before{v}") for v in amounts])
    ends = ends.select("*", *[F.last(F.col(f"_before{v}") + F.col(v)).over(run).alias(f"_through{v}") for v in amounts])
    carry = ends.filter("_end = 1").select(
        _PART, *[F.col(c).alias(f"_c_{c}") for c in keys], "_before_sum", "_before_n", "_through_sum", "_through_n"
    )
    rows = _with_carry(summed, carry)
    for v, name in (("_sum", "_total"), ("_n", "_cnt")):
        rows = rows.withColumn(name, F.when(_same(keys), F.col(f"_through{v}")).otherwise(F.col(f"_before{v}") + F.col(v)))
    return finish(rows)


def next_value(
    df: DataFrame,
    key,
    order_by: list[tuple[str, bool]],
    value: str,
    out: str = "next_value",
) -> DataFrame:
    """LEAD(value, 1) OVER (PARTITION BY key ORDER BY order_by): each row gets
    the `value` of the entity's next row, NULL for the last.

    `order_by` should be a total order within the entity (add a tie-break
    column), as for any LEAD. The rows are range-partitioned on (key, order), so a
    large entity is split across slices. Inside a slice, LEAD over the slice gives the next row
    of whatever entity, and its value counts if the entity is the same.

    Carry of a slice: the entity and value of the next slice's first row, for the
    slice's last row only.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = _sort_cols(order_by)
    whole = _in_slice(keys, order)
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(value).alias("v"))
    led = _range_split(df, keys, order).withColumn("_next", F.lead(row).over(whole))
    led = _pinned(led.withColumn(_FIRST, F.row_number().over(whole) == 1))

    firsts = led.filter(_FIRST).groupBy(_PART).agg(F.first(row).alias("_row"))
    carry = firsts.select(_PART, F.lead("_row").over(Window.orderBy(_PART)).alias("_coming"))
    following = F.coalesce("_next", "_coming")  # the last row of a slice has no next row inside it
    same = following.isNotNull()
    for i, c in enumerate(keys):
        same = same & following.getField(f"k{i}").eqNullSafe(F.col(c))
    return _with_carry(led, carry).select(*df.columns, F.when(same, following.getField("v")).alias(out))


def event_gaps(
    df: DataFrame, key, date_col: str, tie_break=(), out: str = "next_date",
) -> DataFrame:
    """Each event with the date of the entity's next event (LEAD 1 over date and
    the tie-break columns); NULL for the last. Distributed via `next_value`.
    For summaries use `gap_summary`, which needs no ordering at all."""
    order = [(date_col, False)] + [(c, False) for c in tie_break]
    return next_value(df, key, order, date_col, out)


def gap_summary(df: DataFrame, key, date_col: str, scale: int = 2, extra_aggs: dict | None = None) -> DataFrame:
    """Mean gap in days between an entity's consecutive events, plus counts.

    Consecutive gaps of the date-sorted events telescope: their sum is
    last - first, and there are (dated events - 1) of them, whatever the order of
    events on the same day. So mean gap = datediff(max, min) / (n_dated - 1),
    NULL for fewer than two dated events. One hash aggregate with partial
    aggregation: no per-entity sort, so an entity with a third of all rows costs
    no more than any other slice of the table.

    Columns: key..., n_events, n_dated, first_date, last_date, avg_gap_days, and
    any `extra_aggs` {name: aggregate Column} computed in the same aggregate.
    """
    from quarry.functions.numeric import exact_mean

    keys = [key] if isinstance(key, str) else list(key)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(date_col).alias("n_dated"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        *[c.alias(n) for n, c in (extra_aggs or {}).items()],
    )
    span_units = F.datediff(F.col("last_date"), F.col("first_date")).cast("decimal(38,0)") * F.lit(10**scale)
    gaps = F.col("n_dated") - 1
    return agg.withColumn(
        "avg_gap_days",
        F.when(gaps > 0, exact_mean(span_units, gaps, scale)),
    )
