"""Ranking with an explicit tie policy.

Tie policies:
  "all"   keep every tied row            (RANK  ... = k)
  "dense" ranks without gaps             (DENSE_RANK)
  "first" keep one row per position      (ROW_NUMBER, tie broken by `tie_break`)

Top-k per group is written as window + filter on the rank; Spark plans it as a
partial `WindowGroupLimit` before the shuffle and a final one after, so a hot
group is cut down to k rows per input partition before it is moved. Whole-table
ranks over many rows use `quarry.operators.sequence.global_rank`, which never
funnels the table through one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.sequence import _sort_cols, global_rank

_RANKERS = {"all": F.rank, "dense": F.dense_rank, "first": F.row_number}


def _cols(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def _order(cols) -> list[Column]:
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in _cols(cols)]


def rank_within(
    df: DataFrame,
    partition_by,
    order_by,
    ties: str = "all",
    tie_break=(),
    out: str = "rnk",
) -> DataFrame:
    """Add a per-group rank column `out` (INT) with a window partitioned by group.

    Use it under a rank filter (`top_per_group`), where Spark cuts each group to
    k rows before the shuffle; for a full rank of groups that may be very large,
    use `quarry.operators.sequence.group_rank`.
    """
    order = _order(order_by) + (_order(tie_break) if ties == "first" else [])
    w = Window.partitionBy(*_cols(partition_by)).orderBy(*order)
    return df.withColumn(out, _RANKERS[ties]().over(w))


def top_per_group(
    df: DataFrame,
    partition_by,
    order_by,
    k: int = 1,
    ties: str = "all",
    tie_break=(),
    out: str | None = None,
) -> DataFrame:
    """Rows ranked <= k inside each group; `out` keeps the rank column if named."""
    name = out or "_rank"
    ranked = rank_within(df, partition_by, order_by, ties, tie_break, name)
    kept = ranked.filter(F.col(name) <= k)
    return kept if out else kept.drop(name)


def first_per(df: DataFrame, key, order_col: str, ties: str = "all", tie_break=()) -> DataFrame:
    """Earliest row(s) per entity."""
    return top_per_group(df, key, [F.col(order_col).asc_nulls_last()], 1, ties, tie_break)


def last_per(df: DataFrame, key, order_col: str, ties: str = "all", tie_break=()) -> DataFrame:
    """Latest row(s) per entity."""
    return top_per_group(df, key, [F.col(order_col).desc_nulls_last()], 1, ties, tie_break)


def _specs(order_by) -> list[tuple[str, bool]]:
    """(column, descending) pairs; a bare name is ascending."""
    return [(c, False) if isinstance(c, str) else tuple(c) for c in ([order_by] if isinstance(order_by, str) else order_by)]


def top_k(
    df: DataFrame,
    order_by,
    k: int,
    ties: str = "first",
    tie_break=(),
    out: str | None = None,
) -> DataFrame:
    """Highest k rows of the whole table.

    "first": sort + limit, planned as TakeOrderedAndProject (each task keeps its
    own k best, the driver merges k x tasks rows).
    "all"/"dense": `order_by` is a list of (column, descending). The sort keys of the
    first k rows (for "dense": of the first k distinct keys) come from the same kind
    of sort + limit and are ranked among themselves, at most k rows; the rows that
    have one of them are kept by a join, so ties beyond k never meet in one task.
    NULLs sort last in descending and first in ascending order.
    """
    if ties == "first":
        order = _order(order_by) + _order(tie_break)
        res = df.orderBy(*order).limit(k)
        if out:
            res = res.withColumn(out, F.row_number().over(Window.orderBy(*order)))
        return res
    specs = _specs(order_by)
    order = _sort_cols(specs)
    names = [c for c, _ in specs]
    keys = df.select(*names)
    keys = (keys.distinct() if ties == "dense" else keys).orderBy(*order).limit(k)
    name = out or "_rank"
    keys = keys.withColumn(name, _RANKERS[ties]().over(Window.orderBy(*order))).distinct()
    right = keys.select(*[F.col(c).alias(f"_k_{c}") for c in names], name)
    same = [df[c].eqNullSafe(right[f"_k_{c}"]) for c in names]
    kept = df.join(F.broadcast(right), same, "inner").drop(*[f"_k_{c}" for c in names])
    return kept if out else kept.drop(name)


def mode_per_group(
    df: DataFrame,
    group,
    item,
    ties: str = "all",
    count_col: str = "n",
    tie_break=(),
) -> DataFrame:
    """Most frequent item(s) per group, with the count.

    The count is a hash aggregate with map-side partial counts, so a hot group
    is reduced before the shuffle; the rank then runs over (group, item) counts.
    """
    g, i = _cols(group), _cols(item)
    counts = df.groupBy(*g, *i).agg(F.count(F.lit(1)).alias(count_col))
    tb = _cols(tie_break) or i
    return top_per_group(counts, g, [F.col(count_col).desc()], 1, ties, tb)


def rank_of(
    grouped: DataFrame,
    group_col: str,
    metric_col: str,
    value: str,
    out: str = "rank",
) -> DataFrame:
    """Rank (descending metric, ties share) of one named group (any case) among all groups.

    rank = 1 + number of groups with a larger metric. The group's metric is a scalar
    subquery over the same grouped result, with no filter below it, so that both read
    one and the same shuffle; the rest is one global aggregate.
    """
    named = F.lower(F.col(group_col)) == F.lit(value.lower())
    v = grouped.select(F.max(F.when(named, F.col(metric_col)))).scalar()
    res = grouped.agg(
        F.max(F.when(named, F.col(group_col))).alias(group_col),
        F.max(F.when(named, F.col(metric_col))).alias(metric_col),
        (F.count_if(F.col(metric_col) > v) + 1).cast("bigint").alias(out),
    )
    return res.filter(F.col(group_col).isNotNull())


def weighted_rank(
    df: DataFrame,
    key,
    value_units,
    weight,
    min_support: int = 0,
    tie_desc: str | None = "weight_total",
    out: str = "rnk",
    scale: int = 2,
    count=None,
) -> DataFrame:
    """Entities ranked by weighted mean sum(v*w)/sum(w), with minimum support.

    `value_units` is the value in whole 10^-scale units (e.g. cents); the mean is
    rounded half up to `scale` exactly. Columns: key..., n, weight_total,
    weighted_mean, out. Ties on the mean are broken by `tie_desc` (descending)
    and share a rank beyond that. Rows already reduced name the column of their
    number of rows in `count` (`weight` is then their total weight). The rank is computed without a single-task
    window (see `global_rank`).
    """
    from quarry.functions.numeric import exact_mean

    k = _cols(key)
    w = F.col(weight) if isinstance(weight, str) else weight
    v = F.col(value_units) if isinstance(value_units, str) else value_units
    agg = df.groupBy(*k).agg(
        (F.count(F.lit(1)) if count is None else F.sum(count)).alias("n"),
        F.sum(w.cast("decimal(18,0)")).alias("weight_total"),
        F.sum(v.cast("decimal(18,0)") * w.cast("decimal(18,0)")).alias("_vw"),
    )
    agg = agg.filter(F.col("n") >= min_support)
    agg = agg.withColumn("weighted_mean", exact_mean("_vw", "weight_total", scale)).drop("_vw")
    order = [("weighted_mean", True)] + ([(tie_desc, True)] if tie_desc else [])
    return global_rank(agg, order, out=out)


def in_top_categories(df: DataFrame, category: str, k: int, weight: str | None = None) -> DataFrame:
    """Rows of the `k` categories with most rows (or most `weight`), ties by name.

    The category set is cut with sort + limit (at most k rows by construction) and
    joined back to the same `df`. Both branches keep the same filters and columns, and
    the join is an inner one, which is not pushed below an aggregate, so that they
    read one shuffle. Rows without a category or weight belong to none.
    """
    df = df.filter(F.col(category).isNotNull())
    if weight is not None:
        df = df.filter(F.col(weight) > 0)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    top = df.groupBy(category).agg(size.alias("_n")).orderBy(F.desc("_n"), F.asc(category)).limit(k)
    return df.join(F.broadcast(top.select(category)), category).select(*df.columns)


def top_per_group_within_top_categories(
    df: DataFrame,
    category: str,
    k_categories: int,
    partition_by,
    order_by,
    k: int,
    ties: str = "all",
    out: str | None = None,
    weight: str | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Top-k rows per group, counted only inside the best `k_categories` categories.

    `weight` sizes the categories (default: rows); `then` adds what the ranking needs
    (e.g. a join) after the categories are cut.
    """
    inside = in_top_categories(df, category, k_categories, weight)
    return top_per_group(then(inside) if then else inside, partition_by, order_by, k, ties, out=out)


def top_entity_then_partner(
    sales: DataFrame,
    entity: str,
    link: str,
    partners: DataFrame,
    partner: str,
    amount: str,
    entity_k: int = 1,
    partner_k: int = 1,
) -> DataFrame:
    """Best entity by total amount, then its best partner(s) by amount with it.

    `sales` has the amount of each (entity, link), in any number of rows; `partners` maps each
    link to its partner. The totals are partial sums, so no sale moves for them; the
    chosen entities (at most `entity_k` rows by construction) are broadcast to a second
    scan, and only their sales meet the partners.
    """
    sales = sales.filter(F.col(entity).isNotNull() & F.col(link).isNotNull())
    best = sales.groupBy(entity).agg(F.sum(amount).alias("_total")).orderBy(F.desc("_total"), F.asc(entity)).limit(entity_k)
    chosen = sales.join(F.broadcast(best.select(entity)), entity).join(partners, link)
    per_partner = chosen.groupBy(entity, partner).agg(F.sum(amount).alias(amount))
    return top_per_group(per_partner, entity, [F.col(amount).desc()], partner_k, "first", [partner])


__all__ = [
    "first_per", "global_rank", "in_top_categories", "last_per", "mode_per_group", "rank_of", "rank_within",
    "top_entity_then_partner", "top_k", "top_per_group", "top_per_group_within_top_categories",
    "weighted_rank",
]
