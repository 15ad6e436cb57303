"""Events relative to a per-entity anchor date (e.g. the day a customer joined).

The anchor table has one row per entity and grows with the number of entities.
Events never meet it row by row: they are first reduced to one row per (entity,
time) with map-side partial aggregation, so an entity that holds a third of all
events sends only its distinct times to the join. Where whole events are wanted,
the chosen (entity, time) pairs pick them in a second join on both columns, which
spreads a hot entity over its times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rank import first_per


def first_anchor(df: DataFrame, key: str, ts: str, out: str = "anchor_date", when: Column | None = None) -> DataFrame:
    """One anchor per entity: the date of its first qualifying row (e.g. first signup)."""
    src = df.filter(when) if when is not None else df
    return src.groupBy(key).agg(F.to_date(F.min(ts)).alias(out))


def with_anchor(events: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Events of entities that have an anchor, with the anchor column attached."""
    return events.join(anchors, key, "inner")


def _at_edge(events: DataFrame, anchors: DataFrame, key: str, ts: str, keep: Column, edge, ties: str, tie_break) -> DataFrame:
    """The events of each entity at the edge (min or max) of its times that pass `keep`."""
    times = with_anchor(events.select(key, ts).distinct(), anchors, key).filter(keep)
    extra = [c for c in anchors.columns if c != key]
    chosen = times.groupBy(key).agg(edge(ts).alias(ts), *[F.first(c).alias(c) for c in extra])
    found = events.join(chosen, [key, ts])
    found = found.select(*events.columns, *extra)
    return found if ties != "first" else first_per(found, key, ts, ties, tie_break)


def first_on_or_after(
    events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor_col: str,
    ties: str = "all", tie_break=(),
) -> DataFrame:
    """Earliest event(s) at or after each entity's anchor."""
    return _at_edge(events, anchors, key, ts, F.col(ts) >= F.col(anchor_col), F.min, ties, tie_break)


def last_before(
    events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor_col: str,
    ties: str = "all", tie_break=(),
) -> DataFrame:
    """Latest event(s) strictly before each entity's anchor."""
    return _at_edge(events, anchors, key, ts, F.col(ts) < F.col(anchor_col), F.max, ties, tie_break)


def per_time(events: DataFrame, keys: list[str], count: str, sums: dict[str, Column | str]) -> DataFrame:
    """Events reduced to one row per `keys`: their number and the named sums."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[F.sum(c).alias(n) for n, c in sums.items()])


def totals_before(
    events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor_col: str,
    count: str, sums: dict[str, Column | str],
) -> DataFrame:
    """Number and sums of each entity's events strictly before its anchor."""
    reduced = with_anchor(per_time(events, [key, ts], count, sums), anchors, key)
    before = reduced.filter(F.col(ts) < F.col(anchor_col))
    return before.groupBy(key).agg(*[F.sum(c).alias(c) for c in (count, *sums)])
