"""Lists held in text columns: one row per token, decoding ids to names,
token frequencies.

`explode` over `split` replaces both a join against a table of numbers and a
session-variable row counter; there is no cap on list length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import split_list
from quarry.operators.rank import top_k


def explode_list(
    df: DataFrame, col: str, sep: str = ",", dtype: str | None = "int",
    out: str = "token", keep: list[str] | None = None, position: str | None = None,
) -> DataFrame:
    """One row per token of the delimited text `col` (rows with no tokens vanish).

    `keep` lists the columns carried along (default: all but `col`); `position`
    names an optional 1-based token position column.
    """
    carried = keep if keep is not None else [c for c in df.columns if c != col]
    arr = split_list(F.col(col), sep, dtype)
    if position:
        return df.select(*carried, F.posexplode(arr).alias("_pos", out)).withColumn(
            position, F.col("_pos") + 1
        ).drop("_pos")
    return df.select(*carried, F.explode(arr).alias(out))


def decode_list(
    df: DataFrame, row_key, col: str, dim: DataFrame, dim_key: str, dim_label: str,
    sep: str = ",", dtype: str = "int", out: str = "labels", out_sep: str = ", ",
) -> DataFrame:
    """Replace a list of ids by the list of their labels, ordered by id.

    Each distinct list is decoded once and joined back to the rows that have it, so the
    tokens that move are those of the dictionary of lists, not of all rows; `row_key`
    names the columns kept. Ids that the dimension lacks are left out of the labels, and
    rows without any known id are left out of the result, as in an inner join.
    """
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    return translate_list(df, col, sep, dtype, dim, dim_key, dim_label, out, out_sep).select(*keys, out)


def translate_list(
    df: DataFrame, col: str, sep: str, dtype: str | None, dim: DataFrame, dim_key: str, dim_label: str,
    out: str, out_sep: str,
) -> DataFrame:
    """The rows whose list has known tokens, with the column `out`: the tokens' labels in
    token order. Each distinct list is translated once, known by a hash of its text, by
    which the rows are joined to it; each group that is put together again holds one
    list's tokens. A column of `df` named like `out` gives way to it."""
    from quarry.operators.joins import join_dim

    of = F.sha2(F.col(col), 256).alias("_of")
    known = df.select(of, F.col(col).alias("_list")).filter("_list is not null").distinct()
    tokens = explode_list(known, "_list", sep, dtype, out="_tok", keep=["_of"])
    named = join_dim(
        tokens, dim.select(F.col(dim_key).alias("_tok"), F.col(dim_label).alias("_lab")),
        "_tok", "inner",
    )
    lit = out_sep.replace("\\", "\\\\").replace("'", "\\'")
    ordered = F.expr(f"listagg(_lab, '{lit}') WITHIN GROUP (ORDER BY _tok, _lab)")
    labels = named.groupBy("_of").agg(ordered.alias(out))
    rest = [c for c in df.columns if c.lower() != out.lower()]
    return df.select(*rest, of).join(labels, "_of").drop("_of")


def token_frequency(
    df: DataFrame, col: str, sep: str = ",", dtype: str | None = "int",
    k: int | None = None, ties: str = "first", token: str = "token", count_col: str = "uses",
    weight: str | None = None,
) -> DataFrame:
    """How often each token occurs across all lists; with `k`, only the top k
    (ties broken by token). Counting is a hash aggregate with partial counts.

    `weight` names a per-row multiplicity, so rows can be pre-aggregated (e.g.
    one row per distinct list with its number of uses) before exploding.
    """
    tokens = explode_list(df, col, sep, dtype, out=token, keep=[weight] if weight else [])
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = tokens.groupBy(token).agg(n.cast("bigint").alias(count_col))
    if k is None:
        return counts
    return top_k(counts, [F.col(count_col).desc()], k, ties, [F.col(token).asc()])
