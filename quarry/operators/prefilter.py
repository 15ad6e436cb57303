"""Cutting a fact table before it is shuffled.

A Bloom filter with one hash function, made of built-in aggregates: the hash of each
chosen key sets a bit, 64 bits to a word. The words are broadcast, at most `bits` / 64 rows of
two longs (8 MB for the default) however many keys there are; a fact row whose bit is not
set can have no match and is dropped in its scan stage. Some rows without a match pass,
about the share of set bits, so an exact join must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 2**25
_WORD, _BITS = "_filter_word", "_filter_bits"


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)).cast("bigint")


def key_filter(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(word, bits): the filter of the keys; NULL keys are in no filter."""
    place = _place(F.col(key), bits)
    flag = F.expr("shiftleft(1L, cast(_place % 64 AS int))")
    placed = keys.filter(F.col(key).isNotNull()).select(place.alias("_place"))
    return placed.groupBy(F.shiftright("_place", 6).alias(_WORD)).agg(F.bit_or(flag).alias(_BITS))


def may_match(facts: DataFrame, fact_key: str, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows of `facts` whose key can be among the keys: all that are, and few others."""
    place = _place(F.col(fact_key), bits)
    known = facts.filter(F.col(fact_key).isNotNull()).withColumn(_WORD, F.shiftright(place, 6))
    near = known.join(F.broadcast(key_filter(keys, key, bits)), _WORD)
    return near.filter(F.getbit(F.col(_BITS), place % 64) == 1).select(*facts.columns)


def cannot_match(facts: DataFrame, fact_key: str, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The other rows of `facts`, those with a NULL key among them: none has a key among the keys."""
    place = _place(F.col(fact_key), bits)
    near = facts.withColumn(_WORD, F.shiftright(place, 6)).join(F.broadcast(key_filter(keys, key, bits)), _WORD, "left")
    unset = F.coalesce(F.getbit(F.col(_BITS), place % 64), F.lit(0)) == 0
    return near.filter(unset | F.col(fact_key).isNull()).select(*facts.columns)
