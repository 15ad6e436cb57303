"""Music-store study: eleven questions over invoices, tracks, artists and genres.

People are grouped by id with the name carried along (`key="id"`); pass
`key="name"` for the name grain, which merges namesakes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import in_ci
from quarry.operators import rank, summary


def _full_name(first: str = "first_name", last: str = "last_name"):
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def most_senior(t) -> DataFrame:
    """MS1: employee with the highest level."""
    e = t["employee"].select("title", F.concat("last_name", F.lit(" "), "first_name").alias("name"), "levels")
    return rank.top_k(e, [F.desc("levels")], 1, "first", ["name"]).select("title", "name")


def top_invoice_countries(t, k: int = 5) -> DataFrame:
    """MS2: countries with the most invoices."""
    counts = t["invoice"].groupBy("billing_country").agg(F.count(F.lit(1)).alias("total_invoices"))
    return rank.top_k(counts, [F.desc("total_invoices")], k, "first", ["billing_country"])


def best_city(t) -> DataFrame:
    """MS3: city with the highest invoice total."""
    sums = t["invoice"].groupBy("billing_city").agg(F.sum("total").alias("invoice_total"))
    return rank.top_k(sums, [F.desc("invoice_total")], 1, "first", ["billing_city"])


def _spend_per_customer(t, key: str) -> DataFrame:
    c = t["customer"].select("customer_id", _full_name().alias("customer_name"))
    j = t["invoice"].join(c, "customer_id")
    if key == "name":
        return j.groupBy("customer_name").agg(F.min("customer_id").alias("customer_id"), F.sum("total").alias("invoice_total"))
    return j.groupBy("customer_id", "customer_name").agg(F.sum("total").alias("invoice_total"))


def best_customer(t, key: str = "id") -> DataFrame:
    """MS4: customer with the highest invoice total."""
    return rank.top_k(_spend_per_customer(t, key), [F.desc("invoice_total")], 1, "first", ["customer_id"]).select(
        "customer_id", "customer_name", "invoice_total"
    )


def _genre_lines(t) -> DataFrame:
    tr = t["track"].select("track_id", "genre_id")
    g = t["genre"].select("genre_id", F.col("name").alias("genre"))
    il = t["invoice_line"].join(tr, "track_id").join(g, "genre_id")
    return il.join(t["invoice"].select("invoice_id", "customer_id"), "invoice_id")


def genre_listeners(t, genre: str = "Rock") -> DataFrame:
    """MS5: distinct listeners of one genre (email, name, genre)."""
    lines = _genre_lines(t).filter(in_ci("genre", [genre]))
    c = t["customer"].select("customer_id", "email", _full_name().alias("customer_name"))
    return summary.segment_members(lines.join(c, "customer_id"), F.lit(True), ["email", "customer_name", "genre"])


def genre_listener_count(t, genre: str = "Rock") -> DataFrame:
    """MS6: their number."""
    c = t["customer"].select("customer_id", "email")
    lines = _genre_lines(t).join(c, "customer_id")
    return summary.segment_count(lines, in_ci("genre", [genre]), "email", "number_of_customers")


def artists_by_genre_tracks(t, genre: str = "Rock", k: int | None = None) -> DataFrame:
    """MS7: artists by number of tracks in one genre (LIKE without wildcard = equality)."""
    g = t["genre"].filter(in_ci("name", [genre])).select("genre_id")
    tr = t["track"].join(g, "genre_id", "left_semi").join(t["album2"], "album_id")
    counts = tr.groupBy("artist_id").agg(F.count(F.lit(1)).alias("number_of_songs"))
    named = counts.join(t["artist"], "artist_id").select("artist_id", "name", "number_of_songs")
    if k is None:
        return named
    return rank.top_k(named, [F.desc("number_of_songs")], k, "first", ["artist_id"])


def long_tracks(t) -> DataFrame:
    """MS8: tracks strictly longer than the mean track length."""
    return summary.above_average(t["track"], "milliseconds").select("name", "milliseconds")


def best_artist_top_customer(t) -> DataFrame:
    """MS9: best-selling artist, then the customer who spent most on it."""
    tr = t["track"].select("track_id", "album_id").join(t["album2"], "album_id")
    sold = t["invoice_line"].join(tr, "track_id").groupBy("artist_id", "invoice_id").agg(
        F.sum(F.col("unit_price") * F.col("quantity")).alias("spends")
    )
    buyers = t["invoice"].select("invoice_id", "customer_id")
    best = rank.top_entity_then_partner(sold, "artist_id", "invoice_id", buyers, "customer_id", "spends")
    c = t["customer"].select("customer_id", _full_name().alias("customer_name"))
    a = t["artist"].select("artist_id", F.col("name").alias("artist_name"))
    return best.join(c, "customer_id").join(a, "artist_id").select("customer_id", "customer_name", "artist_name", "spends")


def top_genre_per_country(t, ties: str = "first") -> DataFrame:
    """MS10: most purchased genre per (home) country; one row per country by
    default (tie: genre name), or every tied genre with ties="all"."""
    c = t["customer"].select("customer_id", "country")
    lines = _genre_lines(t).join(c, "customer_id")
    counts = lines.groupBy("country", "genre").agg(F.count("quantity").alias("purchases"))
    return rank.top_per_group(counts, "country", [F.desc("purchases")], 1, ties, ["genre"])


def best_customer_per_country(t) -> DataFrame:
    """MS11: highest spender per billing country (tie: customer id)."""
    c = t["customer"].select("customer_id", _full_name().alias("customer_name"))
    spend = t["invoice"].join(c, "customer_id").groupBy("customer_id", "customer_name", "billing_country").agg(
        F.sum("total").alias("total_spend")
    )
    return rank.top_per_group(spend, "billing_country", [F.desc("total_spend")], 1, "first", ["customer_id"])


QUESTIONS = {
    "MS1": most_senior, "MS2": top_invoice_countries, "MS3": best_city, "MS4": best_customer,
    "MS5": genre_listeners, "MS6": genre_listener_count, "MS7": artists_by_genre_tracks,
    "MS8": long_tracks, "MS9": best_artist_top_customer, "MS10": top_genre_per_country,
    "MS11": best_customer_per_country,
}
