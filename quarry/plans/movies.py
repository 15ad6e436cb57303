"""Movie-industry study: 29 questions over movies, genres, ratings and people.

Text matches are explicit about case (the studied engine compared text without
case). Every LIMIT comes with a full ORDER BY and a key tie-break. People are
grouped by id with the name carried (namesakes stay apart).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import contains_ci, has_many, in_ci, matches_ci, money_amount, money_currency
from quarry.functions.numeric import cents, exact_mean, round_ratio
from quarry.operators import profile, rank, rules, sequence, summary

# ---- fixed values: labels of the rating classes ----
RATING_CLASSES = [
    ("Superhit movies", 8, None, True),
    ("Hit movies", 7, 8),
    ("One-time watch movies", 5, 7),
]
RATING_DEFAULT = "Flop movies"


def _rated(t) -> DataFrame:
    return t["movie"].join(t["ratings"], F.col("id") == F.col("movie_id")).drop("movie_id")


def _with_genre(t) -> DataFrame:
    return t["movie"].join(t["genre"], F.col("id") == F.col("movie_id")).drop("movie_id")


def row_counts(t) -> DataFrame:
    """RM1."""
    names = ["movie", "genre", "director_mapping", "role_mapping", "names", "ratings"]
    return profile.row_counts({n: t[n] for n in names})


def movie_nulls(t) -> DataFrame:
    """RM2."""
    return profile.null_profile(t["movie"])


def movies_per_year(t) -> DataFrame:
    """RM3a."""
    return t["movie"].groupBy("year").agg(F.count("id").alias("number_of_movies"))


def movies_per_month(t) -> DataFrame:
    """RM3b."""
    return t["movie"].groupBy(F.month("date_published").alias("month_number")).agg(F.count("id").alias("number_of_movies"))


def count_in_year_countries(t, year: int = 2019, countries=("INDIA", "USA")) -> DataFrame:
    """RM4: movies of one year whose country text contains any of the names."""
    cond = None
    for c in countries:
        cond = contains_ci("country", c) if cond is None else (cond | contains_ci("country", c))
    return t["movie"].filter((F.col("year") == year) & cond).agg(F.count("id").alias("movie_count"))


def distinct_genres(t) -> DataFrame:
    """RM5."""
    return t["genre"].select("genre").distinct()


def top_genre_in_year(t, year: int = 2019) -> DataFrame:
    """RM6: genre with the most movies in a year."""
    counts = _with_genre(t).filter(F.col("year") == year).groupBy("genre").agg(F.count("id").alias("number_of_movies"))
    return rank.top_k(counts, [F.desc("number_of_movies")], 1, "first", ["genre"])


def single_genre_movies(t) -> DataFrame:
    """RM7."""
    return summary.singletons(t["genre"], "movie_id", "movie_count")


def _mean2(col: str):
    """Exact mean rounded half up to 2 decimals (an aggregate)."""
    return exact_mean(F.sum(cents(col)), F.count(col))


def mean_duration_per_genre(t) -> DataFrame:
    """RM8."""
    return _with_genre(t).groupBy("genre").agg(_mean2("duration").alias("avg_duration"))


def genre_rank(t, genre: str = "Thriller") -> DataFrame:
    """RM9: rank of one genre by movie count."""
    counts = _with_genre(t).groupBy("genre").agg(F.count("id").alias("movie_count"))
    return rank.rank_of(counts, "genre", "movie_count", genre, "genre_rank")


def ratings_min_max(t) -> DataFrame:
    """RM10."""
    return profile.min_max_profile(t["ratings"], ["avg_rating", "total_votes", "median_rating"])


def top_rated(t, k: int = 10) -> DataFrame:
    """RM11: the k best-rated movies with their rank (rank over all movies)."""
    from pyspark.sql import Window

    best = _rated(t).orderBy(F.col("avg_rating").desc_nulls_last(), F.asc("id")).limit(k)
    return best.select(
        "title", "avg_rating", F.rank().over(Window.orderBy(F.col("avg_rating").desc_nulls_last())).alias("movie_rank")
    )


def movies_per_median_rating(t) -> DataFrame:
    """RM12."""
    return _rated(t).groupBy("median_rating").agg(F.count("id").alias("movie_count"))


def top_hit_company(t, min_rating: float = 8, ties: str = "first") -> DataFrame:
    """RM13: production company with the most movies rated above `min_rating`."""
    hits = _rated(t).filter((F.col("avg_rating") > min_rating) & F.col("production_company").isNotNull())
    counts = hits.groupBy("production_company").agg(F.count("id").alias("movie_count"))
    order = [F.desc("movie_count")] if ties == "first" else [("movie_count", True)]
    return rank.top_k(counts, order, 1, ties, ["production_company"], out="prod_company_rank")


def genre_counts_filtered(t, country: str = "USA", month: int = 3, year: int = 2017, min_votes: int = 1000) -> DataFrame:
    """RM14."""
    rows = _with_genre(t).join(t["ratings"], F.col("id") == F.col("movie_id"))
    rows = rows.filter(
        (F.lower("country") == country.lower()) & (F.month("date_published") == month)
        & (F.year("date_published") == year) & (F.col("total_votes") > min_votes)
    )
    return rows.groupBy("genre").agg(F.count("id").alias("movie_count"))


def titles_with_prefix(t, prefix: str = "the", min_rating: float = 8) -> DataFrame:
    """RM15: titles starting with a word (case-insensitive regex), rated above."""
    rows = _with_genre(t).join(t["ratings"], F.col("id") == F.col("movie_id"))
    return rows.filter((F.col("avg_rating") > min_rating) & matches_ci("title", f"^{prefix}")).select(
        "title", "avg_rating", "genre"
    )


def median_between(t, rating: int = 8, start=dt.date(2018, 4, 1), end=dt.date(2019, 4, 1)) -> DataFrame:
    """RM16: movies with a given median rating published in [start, end]."""
    rows = _rated(t).filter((F.col("median_rating") == rating) & F.col("date_published").between(F.lit(start), F.lit(end)))
    return rows.groupBy("median_rating").agg(F.count("id").alias("movie_count"))


def votes_by_country(t, countries=("germany", "italy")) -> DataFrame:
    """RM17: total votes of movies whose country equals one of the names (any case)."""
    rows = _rated(t).filter(in_ci("country", countries))
    return rows.groupBy("country").agg(F.sum("total_votes").alias("movie_votes"))


def names_nulls(t) -> DataFrame:
    """RM18."""
    return profile.null_profile(t["names"], ["name", "height", "date_of_birth", "known_for_movies"])


def _people(t, mapping: str, category: str | None = None) -> DataFrame:
    m = t[mapping]
    if category is not None:
        m = m.filter(F.lower("category") == category.lower())
    n = t["names"].select(F.col("id").alias("name_id"), "name")
    return m.join(n, "name_id")


def top_directors_in_top_genres(t, min_rating: float = 8, k_genres: int = 3, k: int = 3) -> DataFrame:
    """RM19: directors with the most movies rated above `min_rating` inside the
    `k_genres` genres with most such movies; a movie counts once per top genre."""
    good = t["ratings"].filter(F.col("avg_rating") > min_rating).select("movie_id")
    g = t["genre"].join(good, "movie_id", "left_semi")
    top_g = rank.in_top_categories(g, "genre", k_genres)
    inside = _people(t, "director_mapping").join(good, "movie_id", "left_semi").join(top_g, "movie_id")
    per_director = inside.groupBy("name_id", "name").agg(F.count("movie_id").alias("movie_count"))
    res = rank.top_k(per_director, [("movie_count", True)], k, "all", out="director_rank")
    return rank.top_k(res, [F.desc("movie_count")], k, "first", ["name_id"]).select(
        "name_id", F.col("name").alias("director_name"), "movie_count"
    )


def top_actors_by_hits(t, min_median: int = 8, k: int = 2) -> DataFrame:
    """RM20."""
    good = t["ratings"].filter(F.col("median_rating") >= min_median).select("movie_id")
    a = _people(t, "role_mapping", "actor").join(good, "movie_id", "left_semi")
    counts = a.groupBy("name_id", "name").agg(F.count("movie_id").alias("movie_count"))
    return rank.top_k(counts, [F.desc("movie_count")], k, "first", ["name_id"]).select(
        "name_id", F.col("name").alias("actor_name"), "movie_count"
    )


def top_companies_by_votes(t, k: int = 3, drop_null: bool = False) -> DataFrame:
    """RM21: companies by total votes; the NULL company takes a rank unless dropped."""
    rows = _rated(t)
    if drop_null:
        rows = rows.filter(F.col("production_company").isNotNull())
    sums = rows.groupBy("production_company").agg(F.sum("total_votes").alias("vote_count"))
    return rank.top_k(sums, [("vote_count", True)], k, "all", out="prod_comp_rank")


def _weighted_people(t, category: str, where, min_movies: int) -> DataFrame:
    p = _people(t, "role_mapping", category)
    rows = p.join(t["ratings"], "movie_id").join(t["movie"].select(F.col("id").alias("movie_id"), "country", "languages"), "movie_id")
    rows = rows.filter(where).withColumn("rating_units", (F.col("avg_rating") * 100).cast("bigint"))
    return rank.weighted_rank(rows, ["name_id", "name"], "rating_units", "total_votes", min_movies, "weight_total", "person_rank")


def _first_ranked(res: DataFrame, rank_col: str, k: int | None) -> DataFrame:
    if k is None:
        return res
    return rank.top_k(res, [F.asc(rank_col)], k, "first", ["name_id"])


def actor_rank(t, country: str = "India", min_movies: int = 5, k: int | None = 1) -> DataFrame:
    """RM22: actors of one country's movies by vote-weighted rating, >= min_movies;
    the first `k` by rank (None: all)."""
    res = _weighted_people(t, "actor", F.lower("country") == country.lower(), min_movies)
    res = res.select("name_id", F.col("name").alias("actor_name"), F.col("weight_total").cast("bigint").alias("total_votes"),
                     F.col("n").alias("movie_count"), F.col("weighted_mean").alias("actor_avg_rating"),
                     F.col("person_rank").alias("actor_rank"))
    return _first_ranked(res, "actor_rank", k)


def actress_rank(
    t, language: str = "hindi", min_movies: int = 3, k: int | None = 5, country: str | None = None
) -> DataFrame:
    """RM23: actresses of one language's movies (language text equal, any case);
    the first `k` by rank (None: all). The question also names a country; the
    studied query filters on language only, so `country` (text equal, any case)
    is optional."""
    cond = F.lower("languages") == language.lower()
    if country is not None:
        cond = cond & (F.lower("country") == country.lower())
    res = _weighted_people(t, "actress", cond, min_movies)
    res = res.select("name_id", F.col("name").alias("actress_name"), F.col("weight_total").cast("bigint").alias("total_votes"),
                     F.col("n").alias("movie_count"), F.col("weighted_mean").alias("actress_avg_rating"),
                     F.col("person_rank").alias("actress_rank"))
    return _first_ranked(res, "actress_rank", k)


def classify(t, genre: str = "Thriller") -> DataFrame:
    """RM24: rating class of each movie of one genre; NULL rating is a flop."""
    rows = _rated(t).join(t["genre"], F.col("id") == F.col("movie_id")).filter(in_ci("genre", [genre]))
    return rows.select("title", "avg_rating", rules.bin_by_thresholds("avg_rating", RATING_CLASSES, RATING_DEFAULT).alias("movie_category"))


def genre_running_duration(t) -> DataFrame:
    """RM25: mean duration per genre, with running total and cumulative mean of the
    unrounded means in genre order."""
    sums = _with_genre(t).groupBy("genre").agg(F.sum("duration").alias("_s"), F.count("duration").alias("_n"))
    means = sums.select(
        "genre", exact_mean(F.col("_s").cast("decimal(20,0)") * 100, "_n").alias("avg_duration"),
        round_ratio(F.col("_s").cast("decimal(20,0)") * F.lit(Decimal(10**10)), "_n").alias("_mean_units"),
    )
    res = sequence.cumulative(means, [("genre", False)], "_mean_units", "running_total_duration", "moving_avg_duration", units_scale=10)
    return res.drop("_mean_units")


def top_grossing_in_top_genres(t, k_genres: int = 3, k: int = 5) -> DataFrame:
    """RM26: per year and currency, the k highest-grossing movies (dense rank) among
    the top genres by movie count. Gross text is parsed to amount + currency first;
    amounts of different currencies are not ranked against each other."""
    rows = _with_genre(t).select(
        "genre", "year", F.col("title").alias("movie_name"),
        money_currency("worlwide_gross_income").alias("currency"),
        money_amount("worlwide_gross_income").alias("worldwide_gross"),
    )
    return rank.top_per_group_within_top_categories(
        rows, "genre", k_genres, ["year", "currency"], [F.col("worldwide_gross").desc_nulls_last()], k, "dense", "movie_rank"
    )


def top_multilingual_companies(t, min_median: int = 8, k: int = 2) -> DataFrame:
    """RM27: companies with most well-rated movies in more than one language."""
    rows = _rated(t).filter(
        (F.col("median_rating") >= min_median) & F.col("production_company").isNotNull() & has_many("languages", ",")
    )
    counts = rows.groupBy("production_company").agg(F.count("id").alias("movie_count"))
    return rank.top_k(counts, [F.desc("movie_count")], k, "first", ["production_company"], out="prod_comp_rank")


def top_actresses_in_genre(t, genre: str = "drama", min_rating: float = 8, k: int = 3) -> DataFrame:
    """RM28: actresses with most movies rated above `min_rating` in one genre,
    with their vote-weighted rating."""
    from quarry.functions.numeric import exact_mean

    p = _people(t, "role_mapping", "actress").join(t["ratings"], "movie_id").join(t["genre"], "movie_id")
    p = p.filter((F.lower("genre") == genre.lower()) & (F.col("avg_rating") > min_rating))
    agg = p.groupBy("name_id", "name").agg(
        F.sum("total_votes").alias("total_votes"), F.count("movie_id").alias("movie_count"),
        F.sum((F.col("avg_rating") * 100).cast("decimal(18,0)") * F.col("total_votes")).alias("_vw"),
    )
    agg = agg.select("name_id", F.col("name").alias("actress_name"), "total_votes", "movie_count",
                     exact_mean("_vw", "total_votes").alias("actress_avg_rating"))
    return rank.top_k(agg, [F.desc("movie_count")], k, "first", [F.desc("actress_avg_rating"), F.asc("name_id")], out="actress_rank")


def director_gaps(t, k: int = 9) -> DataFrame:
    """RM29: per director, movies, mean days between consecutive releases
    (no per-director sort; see `gap_summary`), rating and vote figures."""
    d = _people(t, "director_mapping").join(t["ratings"], "movie_id").join(
        t["movie"].select(F.col("id").alias("movie_id"), "date_published", "duration"), "movie_id"
    )
    res = sequence.gap_summary(d, ["name_id", "name"], "date_published", extra_aggs={
        "avg_rating": _mean2("avg_rating"), "total_votes": F.sum("total_votes"),
        "min_rating": F.min("avg_rating"), "max_rating": F.max("avg_rating"), "total_duration": F.sum("duration"),
    })
    res = res.select(
        F.col("name_id").alias("director_id"), F.col("name").alias("director_name"),
        F.col("n_events").alias("number_of_movies"), F.col("avg_gap_days").alias("avg_inter_movie_days"),
        "avg_rating", "total_votes", "min_rating", "max_rating", "total_duration",
    )
    return rank.top_k(res, [F.desc("number_of_movies")], k, "first", ["director_id"])


QUESTIONS = {
    "RM1": row_counts, "RM2": movie_nulls, "RM3a": movies_per_year, "RM3b": movies_per_month,
    "RM4": count_in_year_countries, "RM5": distinct_genres, "RM6": top_genre_in_year,
    "RM7": single_genre_movies, "RM8": mean_duration_per_genre, "RM9": genre_rank,
    "RM10": ratings_min_max, "RM11": top_rated, "RM12": movies_per_median_rating,
    "RM13": top_hit_company, "RM14": genre_counts_filtered, "RM15": titles_with_prefix,
    "RM16": median_between, "RM17": votes_by_country, "RM18": names_nulls,
    "RM19": top_directors_in_top_genres, "RM20": top_actors_by_hits, "RM21": top_companies_by_votes,
    "RM22": actor_rank, "RM23": actress_rank, "RM24": classify, "RM25": genre_running_duration,
    "RM26": top_grossing_in_top_genres, "RM27": top_multilingual_companies,
    "RM28": top_actresses_in_genre, "RM29": director_gaps,
}
