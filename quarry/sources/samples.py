"""Small hand-written tables for the music-store and movie studies.

The studied scripts ship no data for these two studies, so these rows are our
own, written to exercise the tricky cases: namesakes, ties (best customer and
top genre in one country), a billing country different from the home country,
a track exactly at the mean length, NULL ratings and companies, mixed-case
multi-valued country and language text, money text in two currencies, a
director with two releases on one day and one with a single movie.
Used by tests only.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import DataFrame, SparkSession

MUSIC_SCHEMAS = {
    "employee": "title string, last_name string, first_name string, levels string",
    "customer": "customer_id int, first_name string, last_name string, email string, country string",
    "invoice": "invoice_id int, customer_id int, billing_city string, billing_country string, total decimal(10,2)",
    "invoice_line": "invoice_id int, track_id int, unit_price decimal(10,2), quantity int",
    "track": "track_id int, album_id int, genre_id int, name string, milliseconds int",
    "album2": "album_id int, artist_id int",
    "artist": "artist_id int, name string",
    "genre": "genre_id int, name string",
}

MUSIC_ROWS = {
    "employee": [
        ("General Manager", "Okafor", "Lena", "L6"),
        ("Sales Manager", "Brandt", "Olaf", "L4"),
        ("Sales Support Agent", "Moreau", "Cleo", "L1"),
    ],
    "customer": [
        (1, "Ana", "Silva", "ana@x.org", "Brazil"),
        (2, "Luis", "Rojas", "luis1@x.org", "Spain"),
        (3, "Mark", "Philips", "mark@x.org", "Canada"),
        (4, "Luis", "Rojas", "luis2@x.org", "USA"),
        (5, "Eva", "Novak", "eva@x.org", "USA"),
        (6, "Tom", "Berg", "tom@x.org", "Canada"),
        (7, "Ines", "Costa", "ines@x.org", "Brazil"),
        (8, "Ola", "Nord", "ola@x.org", "Norway"),
    ],
    "invoice": [
        (1, 1, "Sao Paulo", "Brazil", D("10.00")),
        (2, 2, "Madrid", "Spain", D("5.94")),
        (3, 3, "Toronto", "Canada", D("8.91")),
        (4, 4, "Boston", "USA", D("13.86")),
        (5, 5, "Prague", "Czech Republic", D("20.00")),
        (6, 5, "Boston", "USA", D("3.96")),
        (7, 6, "Toronto", "Canada", D("8.91")),
        (8, 7, "Rio", "Brazil", D("1.98")),
        (9, 8, "Oslo", "Norway", D("5.94")),
        (10, 1, "Sao Paulo", "Brazil", D("4.95")),
        (11, 2, "Madrid", "Spain", D("0.99")),
        (12, 4, "Boston", "USA", D("1.98")),
    ],
    "invoice_line": [
        (1, 1, D("0.99"), 2), (1, 2, D("0.99"), 1), (1, 5, D("1.99"), 1),
        (2, 3, D("0.99"), 1), (2, 6, D("0.99"), 1), (2, 7, D("0.99"), 1),
        (3, 1, D("0.99"), 1), (3, 4, D("0.99"), 1),
        (4, 2, D("0.99"), 3), (4, 3, D("0.99"), 1),
        (5, 5, D("1.99"), 2), (5, 8, D("0.99"), 1), (5, 1, D("0.99"), 1),
        (6, 6, D("0.99"), 1), (6, 7, D("0.99"), 1),
        (7, 4, D("0.99"), 1), (7, 8, D("0.99"), 1), (7, 2, D("0.99"), 1),
        (8, 1, D("0.99"), 1), (8, 1, D("0.99"), 1),
        (9, 6, D("0.99"), 1), (9, 7, D("0.99"), 2), (9, 3, D("0.99"), 1),
        (10, 2, D("0.99"), 1), (10, 5, D("1.99"), 1),
        (11, 8, D("0.99"), 1),
        (12, 4, D("0.99"), 2),
    ],
    "track": [
        (1, 1, 1, "Rain Drums", 300000),
        (2, 1, 1, "Long Lane", 240000),
        (3, 2, 1, "Back Road", 200000),
        (4, 3, 2, "Iron Sky", 260000),
        (5, 2, 1, "Long Night", 400000),
        (6, 3, 2, "Steel Wind", 250000),
        (7, 4, 2, "Fire Line", 230000),
        (8, 4, 3, "Blue Note", 200000),
    ],
    "album2": [(1, 1), (2, 2), (3, 3), (4, 3)],
    "artist": [(1, "Copper Kites"), (2, "North Ferry"), (3, "The Lanterns")],
    "genre": [(1, "Rock"), (2, "Metal"), (3, "Jazz")],
}

MOVIE_SCHEMAS = {
    "movie": (
        "id string, title string, year int, date_published date, duration int, country string, "
        "worlwide_gross_income string, languages string, production_company string"
    ),
    "genre": "movie_id string, genre string",
    "director_mapping": "movie_id string, name_id string",
    "role_mapping": "movie_id string, name_id string, category string",
    "names": "id string, name string, height int, date_of_birth date, known_for_movies string",
    "ratings": "movie_id string, avg_rating decimal(3,1), total_votes int, median_rating int",
}


def _d(y, m, d):
    return dt.date(y, m, d)


MOVIE_ROWS = {
    "movie": [
        ("tt01", "The Heist", 2017, _d(2017, 3, 10), 120, "USA", "$ 91000350", "English", "Harbour Films"),
        ("tt02", "Thermal", 2017, _d(2017, 3, 22), 150, "India", "INR 500000", "Tamil, Hindi", "Dream Factory"),
        ("tt03", "Other Side", 2018, _d(2018, 5, 1), 95, "USA, India", "$ 9", "English, Hindi", "Harbour Films"),
        ("tt04", "the quiet", 2019, _d(2019, 1, 15), 101, "Germany", None, "German", None),
        ("tt05", "Blue Sky", 2019, _d(2019, 3, 3), 88, "Italy", "$ 2500", "Italian", "Rai"),
        ("tt06", "Red River", 2019, _d(2019, 7, 19), 132, "india", "$ 7000000", "Hindi", "Dream Factory"),
        ("tt07", "Dark Road", 2018, _d(2018, 9, 9), 110, "USA", "$ 45000", "English, Spanish", "Warner"),
        ("tt08", "Lost Key", 2017, _d(2017, 12, 25), 99, "UK", "$ 120", "English", "Warner"),
        ("tt09", "Night Train", 2019, _d(2019, 3, 30), 140, "India, USA", "$ 88888", "Hindi, English", "Dream Factory"),
        ("tt10", "Paper Moon", 2018, _d(2018, 4, 1), 105, "France", "$ 300", "French", "Gaumont"),
        ("tt11", "Final Act", 2019, _d(2019, 3, 3), 97, "USA", "$ 99", "English", "Harbour Films"),
        ("tt12", "Zero Hour", 2017, _d(2017, 6, 6), 118, "India", None, "Hindi", "Dream Factory"),
        ("tt13", "Theory", 2018, _d(2018, 11, 11), 92, "USA", "$ 103", "english", None),
    ],
    "genre": [
        ("tt01", "Thriller"), ("tt01", "Action"), ("tt02", "Drama"), ("tt02", "Thriller"),
        ("tt03", "Drama"), ("tt04", "Comedy"), ("tt05", "Drama"), ("tt05", "Comedy"),
        ("tt06", "Drama"), ("tt07", "Thriller"), ("tt08", "Action"), ("tt09", "Drama"),
        ("tt09", "Thriller"), ("tt10", "Comedy"), ("tt11", "Action"), ("tt11", "Drama"),
        ("tt12", "Drama"), ("tt13", "Thriller"),
    ],
    "ratings": [
        ("tt01", D("8.5"), 5000, 9), ("tt02", D("8.0"), 1200, 8), ("tt03", D("7.0"), 800, 7),
        ("tt04", D("5.0"), 300, 5), ("tt05", None, 100, 6), ("tt06", D("9.1"), 20000, 9),
        ("tt07", D("6.4"), 1500, 6), ("tt08", D("8.2"), 700, 8), ("tt09", D("8.8"), 3000, 9),
        ("tt10", D("7.5"), 400, 8), ("tt11", D("4.9"), 2000, 4), ("tt12", D("8.6"), 900, 8),
        ("tt13", D("8.3"), 1100, 8),
    ],
    "names": [
        ("nm01", "Asha Rao", 165, _d(1980, 1, 1), "tt02"),
        ("nm02", "Vik Das", None, _d(1975, 5, 5), None),
        ("nm03", "Lee Park", 180, None, "tt01"),
        ("nm04", "Sam Cole", 175, _d(1990, 2, 2), None),
        ("nm05", "Sam Cole", 170, _d(1985, 3, 3), "tt07"),
        ("nm06", "Mira Sen", 160, _d(1988, 8, 8), "tt06"),
        ("nm07", "Ravi Kumar", 178, _d(1970, 7, 7), "tt09"),
        ("nm08", "Ana Gil", None, None, None),
    ],
    "director_mapping": [
        ("tt01", "nm03"), ("tt07", "nm03"), ("tt08", "nm03"),
        ("tt02", "nm07"), ("tt06", "nm07"), ("tt09", "nm07"), ("tt12", "nm07"),
        ("tt05", "nm04"), ("tt11", "nm04"), ("tt03", "nm05"), ("tt13", "nm05"),
        ("tt10", "nm08"),
    ],
    "role_mapping": [
        ("tt02", "nm02", "actor"), ("tt03", "nm02", "actor"), ("tt06", "nm02", "actor"),
        ("tt09", "nm02", "actor"), ("tt12", "nm02", "actor"),
        ("tt01", "nm04", "actor"), ("tt07", "nm04", "actor"), ("tt11", "nm04", "actor"),
        ("tt03", "nm04", "actor"), ("tt13", "nm04", "actor"),
        ("tt02", "nm05", "actor"), ("tt06", "nm05", "actor"),
        ("tt02", "nm01", "actress"), ("tt06", "nm01", "actress"), ("tt09", "nm01", "actress"),
        ("tt12", "nm01", "actress"),
        ("tt06", "nm06", "actress"), ("tt03", "nm06", "actress"), ("tt09", "nm06", "actress"),
        ("tt01", "nm08", "actress"), ("tt05", "nm08", "actress"),
    ],
}


def _tables(spark: SparkSession, schemas: dict, rows: dict) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame(rows[n], schema=schemas[n]) for n in schemas}


def music_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return _tables(spark, MUSIC_SCHEMAS, MUSIC_ROWS)


def movie_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return _tables(spark, MOVIE_SCHEMAS, MOVIE_ROWS)
