import pytest
from duck import load, same

from quarry.plans import music as M
from quarry.sources.samples import MUSIC_ROWS, MUSIC_SCHEMAS, music_tables


@pytest.fixture(scope="module")
def t(spark):
    return music_tables(spark)


@pytest.fixture(scope="module")
def con():
    return load(MUSIC_SCHEMAS, MUSIC_ROWS)


NAME = "concat(first_name, ' ', last_name)"
GENRE_LINES = """invoice_line il JOIN track USING (track_id) JOIN genre g USING (genre_id)
                 JOIN invoice USING (invoice_id) JOIN customer USING (customer_id)"""

CASES = {
    "MS1": (M.most_senior, "SELECT title, concat(last_name, ' ', first_name) AS name FROM employee ORDER BY levels DESC LIMIT 1"),
    "MS2": (M.top_invoice_countries, """SELECT billing_country, COUNT(*) AS total_invoices FROM invoice
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
    "MS3": (M.best_city, "SELECT billing_city, SUM(total) AS invoice_total FROM invoice GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "MS4": (M.best_customer, f"""SELECT customer_id, {NAME} AS customer_name, SUM(total) AS invoice_total
            FROM invoice JOIN customer USING (customer_id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1"""),
    "MS5": (M.genre_listeners, f"""SELECT DISTINCT email, {NAME} AS customer_name, g.name AS genre
            FROM {GENRE_LINES} WHERE g.name = 'Rock'"""),
    "MS6": (M.genre_listener_count, f"SELECT COUNT(DISTINCT email) AS number_of_customers FROM {GENRE_LINES} WHERE g.name = 'Rock'"),
    "MS7": (M.artists_by_genre_tracks, """SELECT artist_id, artist.name, COUNT(*) AS number_of_songs
            FROM track JOIN album2 USING (album_id) JOIN artist USING (artist_id) JOIN genre g USING (genre_id)
            WHERE g.name = 'Rock' GROUP BY 1, 2"""),
    "MS8": (M.long_tracks, "SELECT name, milliseconds FROM track WHERE milliseconds > (SELECT AVG(milliseconds) FROM track)"),
    "MS9": (M.best_artist_top_customer, f"""
            WITH s AS (SELECT artist_id, customer_id, unit_price * quantity AS amount
                       FROM invoice_line JOIN track USING (track_id) JOIN album2 USING (album_id)
                       JOIN invoice USING (invoice_id)),
            best AS (SELECT artist_id FROM s GROUP BY 1 ORDER BY SUM(amount) DESC, 1 LIMIT 1)
            SELECT customer_id, {NAME} AS customer_name, artist.name AS artist_name, SUM(amount) AS spends
            FROM s JOIN best USING (artist_id) JOIN customer USING (customer_id) JOIN artist USING (artist_id)
            GROUP BY 1, 2, 3 ORDER BY spends DESC, customer_id LIMIT 1"""),
    "MS10": (M.top_genre_per_country, f"""
            WITH c AS (SELECT country, g.name AS genre, COUNT(quantity) AS purchases FROM {GENRE_LINES} GROUP BY 1, 2)
            SELECT country, genre, purchases FROM c
            QUALIFY ROW_NUMBER() OVER (PARTITION BY country ORDER BY purchases DESC, genre) = 1"""),
    "MS11": (M.best_customer_per_country, f"""
            WITH s AS (SELECT customer_id, {NAME} AS customer_name, billing_country, SUM(total) AS total_spend
                       FROM invoice JOIN customer USING (customer_id) GROUP BY 1, 2, 3)
            SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY billing_country ORDER BY total_spend DESC, customer_id) = 1"""),
}


@pytest.mark.parametrize("qid", sorted(CASES))
def test_music_question_matches_sql(t, con, qid):
    fn, sql = CASES[qid]
    got, want = same(fn(t), con, sql)
    assert got == want


def test_namesakes_stay_apart_by_default(t):
    by_id = {r.customer_id for r in M._spend_per_customer(t, "id").collect()}
    by_name = {r.customer_name for r in M._spend_per_customer(t, "name").collect()}
    assert len(by_id) == 8 and len(by_name) == 7


def test_track_at_mean_is_not_longer(t):
    names = {r.name for r in M.long_tracks(t).collect()}
    assert "Iron Sky" not in names and "Long Night" in names


def test_top_genre_tie_policy(t):
    all_ties = {(r.country, r.genre) for r in M.top_genre_per_country(t, "all").collect()}
    assert {("Canada", "Metal"), ("Canada", "Rock")} <= all_ties
    first = {r.country: r.genre for r in M.top_genre_per_country(t).collect()}
    assert first["Canada"] == "Metal"  # tie broken by genre name


def test_best_customer_tie_in_one_country(t):
    got = {r.billing_country: r.customer_id for r in M.best_customer_per_country(t).collect()}
    assert got["Canada"] == 3  # customers 3 and 6 both spent 8.91; tie broken by id
