"""Print the answers of one study's questions on its tables.

    python -m quarry.plans.run restaurant|delivery|music|movies [question ids ...]

The restaurant and delivery studies run on their seed rows, the music and movie
studies on the small hand-written tables in `quarry.sources.samples`.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from quarry.plans import delivery, movies, music, restaurant
    from quarry.session import build_session
    from quarry.sources.fixtures import delivery_tables, restaurant_tables
    from quarry.sources.samples import movie_tables, music_tables

    studies = {
        "restaurant": (restaurant.QUESTIONS, restaurant_tables),
        "delivery": (delivery.QUESTIONS, delivery_tables),
        "music": (music.QUESTIONS, music_tables),
        "movies": (movies.QUESTIONS, movie_tables),
    }
    if not argv or argv[0] not in studies:
        print(__doc__)
        return 2
    questions, tables = studies[argv[0]]
    spark = build_session("local[4]", 4)
    t = tables(spark)
    for qid in argv[1:] or list(questions):
        fn = questions[qid]
        title = (fn.__doc__ or fn.__name__).strip().splitlines()[0]
        print(f"== {title}" if title.startswith(qid) else f"== {qid}: {title}")
        fn(t).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
