"""Plan checks for every case-study question, on its own tables."""

import contextlib
import io

import pytest

from quarry.plans import delivery, movies, music, restaurant
from quarry.sources.fixtures import delivery_tables, restaurant_tables
from quarry.sources.samples import movie_tables, music_tables

STUDIES = {
    "restaurant": (restaurant.QUESTIONS, restaurant_tables),
    "delivery": (delivery.QUESTIONS, delivery_tables),
    "music": (music.QUESTIONS, music_tables),
    "movies": (movies.QUESTIONS, movie_tables),
}
CASES = [(s, q) for s, (qs, _) in STUDIES.items() for q in qs]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


@pytest.fixture(scope="module")
def tables(spark):
    return {s: make(spark) for s, (_, make) in STUDIES.items()}


@pytest.mark.parametrize("study,qid", CASES)
def test_study_question_plan(tables, study, qid):
    df = STUDIES[study][0][qid](tables[study])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    for node in FORBIDDEN:
        assert node not in plan, f"{study} {qid}: {node}"
