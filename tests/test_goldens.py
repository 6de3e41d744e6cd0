"""Published results on a graph of basketball players and teams (about 300 edges).

The data are not part of this repository: GRAPH_FIXTURE_DIR names a folder with its CSV files (player, team, bachelor, null,
like, serve, teammate), whose headers ``read_csv`` understands.
"""

import os
from pathlib import Path

import pytest

from pathloom.plans.session import Session
from pathloom.sources.files import read_csv
from pathloom.sources.space import Space

FOLDER = os.environ.get("GRAPH_FIXTURE_DIR", "")
pytestmark = pytest.mark.skipif(not FOLDER, reason="GRAPH_FIXTURE_DIR is not set")

COUNTS = [
    ('GO 3 STEPS FROM "Tim Duncan" OVER like YIELD like._dst AS d | YIELD count(*) AS n', 5),
    ('GO 1 TO 3 STEPS FROM "Tony Parker" OVER serve BIDIRECT YIELD DISTINCT id($$) AS d | YIELD count(*) AS n', 41),
    ('GO 3 STEPS FROM "Tony Parker" OVER serve BIDIRECT YIELD id($$) AS d | YIELD count(*) AS n', 65),
    ('MATCH (:player{name: "Tim Duncan"})-[e:like*2..3]-(v) RETURN count(*) AS n', 292),
    ('MATCH (:player{name: "Tim Duncan"})-[e:serve|like*2..3]-(v) RETURN count(e) AS n', 927),
    ('MATCH (v)-[e:like*0..2]-(v) WHERE id(v) == "Tim Duncan" RETURN count(*) AS n', 5),
    ('FIND ALL PATH FROM "Tim Duncan" TO "Tony Parker" OVER like UPTO 3 STEPS YIELD path AS p | YIELD count(*) AS n', 3),
    ('FIND NOLOOP PATH FROM "Tim Duncan" TO "Tony Parker" OVER like UPTO 3 STEPS YIELD path AS p | YIELD count(*) AS n', 1),
]


@pytest.fixture(scope="module")
def session(spark):
    space = Space(spark, "players")
    for name in ("player", "team", "bachelor", "null", "like", "serve", "teammate"):
        space = read_csv(space, str(Path(FOLDER) / f"{name}.csv"))
    return Session(spark, space)


@pytest.mark.parametrize("text,want", COUNTS)
def test_counts(session, text, want):
    assert [r[0] for r in session.execute(text).collect()] == [want]


@pytest.mark.parametrize(
    "text,want",
    [
        ('GET SUBGRAPH 1 STEPS FROM "Tony Parker" BOTH like', [(1, 8), (6, 8)]),
        ('GET SUBGRAPH 3 STEPS FROM "Paul George" OUT serve BOTH like', [(1, 4), (3, 4), (2, 14), (12, 21)]),
    ],
)
def test_subgraphs(session, text, want):
    rows = session.execute(f"{text} YIELD VERTICES AS v, EDGES AS e | YIELD size($-.v) AS v, size($-.e) AS e").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_edges_of_a_deep_subgraph(session):
    rows = session.execute('GET SUBGRAPH 4 STEPS FROM "Tim Duncan" BOTH like YIELD VERTICES AS v, EDGES AS e | YIELD size($-.e) AS e').collect()
    assert sorted(r[0] for r in rows) == sorted([12, 23, 17, 12, 0])


def test_shortest_path(session):
    rows = session.execute('FIND SHORTEST PATH FROM "Tiago Splitter" TO "LaMarcus Aldridge" OVER like YIELD path AS p | YIELD length($-.p) AS n').collect()
    assert [r[0] for r in rows] == [3]
