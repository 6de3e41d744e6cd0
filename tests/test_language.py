import datetime

import pytest

from pathloom.plans.parser import parse
from pathloom.plans.session import Session
from pathloom.sources.files import load_space, read_csv, save_space
from pathloom.sources.space import Space
from pathloom.values import SemanticError
from tests import brute


@pytest.fixture(scope="module")
def session(spark):
    people = spark.createDataFrame([("a", "Ann", 40), ("b", "Bob", 30), ("c", "Cy", 50), ("d", "Di", None)], "_vid string, name string, age long")
    towns = spark.createDataFrame([("x", "Xanten"), ("y", "York")], "_vid string, name string")
    likes = spark.createDataFrame([("a", "b", 90), ("b", "c", 80), ("c", "a", 70), ("a", "c", 60), ("b", "a", 50)], "_src string, _dst string, much long")
    lives = spark.createDataFrame([("a", "x", 1, 1990), ("a", "x", 2, 2000), ("b", "y", 1, 1995), ("c", "x", 1, 1999)], "_src string, _dst string, _rank long, since long")
    g = Space(spark, "g").with_tag("person", people).with_tag("town", towns).with_edge("likes", likes).with_edge("lives", lives)
    return Session(spark, g)


def rows(session, text):
    return sorted((tuple(r) for r in session.execute(text).collect()), key=str)


def test_go(session):
    assert rows(session, 'GO FROM "a" OVER likes YIELD likes._dst AS d, likes.much AS m, $$.person.age AS g') == [("b", 90, 30), ("c", 60, 50)]
    assert rows(session, 'GO 2 STEPS FROM "a" OVER likes YIELD dst(edge) AS d') == [("a",), ("a",), ("c",)]
    assert rows(session, 'GO FROM "a" OVER likes REVERSELY YIELD likes._dst AS d, src(edge) AS s') == [("b", "b"), ("c", "c")]
    assert rows(session, 'GO FROM "a" OVER * WHERE likes.much > 70 YIELD dst(edge) AS d') == [("b",)]
    assert rows(session, 'GO 0 STEPS FROM "a" OVER likes YIELD likes._dst AS d') == []
    assert rows(session, 'GO FROM "a" OVER likes YIELD likes._dst AS d | GO FROM $-.d OVER lives YIELD $-.d AS d, $$.town.name AS t | ORDER BY $-.d') == [("b", "York"), ("c", "Xanten")]
    assert rows(session, '$v = GO FROM "a" OVER likes YIELD likes._dst AS d; GO FROM $v.d OVER likes YIELD DISTINCT $v.d AS f, likes._dst AS t') == [("b", "a"), ("b", "c"), ("c", "a")]


def test_lookup_fetch(session):
    assert rows(session, "LOOKUP ON person WHERE person.age >= 40 YIELD id(vertex) AS i") == [("a",), ("c",)]
    assert rows(session, 'FETCH PROP ON person "a", "zz" YIELD person.name AS n, person.age + 1 AS g') == [("Ann", 41)]
    assert rows(session, 'FETCH PROP ON lives "a"->"x"@2 YIELD lives.since AS s, rank(edge) AS r') == [(2000, 2)]
    v = session.execute('FETCH PROP ON * "a" YIELD vertex AS v').collect()[0][0]
    assert v["_vid"] == "a" and v["_tags"] == {"person": {"name": "Ann", "age": "40"}}


def test_match(session):
    assert rows(session, 'MATCH (p:person {name: "Ann"})-[e:likes]->(q) RETURN q.person.name AS n, e.much AS m') == [("Bob", 90), ("Cy", 60)]
    assert rows(session, "MATCH (p:person)-[:lives]->(t:town)<-[:lives]-(q:person) WHERE id(p) < id(q) RETURN DISTINCT p.person.name AS a, q.person.name AS b") == [("Ann", "Cy")]
    assert rows(session, "MATCH (p:person) OPTIONAL MATCH (p)-[:lives]->(t) RETURN id(p) AS p, count(t) AS n") == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert rows(session, "MATCH (p:person) WHERE NOT (p)-[:likes]->() RETURN p.person.name AS n, p.person.age IS NULL AS x") == [("Di", True)]
    assert rows(session, "MATCH (p:person) RETURN id(p) AS p, size((p)-[:likes]->()) AS n") == [("a", 2), ("b", 2), ("c", 1), ("d", 0)]
    assert rows(session, 'MATCH p = (a:person)-[:likes*2]->(b) WHERE id(a) == "a" RETURN [x IN nodes(p) | id(x)] AS v, length(p) AS l') == [(["a", "b", "a"], 2), (["a", "b", "c"], 2), (["a", "c", "a"], 2)]
    assert rows(session, 'MATCH p = shortestPath((a:person {name: "Cy"})-[:likes*..4]->(b:person {name: "Bob"})) RETURN length(p) AS l') == [(2,)]
    assert rows(session, "MATCH (a:person)-[e:likes]->(b)-[f:likes]->(a) RETURN count(*) AS n") == [(4,)]
    assert rows(session, "MATCH ()-[e:lives]->(t) WITH t, max(e.since) AS s WHERE s > 1996 RETURN t.town.name AS t, s") == [("Xanten", 2000)]


def test_paths_and_subgraph(session):
    assert rows(session, 'FIND SHORTEST PATH FROM "c" TO "b" OVER likes YIELD path AS p | YIELD length($-.p) AS l') == [(2,)]
    assert rows(session, 'FIND NOLOOP PATH FROM "a" TO "c" OVER likes UPTO 3 STEPS YIELD path AS p | YIELD count(*) AS n') == [(2,)]
    got = session.execute('GET SUBGRAPH 1 STEPS FROM "a" OUT likes YIELD VERTICES AS v, EDGES AS e').collect()
    assert [(len(r[0]), len(r[1])) for r in got] == [(1, 2), (2, 3)]


def test_pipes_groups_sets(session):
    assert rows(session, "LOOKUP ON person YIELD person.age AS g | YIELD sum($-.g) AS s, avg($-.g) AS a, count(*) AS n, count($-.g) AS c") == [(120, 40.0, 4, 3)]
    assert rows(session, "UNWIND [1, 1, 2] AS x RETURN x | GROUP BY $-.x YIELD $-.x AS x, count(*) AS n") == [(1, 2), (2, 1)]
    assert rows(session, "YIELD 1 AS a UNION ALL YIELD 1 AS a UNION YIELD 2 AS a") == [(1,), (2,)]
    assert rows(session, "LOOKUP ON person YIELD person.name AS n | ORDER BY $-.n DESC | LIMIT 1, 2") == [("Bob",), ("Cy",)]


@pytest.mark.parametrize("text,value", [
    ("7 / 2", 3), ("-7 / 2", -3), ("7 % -2", 1), ("1 / 0", None), ("9223372036854775807 + 1", None), ("1 == 1.000000001", True), ('1 == "1"', False), ('1 < "1"', None), ("NULL == NULL", None),
    ('"a" + 1', "a1"), ("[1] + 2", [1, 2]), ("[1, 2, 3][-1]", 3), ("[1, 2][5]", None), ("[1, 2, 3][0..2]", [1, 2]), ("NULL IN [1]", None), ("2 IN [1, NULL]", None), ("true XOR NULL", None), ('"abc" =~ "a.c"', True), ('"xabc" =~ "a.c"', False),
    ("CASE 3 WHEN 3 THEN \"y\" ELSE \"n\" END", "y"), ("1 > 2 ? 3 : 4", 4), ("reduce(s = 10, x IN [1, 2] | s + x)", 13), ("none(x IN [1, 2] WHERE x > 2)", True), ("round(-1.35, 1, \"up\")", -1.4), ("round(1.25, 1, \"half_even\")", 1.2), ("round(2.5)", 3.0),
    ('substr("hello", 1, 3)', "ell"), ('substr("hello", 9)', ""), ('left("ab", -1)', None), ('right("abc", 2)', "bc"), ('split("a.b", ".")', ["a", "b"]), ("range(3, 1)", []), ("range(1, 5, 2)", [1, 3, 5]), ('toInteger("1.5")', 1), ('toInteger("x")', None), ("toString(1.0)", "1.0"),
    ("sign(-2)", -1), ("log(0)", None), ("cos_similarity(1, 0, 0, 1)", 0.0), ("cos_similarity(1, 0, 0)", -2.0), ('length("é")', 2), ("size([1, 2])", 2), ("head([])", None), ("tail([1])", []), ("coalesce(NULL, 2)", 2), ('lpad("ab", 0, "x")', ""), ('strcasecmp("A", "a")', 0),
    ('date("2020-01-31") + duration({months: 1})', datetime.date(2020, 2, 29)), ('datetime("2020-01-02T03:04:05").minute', 4), ('{a: 1}.a', 1), ('json_extract("{\\"k\\": 1}").k', "1"), ("standard_deviation([1, 3])", 1.0), ("(INT)\"12\"", 12), ("bit_and(6, 3)", 2), ('concat_ws("-", "a", NULL, "b")', "a-b"),
])
def test_expressions(session, text, value):
    got = session.execute(f"RETURN {text} AS v").collect()[0][0]
    assert got == value or (isinstance(value, float) and abs(got - value) < 1e-9)


def test_mutation_and_catalog(spark):
    s = Session(spark)
    s.execute('CREATE SPACE z(vid_type = FIXED_STRING(8)); USE z; CREATE TAG t(x int NOT NULL DEFAULT 3, s string); CREATE EDGE e(w double)')
    s.execute('INSERT VERTEX t(s) VALUES "1":("q"), "2":("r"); INSERT VERTEX IF NOT EXISTS t(x, s) VALUES "1":(9, "no"); INSERT EDGE e(w) VALUES "1"->"2":(1.5), "1"->"2"@1:(2.5)')
    assert rows(s, "LOOKUP ON t YIELD id(vertex) AS i, t.x AS x, t.s AS s") == [("1", 3, "q"), ("2", 3, "r")]
    assert rows(s, 'UPDATE VERTEX ON t "1" SET x = x + 1 WHEN s == "q" YIELD x') == [(4,)]
    s.execute('UPSERT VERTEX ON t "5" SET s = "n"; UPDATE EDGE ON e "1"->"2"@1 SET w = 7.0')
    assert rows(s, 'GO FROM "1" OVER e YIELD rank(edge) AS r, e.w AS w') == [(0, 1.5), (1, 7.0)]
    s.execute('DELETE EDGE e "1"->"2"@0; DELETE TAG t FROM "5"')
    assert rows(s, "SUBMIT JOB STATS") == [("Edge", "e", 1), ("Space", "edges", 1), ("Space", "vertices", 2), ("Tag", "t", 2)]
    s.execute('ALTER TAG t ADD (z int DEFAULT 8), DROP (s)')
    assert rows(s, "LOOKUP ON t YIELD t.z AS z") == [(8,), (8,)]
    s.execute("ALTER TAG t TTL_COL = \"x\", TTL_DURATION = 1")
    assert rows(s, "LOOKUP ON t YIELD t.z AS z") == []
    assert rows(s, "SHOW EDGES") == [("e",)]
    for bad in ("LOOKUP ON nope", "YIELD $-.x AS y", "RETURN foo(1)", "INSERT VERTEX t(nope) VALUES \"1\":(1)", "YIELD 1 AS a UNION YIELD 1 AS b", "CREATE TAG t(x int)"):
        with pytest.raises(SemanticError):
            s.execute(bad)


def test_fulltext_and_explain(session):
    session.execute('CREATE FULLTEXT TAG INDEX names ON person(name)')
    assert rows(session, 'LOOKUP ON person WHERE ES_QUERY(names, "bo* ann") YIELD id(vertex) AS i') == [("a",), ("b",)]
    assert [r[1] for r in session.execute('EXPLAIN LOOKUP ON person YIELD person.name AS n | ORDER BY $-.n | LIMIT 2').where("name <> 'spark'").orderBy("id").collect()][-1] == "TopN"


def test_csv_and_saved_spaces(spark, tmp_path):
    (tmp_path / "p.csv").write_text(":VID(string),t.name:string,t.n:int\na,A,1\nb,B,x\n")
    (tmp_path / "e.csv").write_text(":SRC_VID(string),:DST_VID(string),:RANK,e.w:double\na,b,3,0.5\n")
    g = read_csv(read_csv(Space(spark, "f"), str(tmp_path / "p.csv")), str(tmp_path / "e.csv"))
    save_space(g, str(tmp_path / "saved"))
    s = Session(spark, load_space(spark, str(tmp_path / "saved")))
    assert rows(s, 'GO FROM "a" OVER e YIELD e._dst AS d, e._rank AS r, e.w AS w, $^.t.n AS n') == [("b", 3, 0.5, 1)]
    assert rows(s, "LOOKUP ON t YIELD t.n AS n") == [(1,), (None,)]


@pytest.mark.parametrize("text", ["GO FROM", "MATCH (a RETURN a", "YIELD", "RETURN 1 +", "LOOKUP person", "GO 2 FROM \"a\" OVER e", "'"])
def test_syntax_errors(text):
    with pytest.raises(SemanticError):
        parse(text)


def test_patterns_without_upper_bound(spark):
    # a chain of 20 edges that ends in a loop of 3, and a shortcut over 4 of its edges
    pairs = [(k, k + 1) for k in range(20)] + [(20, 18), (2, 6)]
    nodes = spark.createDataFrame([(k, k) for k in range(21)], "_vid long, n long")
    edges = spark.createDataFrame(pairs, "_src long, _dst long")
    s = Session(spark, Space(spark, "chain", "int64").with_tag("t", nodes).with_edge("e", edges))
    walks = brute.trails(pairs, 0, 1, len(pairs))
    for bound, least in (("", 1), ("9..", 9)):
        assert rows(s, f"MATCH (a:t)-[e:e*{bound}]->(b) WHERE id(a) == 0 RETURN size(e) AS n, id(b) AS b") == sorted(((len(w), end) for w, end in walks if len(w) >= least), key=str)
    short = {(a, b): len(e) for a, b, _, e in brute.shortest(pairs, [0, 1], [5, 19, 20], 30)}
    for f in ("shortestPath", "allShortestPaths"):
        got = rows(s, f"MATCH p = {f}((a:t)-[:e*]->(b:t)) WHERE id(a) IN [0, 1] AND id(b) IN [5, 19, 20] RETURN id(a) AS a, id(b) AS b, length(p) AS l")
        assert got == sorted(((a, b, n) for (a, b), n in short.items()), key=str)
    assert max(short.values()) == 17
