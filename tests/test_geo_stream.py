import datetime
import math
import random

import pytest

from pathloom.functions import geo
from pathloom.streaming.listener import fulltext_listener, windowed_degrees


def test_shapes():
    sq = geo.parse_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))")
    assert geo.valid(sq) and not geo.valid(geo.parse_wkt("POLYGON((0 0, 10 0, 10 10, 0 10))"))
    assert geo.covers(sq, geo.parse_wkt("POINT(5 5)")) and not geo.covers(sq, geo.parse_wkt("POINT(11 5)"))
    assert geo.distance(geo.parse_wkt("POINT(0 0)"), geo.parse_wkt("POINT(1 0)")) == pytest.approx(111195.1, abs=0.1)
    assert geo.distance(sq, geo.parse_wkt("POINT(5 5)")) == 0
    assert geo.intersects(geo.parse_wkt("LINESTRING(-5 5, 5 5)"), sq)
    assert geo.cell_id(0, 0) == 1152921504606846977
    assert geo.parse_wkt("POINT(1)") is None and geo.parse_wkt(None) is None


def test_feed(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 0, 30)
    rows = [(1, 2, 0, t), (1, 3, 0, t), (2, 3, 0, t + datetime.timedelta(hours=1))]
    spark.createDataFrame(rows, "_src long, _dst long, _rank long, _time timestamp").write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("_src long, _dst long, _rank long, _time timestamp").parquet(str(tmp_path / "in"))
    q = windowed_degrees(feed).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["_vid"], r["degree"]) for r in spark.table("deg").collect()} == {(1, 2), (2, 1)}
    spark.createDataFrame([(1, "red fish red")], "id long, text string").write.parquet(str(tmp_path / "texts"))
    words = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "texts"))
    fulltext_listener(words, "id", "text", str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["term"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {("red", 2), ("fish", 1)}


@pytest.mark.parametrize("text,options", [
    ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", (0,)), ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", (10,)), ("POLYGON((-80 -60, 80 -60, 80 60, -80 60, -80 -60))", (4,)),
    ("POLYGON((20 10, 40 10.01, 20 10.02, 20 10))", (0, 30, 20)), ("LINESTRING(-30 -20, 50 40)", (0, 30, 8)), ("LINESTRING(170 5, -170 8)", (0, 12, 30)), ("POINT(44 36)", (0, 30, 8, 50000.0)),
])
def test_covering_holds_every_point(text, options):
    shape = geo.parse_wkt(text)
    got = geo.covering(shape, *options)
    assert len(set(got)) == len(got) and (options[0] or len(got) <= max(6, *options[2:3], 8))
    levels = {(60 - (x & -x).bit_length() + 1) // 2 for x in got}
    assert min(levels) >= options[0]
    rng, kept = random.Random(3), set(got)
    lons, lats = zip(*shape[1][0], strict=True)
    seen = 0
    for _ in range(3000):
        if shape[0] == "linestring":
            t, (a, b) = rng.random(), geo._xyz(shape[1][0])
            v = a * (1 - t) + b * t
            x, y = math.degrees(math.atan2(v[1], v[0])), math.degrees(math.atan2(v[2], math.hypot(v[0], v[1])))
        else:
            x, y = rng.uniform(min(lons) - 1, max(lons) + 1), rng.uniform(min(lats) - 1, max(lats) + 1)
            if geo.distance(shape, ("point", [[(x, y)]])) > (options[3] if len(options) > 3 else 0):
                continue
        seen += 1
        assert any(geo.cell_id(x, y, k) in kept for k in levels), (x, y)
    assert seen > 5
