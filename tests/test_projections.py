"""Conic projections: published worked examples, round trips, and corrected points."""

import pytest
from pyspark.sql import functions as F

from siteweave.functions.projections import Conic, cell_places, corrected_points

CLARKE = {"axis": 6378206.4, "flattening": 1 - (1 - 0.00676866) ** 0.5}


@pytest.mark.parametrize(
    ("crs", "x", "y"),
    [
        # The worked examples of the textbook of map projections for 35 N, 75 W, on Clarke's ellipsoid.
        (Conic("aea", 29.5, 45.5, 23.0, -96.0, **CLARKE), 1885472.7, 1535925.0),
        (Conic("lcc", 33.0, 45.0, 23.0, -96.0, **CLARKE), 1894410.9, 1564649.5),
    ],
)
def test_worked_examples(spark, crs, x, y):
    one = spark.createDataFrame([(35.0, -75.0)], "lat double, lon double")
    found = one.select(*crs.forward(F.col("lat"), F.col("lon"))).first()
    assert abs(found[0] - x) < 0.5 and abs(found[1] - y) < 0.5


@pytest.mark.parametrize(
    "proj4",
    [
        "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=37.5 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83 +units=m",
        "+proj=aea +lat_1=-18 +lat_2=-36 +lat_0=0 +lon_0=132 +datum=WGS84",
        "+proj=lcc +lat_1=25 +lat_2=60 +lat_0=42.5 +lon_0=-100 +x_0=5 +y_0=-7 +ellps=GRS80 +units=km",
        "+proj=lcc +lat_1=40 +lat_0=40 +lon_0=-97 +units=us-ft",
    ],
)
def test_there_and_back(spark, proj4):
    crs = Conic.of(proj4)
    places = spark.createDataFrame([(float(lat), float(lon)) for lat in range(-70, 85, 7) for lon in range(-179, 180, 31)], "lat double, lon double")
    x, y = crs.forward(F.col("lat"), F.col("lon"))
    lat, lon = crs.inverse(F.col("x"), F.col("y"))
    for r in places.withColumns({"x": x, "y": y}).withColumns({"a": lat, "b": lon}).collect():
        assert abs(r["a"] - r["lat"]) < 1e-8 and abs(r["b"] - r["lon"]) < 1e-8


def test_unknown_projections_are_errors():
    with pytest.raises(ValueError, match="no conic"):
        Conic.of("+proj=merc +lon_0=0")


def test_nothing_beyond_the_pole(spark):
    crs = Conic("aea", 29.5, 45.5, 23.0, -96.0)
    out = spark.createDataFrame([(0.0, 1e8), (None, 1.0), (0.0, 0.0)], "x double, y double").select(*crs.inverse(F.col("x"), F.col("y"))).collect()
    assert out[0][0] is None and out[1][0] is None and abs(out[2][0] - 23) < 1e-9 and abs(out[2][1] + 96) < 1e-9


def test_corrected_points_are_centres_of_blocks(spark):
    """A point's place is the middle of its block, also of one that reaches over the edge; corners are halves of a block away."""
    crs = Conic("aea", 29.5, 45.5, 37.5, -96.0)
    points = spark.createDataFrame([(0, 9.0), (4, 9.0), (None, 9.0)], "sc_point_gid long, lat double")
    out = {r["sc_point_gid"]: r for r in corrected_points(points, crs, 130, 64, -1000.0, 90.0, 500.0, -90.0, corners=True).collect()}
    # Blocks of 64 in 130 columns: three in a row, so gid 4 is row 1, column 1.
    want = spark.createDataFrame([(32 - 0.5, 32 - 0.5), (96 - 0.5, 96 - 0.5)], "row double, col double")
    want = cell_places(want, crs, -1000.0, 90.0, 500.0, -90.0).collect()
    for gid, w in zip((0, 4), want):
        assert abs(out[gid]["lat"] - w["lat"]) < 1e-12 and abs(out[gid]["lon"] - w["lon"]) < 1e-12
    assert out[None]["lat"] is None and len(out[0]["ring"]) == 4
    assert out[4]["ring"][0]["lon"] < out[4]["lon"] < out[4]["ring"][3]["lon"] and out[4]["ring"][1]["lat"] < out[4]["lat"] < out[4]["ring"][0]["lat"]
