"""Quirks, geometry and sources on hand-made rows."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from plotwise.functions import geo, text, wkb
from plotwise.operators import builds, features, records, search, space
from plotwise.sources import lake, tables


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def ring_wkb(points):
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


@pytest.mark.parametrize(("raw", "number"), [("12A/2", 12), ("abc", 0), ("-5", -5), (" 30 ", 30), ("", 0), (None, 0)])
def test_leading_int(spark, raw, number):
    assert one(spark, text.leading_int(F.lit(raw).cast("string"))) == number


def test_survey_search_takes_wildcards_as_text(spark):
    rows = [(n, "v", "c", "1", "1", "1", "1") for n in ("30/1", "30/1", "1_2", "1%2", "12A", "", None)]
    df = spark.createDataFrame(rows, "survey_no string, village_name string, village_code string, dist string, taluk string, hobli string, vlg string")
    index = search.survey_index(df)
    assert {r.survey_no for r in index.collect()} == {"30/1", "1_2", "1%2", "12A"}
    assert [r.survey_no for r in search.survey_search(index, "1_").collect()] == ["1_2"]
    assert [r.survey_no for r in search.survey_search(index, "12a").collect()] == ["12A"]
    assert search.survey_search(index, "3 ").count() == 0


def test_utm_known_point(spark):
    p = one(spark, geo.utm43n_inverse(F.lit(781481.0203), F.lit(1435426.4069)))
    assert abs(p.y - 12.9716) < 1e-8 and abs(p.x - 77.5946) < 1e-8


def test_haversine_antipode_and_zero(spark):
    assert abs(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - 20015.0868) < 1e-3
    assert one(spark, geo.haversine_km(F.lit(9.0), F.lit(9.0), F.lit(9.0), F.lit(9.0))) == 0


def test_nearby_is_inclusive_and_drops_missing(spark):
    rows = [(1, 12.0, 77.0), (2, float("nan"), 77.0), (3, None, 77.0), (4, 12.0, 77.5)]
    df = spark.createDataFrame(rows, "lgd_code long, centroid_lat double, centroid_lng double")
    assert [r.lgd_code for r in space.nearby(df, 12.0, 77.0, 5.0).collect()] == [1]
    with pytest.raises(ValueError, match="km"):
        space.nearby(df, 12.0, 77.0, 99.0)


def test_wkb_kinds_and_bad_bytes():
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert wkb.decode(ring_wkb(square))["kind"] == "Polygon"
    multi = struct.pack("<BII", 1, 6, 2) + ring_wkb(square) * 2
    assert len(wkb.decode(multi)["parts"]) == 2
    assert wkb.decode(struct.pack("<BIdd", 1, 1, 3.0, 4.0)) == {"kind": "Point", "parts": []}
    assert wkb.decode(None) is None and wkb.decode(b"\x01\x03") is None
    nested = struct.pack("<BII", 1, 7, 1) + struct.pack("<BII", 1, 7, 1) + ring_wkb(square)
    assert wkb.decode(nested)["parts"] == []


def test_lake_scan_prunes_and_projects(spark, tmp_path):
    square = [(1435426.4069, 781481.0203), (1435427.4069, 781481.0203), (1435427.4069, 781482.0203), (1435426.4069, 781481.0203)]
    df = spark.createDataFrame([("30/1", "A", "9", bytearray(ring_wkb(square))), ("31", "A", "9", None)], lake.PARCELS)
    for v in ("46", "47"):
        p = tmp_path / "lake" / "dist_1" / "taluk_9" / "hobli_3"
        p.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_parquet(p / f"vlg_{v}.parquet")
    (p / "vlg_48.parquet").write_bytes(b"junk")
    got = lake.polygons(lake.scoped(lake.scan(spark, str(tmp_path / "lake")), dist="1", vlg="46", taluk="")).collect()
    assert [(r.survey_no, r.vlg, r.kind) for r in got] == [("30/1", "46", "Polygon")]
    assert abs(got[0].mpoly[0][0][0].x - 77.5946) < 1e-6
    assert [r.code for r in lake.list_codes(lake.scan(spark, str(tmp_path / "lake")).select("vlg"), "vlg").collect()] == ["46", "47"]
    lake.rewrite(lake.scan(spark, str(tmp_path / "lake")), str(tmp_path / "out"))
    again = lake.read_rewritten(spark, str(tmp_path / "out"))
    assert dict(again.dtypes)["dist"] == "string" and again.count() == 4


def squares(spark, boxes):
    poly = lambda x, y, w: [[[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]]]
    return spark.createDataFrame([("k", poly(*b)) for b in boxes], "k string, mpoly array<array<array<struct<x: double, y: double>>>>")


def test_dissolve_ring_around_a_hole_and_corner_touch(spark):
    ring = [(x, y, 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    got = space.dissolve(squares(spark, ring), ["k"]).first()
    assert got.exact and len(got.mpoly) == 1 and len(got.mpoly[0]) == 2
    corner = space.dissolve(squares(spark, [(0, 0, 1), (1, 1, 1)]), ["k"]).first()
    assert corner.exact and len(corner.mpoly) == 2


def test_dissolve_flags_overlap(spark):
    for boxes in ([(0, 0, 2), (1, 1, 2)], [(0, 0, 2), (2, 0, 1)], [(0, 0, 2), (0, 0, 1)]):
        assert not space.dissolve(squares(spark, boxes), ["k"]).first().exact


@pytest.mark.parametrize(("boxes", "area", "parts", "holes"), [
    ([(0, 0, 2), (1, 1, 2)], 7, 1, 0),
    ([(0, 0, 2), (2, 0, 1)], 5, 1, 0),
    ([(0, 0, 2), (0, 0, 1)], 4, 1, 0),
    ([(0, 0, 2), (0, 0, 2)], 4, 1, 0),
    ([(0, 0, 3), (2, 0, 3), (0, 2, 3), (2, 2, 3), (9, 9, 1)], 26, 2, 0),
    ([(x, y, 1.5) for x in range(0, 6, 1) for y in range(0, 6, 1) if x in (0, 5) or y in (0, 5)], 6.5 * 6.5 - 3.5 * 3.5, 1, 1),
])
def test_dissolve_makes_the_union(spark, boxes, area, parts, holes):
    got = space.dissolve(squares(spark, boxes), ["k"]).withColumn("area", geo.area(F.col("mpoly"))).collect()
    assert len(got) == 1 and not got[0].exact and abs(got[0].area - area) < 1e-9
    assert len(got[0].mpoly) == parts and sum(len(p) - 1 for p in got[0].mpoly) == holes


def inside(ring, x, y):
    """Even-odd by a ray to the right."""
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:])) % 2 == 1


def test_dissolve_tilted_and_bow_tie(spark):
    """Against areas by a fine grid of points."""
    import random

    draw, shapes = random.Random(2), []
    for _ in range(12):
        x, y = draw.uniform(0, 6), draw.uniform(0, 6)
        ring = [(x, y), (x + draw.uniform(1, 3), y + draw.uniform(-1, 1)), (x + draw.uniform(1, 3), y + draw.uniform(1.5, 3)), (x + draw.uniform(-1, 0.5), y + draw.uniform(1, 3))]
        shapes.append(ring)
    shapes.append([(10, 0), (12, 2), (12, 0), (10, 2)])
    rows = [("k", [[[{"x": float(a), "y": float(b)} for a, b in [*r, r[0]]]]]) for r in shapes]
    df = spark.createDataFrame(rows, "k string, mpoly array<array<array<struct<x: double, y: double>>>>")
    got = space.dissolve(df, ["k"]).withColumn("area", geo.area(F.col("mpoly"))).first()
    n, step = 0, 0.02
    for i in range(int(14 / step)):
        for j in range(int(12 / step)):
            x, y = -1.5 + (i + 0.503) * step, -1.5 + (j + 0.507) * step
            n += any(inside([*r, r[0]], x, y) for r in shapes)
    assert not got.exact and abs(got.area - n * step * step) < 0.15


def test_point_in_hole_hits_and_smaller_box_wins(spark):
    df = squares(spark, [(0, 0, 4), (1, 1, 2)]).withColumn("parcel_id", F.monotonically_increasing_id()).coalesce(1).withColumn("pos", F.col("parcel_id"))
    df = df.withColumn("parcel_id", F.when(F.size("mpoly") > 0, geo.area(F.col("mpoly"))))
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.5, 0.5), (3, 9.0, 9.0)], "point_id int, x double, y double")
    assert {r.point_id: r.parcel_id for r in space.parcels_under(points, df).collect()} == {1: 4.0, 2: 16.0}


def test_geojson_round_trip(spark):
    df = squares(spark, [(0, 0, 1)]).select(geo.geojson(F.col("mpoly")).alias("g"), "mpoly")
    back = df.select(geo.from_geojson(F.col("g")).alias("b"), "mpoly", "g").first()
    assert back.b == back.mpoly and json.loads(back.g)["type"] == "Polygon"


def test_owners_keep_empty_numbers_and_prefer_first_source(spark):
    rows = [("a", "3/1", None, "", "x", "s", 1, 1), ("a", "3", "*", "2", "y", "s", 0, 2), ("", "3", None, None, "z", "s", 0, 3), ("", None, None, None, "w", "s", 1, 4)]
    df = spark.createDataFrame(rows, "Ack_No string, Survey_no string, surnoc string, hissano string, ownername string, Case_Status string, rank int, pos int")
    got = records.owners(df).collect()
    assert sorted((r.ack_no, r.owner) for r in got) == [("", "w"), ("", "z"), ("a", "y")]
    assert {r.survey_no for r in got} == {"3/*/2", "3/-/-", "/-/-"}
    assert {r.owner for r in records.owners(df, "3/9").collect()} == {"y", "z"}


def test_owners_drop_repeats_before_the_survey(spark):
    rows = [("a", "9", None, "", "first", "s", 0, 1), ("a", "3", None, "", "second", "s", 1, 1), ("b", "3/1", None, "", "third", "s", 1, 2)]
    df = spark.createDataFrame(rows, "Ack_No string, Survey_no string, surnoc string, hissano string, ownername string, Case_Status string, rank int, pos int")
    assert [r.owner for r in records.owners(df, "3").collect()] == ["third"]


def test_mutations_substring_and_exact(spark):
    df = spark.createDataFrame([("1", "t", "13, 4", "s", "a"), ("2", "t", "3/1,9", "s", "a"), ("3", "t", None, "s", "a")], "MRNumber string, TypeofTransaction string, SurveyNumbers string, status string, applicant string")
    assert records.mutations(df, "3").count() == 2
    assert [r.mr_number for r in records.mutations(df, "3", exact=True).collect()] == ["2"]


def test_payload_edges(spark):
    bodies = [("", 200), ("nodata", 200), ('"NoData"', 200), (json.dumps(json.dumps({"data": [{"k": 1}, {"k": 2}]})), 200), ('{"data": 5}', 200), ("[1]", 200), ('{"data":[{"k":3}]}', 500), (None, 200)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "id int, body string, status int")
    assert [(r.id, r.k) for r in tables.payload_records(df, "k: bigint").collect()] == [(3, 1), (3, 2)]


def test_names_skip_short_and_null(spark):
    df = spark.createDataFrame([(0, "1,2,3,4", "v|h|t|d"), (1, "1,2,3", "v|h|t"), (2, None, "a|b|c|d"), (3, "1,2,3,4", "w|h2|t2|d2")], "pos int, vlgcode string, vlgname string")
    assert {(r.level, r.name) for r in tables.explode_names(df).collect()} == {("vlg", "v"), ("hobli", "h"), ("taluk", "t"), ("dist", "d")}


def test_projects(spark, tmp_path):
    import datetime as dt

    row = tables.add_project(spark, str(tmp_path / "p"), {"id": "1", "user_id": "u", "name": "n", "created_at": dt.datetime(2024, 1, 1)})
    assert row.first().status == "needs-review"
    rows = spark.read.parquet(str(tmp_path / "p"))
    assert records.projects(rows, "u").first().location == "" and records.project(rows, "u", "2").isEmpty()
    assert records.project_stats(rows, dt.datetime(2024, 1, 1)).first().this_month == 1


def test_nearby_batch_at_the_poles_and_across_180(spark):
    import math

    at = [(80.0, 10.0), (80.0, 10.9), (0.0, 179.95), (0.0, -179.95), (89.99, 0.0), (89.99, 180.0), (-89.9, -90.0), (-89.95, 45.0), (12.0, 77.0), (60.5, 180.0), (60.5, -180.0), (90.0, 5.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "point_id int, lat double, lng double")
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(99, None, 1.0), (98, float("nan"), 1.0)], "lgd_code int, centroid_lat double, centroid_lng double")

    def km(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for radius in (0.5, 20.0, 2000.0):
        got = sorted((r.point_id, r.lgd_code) for r in space.nearby_batch(points, places, radius).collect())
        assert got == [(i, j) for i, p in enumerate(at) for j, q in enumerate(at) if km(p, q) <= radius]


def test_reference_systems(spark):
    grid = [(781481.0203, 1435426.4069), (781482.0203, 1435426.4069), (781482.0203, 1435427.4069), (781481.0203, 1435426.4069)]
    degrees = [(77.5946, 12.9716), (77.5947, 12.9716), (77.5947, 12.9717), (77.5946, 12.9716)]
    marked = struct.pack("<BIi", 1, 3 | 0x20000000, 4326) + ring_wkb(degrees)[5:]
    rows = [("lake", ring_wkb([(y, x) for x, y in grid])), ("grid", ring_wkb(grid)), ("degrees", ring_wkb(degrees)), ("marked", marked)]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k string, geometry binary")
    read = lambda k, **how: lake.polygons(df.where(F.col("k") == k), **how).first()
    for got in (read("lake"), read("grid", srid=None, exchanged=False), read("degrees", srid=4326), read("degrees", srid=None), read("marked")):
        assert got.srid == 4326 and abs(got.mpoly[0][0][0].x - 77.5946) < 1e-6 and abs(got.mpoly[0][0][0].y - 12.9716) < 1e-6
    with pytest.raises(Exception, match="reference system"):
        lake.polygons(df, srid=3857).collect()


def test_builds_and_their_counters(spark, tmp_path):
    cols = "survey_no string, village_name string, village_code string, dist string, taluk string, hobli string, vlg string"
    df = spark.createDataFrame([(f"{n}/1" if n else None, "v", "c", "1", "1", "1", str(n % 3)) for n in range(400)], cols)
    to = str(tmp_path / "index")
    assert tuple(builds.build_survey_index(df, to).first()) == (399, 3)
    assert tuple(builds.build_survey_index(df.limit(0), to).first()) == (399, 3)
    assert [r.survey_no for r in search.survey_search(spark.read.parquet(to), "39").collect()] == ["39/1", *[f"{n}/1" for n in range(390, 400)]]
    assert "PushedFilters: [IsNotNull(survey_key), StringStartsWith(survey_key,39)]" in search.survey_search(spark.read.parquet(to), "39")._jdf.queryExecution().toString()
    assert tuple(builds.build_survey_index(df.where("vlg = '1'"), to + "2", rebuild=True).first()) == (133, 1)
    raw = squares(spark, [(0, 0, 1), (2, 2, 2), (9, 9, 1), (300, 0, 1)]).withColumn("pos", F.col("mpoly")[0][0][0]["x"]).withColumns({"vil_lgd": F.when(F.col("pos") == 9, "x").otherwise("7"), "vilname11": F.lit("n"), "state_lgd": F.lit(29)})
    assert tuple(builds.build_villages(raw, str(tmp_path / "lgd"), 29).first()) == (4, 1, 2)
    assert [(r.lgd_code, r.centroid_lng) for r in spark.read.parquet(str(tmp_path / "lgd")).collect()] == [(7, 3.0)]
    assert builds.village_counts(raw.drop("vil_lgd"), 29).first().errors == 4
    raw.select(F.col("vil_lgd").alias("vil_lgd"), "vilname11", F.lit(bytearray(ring_wkb([(0, 0), (1, 0), (1, 1), (0, 0)]))).alias("geometry")).write.parquet(str(tmp_path / "raw"))
    assert tables.load_villages(tables.read_villages(spark, str(tmp_path / "raw"))).count() == 1


def test_collections(spark):
    none = squares(spark, []).withColumns({"kind": F.lit("Polygon"), "pos": F.lit(1)})
    assert features.parcel_collection(none, [], ["pos"]).first().collection == '{"type":"FeatureCollection","features":[]}'
    df = squares(spark, [(0, 0, 1), (5, 0, 1)]).withColumns({"kind": F.lit("Polygon"), "pos": -F.col("mpoly")[0][0][0]["x"], "survey_no": F.lit("7")})
    got = json.loads(features.parcel_collection(df, ["k"], ["pos"], "7").first().collection)
    assert [f["geometry"]["coordinates"][0][0][0] for f in got["features"]] == [5.0, 0.0] and got["features"][0]["properties"] == {"k": "k", "survey_no": "7"}
    assert features.parcel_collection(df, ["k"], ["pos"], "7/1").count() == 0


def test_lake_in_path_order(spark, tmp_path):
    for v in ("2", "10"):
        p = tmp_path / "dist_1" / "taluk_9" / "hobli_3"
        p.mkdir(parents=True, exist_ok=True)
        spark.createDataFrame([(f"{v}a", "A", "9", bytearray(b"x")), (f"{v}b", "A", "9", bytearray(b"x"))], lake.PARCELS).toPandas().to_parquet(p / f"vlg_{v}.parquet")
    got = lake.in_path_order(lake.scan(spark, str(tmp_path), placed=True)).collect()
    assert [(r.survey_no, r.pos) for r in got] == [("10a", 0), ("10b", 1), ("2a", 0), ("2b", 1)]


def test_first_name_of_the_first_file(spark):
    df = squares(spark, [(0, 0, 1), (1, 0, 1)]).withColumns({"pos": F.col("mpoly")[0][0][0]["x"], "survey_no": -F.col("mpoly")[0][0][0]["x"], "village_name": F.when(F.col("mpoly")[0][0][0]["x"] == 0, "first").otherwise("second")})
    listed = spark.createDataFrame([("k", ""), ("none", "N")], "k string, name string")
    assert [(r.village_name, r.has_data) for r in space.boundaries(df, listed, ["k"]).collect()] == [("first", True), ("N", False)]


def test_many_geometries_are_decoded_as_one_by_one():
    draw = random.Random(1)
    ring = lambda n: (lambda p: struct.pack("<I", n + 1) + b"".join(struct.pack("<dd", *q) for q in [*p, p[0]]))([(draw.random(), draw.random()) for _ in range(n)])
    poly = lambda k, n: struct.pack("<BII", 1, 3, k) + b"".join(ring(n) for _ in range(k))
    plain = [poly(1 + (i % 7 == 0), draw.randint(3, 40)) if i % 5 else struct.pack("<BII", 1, 6, 2) + poly(1, 9) + poly(2, 7) for i in range(60)]
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    odd = [None, b"", b"\x01\x03", struct.pack("<BIdd", 1, 1, 1.0, 2.0), struct.pack(">BIII8d", 0, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0), struct.pack("<BIiI", 1, 0x20000003, 4326, 1) + ring(5)]
    odd += [struct.pack("<BII", 1, 3, 0), struct.pack("<BIII6d", 1, 3, 1, 3, 0, 0, 1, 0, 1, 1), plain[1][:-5], struct.pack("<BII", 1, 7, 1) + ring_wkb(square), struct.pack("<BIII12d", 1, 1003, 1, 4, *[float(i % 9) for i in range(12)])]
    for v, got in zip([*odd, *plain], wkb.decode_all([*odd, *plain]).to_pylist(), strict=True):
        one = wkb.decode(v)
        assert got == ({"kind": one["kind"], "srid": one.get("srid"), "parts": one["parts"]} if one else {"kind": None, "srid": None, "parts": None})
    assert len(wkb.decode_all([])) == 0


def test_growing_sides_are_not_broadcast(spark, tmp_path):
    """Tables whose files are small may be large in memory: joins of rings, chains, cells and pieces shuffle both sides."""
    from plotwise.operators import overlay, quadtree, rings

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    segments = spark.createDataFrame([(k, *a, *b) for k in (1, 2) for a, b in zip(ring, ring[1:], strict=False)], "vlg int, ax double, ay double, bx double, by double")
    own = rings.nested(rings.rings_of(segments, ["vlg"]), ["vlg"])
    points = spark.createDataFrame([(1, 2.0, 2.0)], "vlg int, x double, y double")
    cells = quadtree.covers(own.select(F.col("vlg"), F.array("ring").alias("rings")), ["vlg"])
    for df in (own, rings.polygons(own, ["vlg"]), quadtree.held_by(points, cells, "x", "y", ["vlg"]), overlay.pairs(segments, ["vlg"])):
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def crowd(spark, at, n=300):
    """``n`` points and places beside one another, some of them alike."""
    rows = [(i, at[0] + i % 10 * 1e-4, at[1] + i // 20 * 1e-4) for i in range(n)]
    return spark.createDataFrame(rows, "point_id int, lat double, lng double"), spark.createDataFrame(rows, "lgd_code int, centroid_lat double, centroid_lng double")


def test_a_full_cell_is_listed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(space, "BLOCK", 64, raising=False)
    got = space.nearby_batch(*crowd(spark, (12.0, 77.0)), 20.0).select("point_id", "lgd_code", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 300 * 300 == len({(r.point_id, r.lgd_code) for r in got}) and len({r.task for r in got}) > 4


def test_a_full_pole_is_listed_by_many_tasks(spark, monkeypatch):
    """The band at a pole is one cell, whatever lies in it."""
    monkeypatch.setattr(space, "BLOCK", 64, raising=False)
    got = space.nearby_batch(*crowd(spark, (89.98, 77.0)), 400.0).select("point_id", "lgd_code", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 300 * 300 == len({(r.point_id, r.lgd_code) for r in got}) and len({r.task for r in got}) > 4


def test_a_point_under_many_parcels_meets_few(spark, monkeypatch):
    from plotwise.operators import quadtree

    met, held_by = [], quadtree.held_by

    def counted(*args):
        hits = held_by(*args)
        met.append(hits.count())
        return hits

    monkeypatch.setattr(quadtree, "held_by", counted)
    square = lambda w: [[[(-w, -w), (w, -w), (w, w), (-w, w), (-w, -w)]]]
    parcels = spark.createDataFrame([(i, i, square(1.0 + i // 4)) for i in reversed(range(400))], "parcel_id int, pos int, mpoly array<array<array<struct<x: double, y: double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 50.25, 0.5), (None, 99.5, 0.5), (4, 101.0, 0.0)], "point_id int, x double, y double")
    got = {(r.point_id, r.parcel_id) for r in space.parcels_under(points, parcels, 8).collect()}
    assert got == {(1, 0), (2, 200), (None, 396)} and sum(met) < 300


def test_parcels_of_one_file_are_looked_at_by_many_tasks(spark, monkeypatch):
    from plotwise.operators import valid

    tasks, written = [], valid.written

    def noted(df):
        tasks.append(df.rdd.getNumPartitions())
        return written(df)

    monkeypatch.setattr(valid, "written", noted)
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]
    parcels = spark.createDataFrame([(i, square) for i in range(50)], "parcel_id int, mpoly array<array<array<struct<x: double, y: double>>>>").coalesce(1)
    assert not any(r.repaired for r in valid.make_valid(parcels, ["parcel_id"]).collect()) and tasks[0] > 8


def test_tasks_of_the_pairs_grow_with_their_number(spark, monkeypatch):
    """Pairs grow with the square of the input: so many tasks as a session has would each get more and more of them."""
    monkeypatch.setattr(space, "BLOCK", 16)
    monkeypatch.setattr(space, "PAIRS", 1000, raising=False)
    usual = max(4, 8 * spark.sparkContext.defaultParallelism)
    got = space.nearby_batch(*crowd(spark, (89.98, 77.0)), 400.0).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 300 * 300 and len(got) > usual and max(r["count"] for r in got) < 10 * 1000
