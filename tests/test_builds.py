"""Builds in batches, the footer pass, collections of many tasks, clustering, the nearest places and the prefix dictionary."""

import json
import math
import random
import struct
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plotwise.operators import builds, search, space
from plotwise.sources import collections, lake, tables
from plotwise.sources.shared import written


def village(root: Path, vlg: int, rows: list[str], columns=("survey_no", "village_name", "village_code")):
    folder = root / "dist_1" / "taluk_2" / "hobli_3"
    folder.mkdir(parents=True, exist_ok=True)
    values = {"survey_no": rows, "village_name": [f"v{vlg}"] * len(rows), "village_code": [str(vlg)] * len(rows), "geometry": [struct.pack("<BII", 1, 3, 0)] * len(rows)}
    pq.write_table(pa.table({c: values[c] for c in (*columns, "geometry")}), folder / f"vlg_{vlg}.parquet")


@pytest.fixture
def root(tmp_path):
    for v in range(7):
        village(tmp_path / "lake", v, [f"{v}{i}/1" for i in range(5)])
    return tmp_path


def state(spark, to):
    return sorted(tuple(r) for r in builds.read_index(spark, to).drop("file").collect())


def test_stopped_build_goes_on(spark, root):
    lake_, one, two = str(root / "lake"), str(root / "one"), str(root / "two")
    assert builds.build_lake_index(spark, lake_, one) == 1
    assert builds.build_lake_index(spark, lake_, two, per_batch=2, batches=2) == 2
    assert len(state(spark, two)) == 20
    half = {r.file: r.batch for r in builds.manifest(spark, two).collect()}
    assert builds.build_lake_index(spark, lake_, two, per_batch=2) == 2
    assert state(spark, one) == state(spark, two) and len(state(spark, two)) == 35
    after = {r.file: r.batch for r in builds.manifest(spark, two).collect()}
    assert len(after) == 7 and {k: after[k] for k in half} == half
    assert builds.build_lake_index(spark, lake_, two) == 0
    assert search.survey_search(builds.read_index(spark, two), "34").count() == 1


def test_failed_batch_leaves_the_last_committed_state(spark, root):
    to, seen = str(root / "index"), []

    def read(paths):
        seen.append(sorted(paths))
        if len(seen) == 2:
            raise OSError("lost")
        return search.survey_index(lake.read_files(spark, paths), ("file",))

    listed = lake.files(spark, str(root / "lake"))
    with pytest.raises(OSError, match="lost"):
        builds.build_in_batches(listed, to, read, per_batch=3)
    assert len(state(spark, to)) == 15
    # A half-written folder that no manifest vouches for is not seen, and is written anew.
    builds.read_index(spark, to).drop("file").withColumnRenamed("survey_key", "survey_key").write.parquet(f"{to}/rows/batch=2")
    builds.build_in_batches(listed, to, read, per_batch=3)
    assert len(state(spark, to)) == 35 and seen[2] == seen[1] and not set(seen[0]) & set(seen[3])


def test_changed_and_lost_files(spark, root):
    lake_, to, fresh = str(root / "lake"), str(root / "index"), str(root / "fresh")
    builds.build_lake_index(spark, lake_, to, per_batch=4)
    village(root / "lake", 3, ["99/1", "98/2", "97"])
    (root / "lake/dist_1/taluk_2/hobli_3/vlg_5.parquet").unlink()
    village(root / "lake", 9, ["1"])
    assert builds.build_lake_index(spark, lake_, to, per_batch=4) == 1
    builds.build_lake_index(spark, lake_, fresh)
    assert state(spark, to) == state(spark, fresh)
    builds.compact(spark, to)
    assert state(spark, to) == state(spark, fresh) and builds.build_lake_index(spark, lake_, to) == 0
    assert len(list((root / "index/rows").glob("batch=*"))) == 1


def test_files_without_a_column_are_left_out(spark, root):
    village(root / "lake", 20, ["8/1"], columns=("survey_no", "village_code"))
    village(root / "lake", 21, [])
    (root / "lake/dist_1/taluk_2/hobli_3/vlg_22.parquet").write_bytes(b"no parquet")
    listed = lake.files(spark, str(root / "lake"))
    assert listed.count() == 10
    assert sorted(r.path[-13:] for r in lake.having(listed).collect()) == [f"vlg_{i}.parquet" for i in range(7)]
    builds.build_lake_index(spark, str(root / "lake"), str(root / "index"))
    assert len(state(spark, str(root / "index"))) == 35
    assert lake.scan(spark, str(root / "lake"), needed=lake.NEEDED).count() == 35 and lake.scan(spark, str(root / "lake")).count() == 36


def features_of(spark, n):
    feature = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"name":"'), F.when(F.col("id") % 3 == 0, "é,\\n\\\"").otherwise("x"), F.lit('","id":'), F.col("id").cast("string"), F.lit("}}"))
    return spark.range(n).repartition(5).select("id", feature.alias("feature"))


def test_one_collection_of_many_tasks(spark, tmp_path):
    to = tmp_path / "out" / "hobli.geojson"
    to.parent.mkdir()
    collections.write_collection(features_of(spark, 500), [F.col("id").desc()], str(to))
    got = json.loads(to.read_text())
    assert got["type"] == "FeatureCollection" and [f["properties"]["id"] for f in got["features"]] == list(range(499, -1, -1))
    back = collections.read_collection(spark, str(to)).orderBy("place").collect()
    assert [r.place for r in back] == list(range(1, 501)) and [json.loads(r.feature) for r in back] == got["features"]
    collections.write_collection(features_of(spark, 0), ["id"], f"file://{to}")
    assert json.loads(to.read_text()) == {"type": "FeatureCollection", "features": []}
    assert [p.name for p in to.parent.iterdir() if not p.name.startswith(".")] == ["hobli.geojson"]


def test_failed_task_leaves_no_file(spark, tmp_path):
    to = tmp_path / "hobli.geojson"
    bad = features_of(spark, 50).withColumn("feature", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="lost"):
        collections.write_collection(bad, ["id"], str(to))
    assert list(tmp_path.iterdir()) == []


def groups(path):
    for p in sorted(Path(path).glob("*.parquet")):
        meta = pq.ParquetFile(p).metadata
        for i in range(meta.num_row_groups):
            yield {meta.row_group(i).column(j).path_in_schema: meta.row_group(i).column(j) for j in range(meta.num_columns)}


def test_places_along_a_curve_prune_in_both_directions(spark, tmp_path):
    places = spark.range(40_000).select(F.col("id").alias("lgd_code"), (F.col("id") * 7919 % 7001 / 1000 + 10).alias("centroid_lat"), (F.col("id") * 104729 % 6997 / 1000 + 74).alias("centroid_lng"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("geom_geojson"))
    box = {"centroid_lat": (12.9, 13.3), "centroid_lng": (77.4, 77.8)}
    read = {}
    for name in ("curve", "latitude"):
        to = str(tmp_path / name)
        if name == "curve":
            builds.write_places(places, to, row_group=200_000)
        else:
            placed = places.repartitionByRange("centroid_lat").sortWithinPartitions("centroid_lat").write
            placed.option("parquet.block.size", 200_000).option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100).parquet(to)
        hit = [all(low <= g[c].statistics.max and g[c].statistics.min <= high for c, (low, high) in box.items()) for g in groups(to)]
        read[name] = sum(hit) / len(hit)
        assert len(hit) > 16 and spark.read.parquet(to).count() == 40_000
    assert read["curve"] < read["latitude"] / 1.5 and read["curve"] < 0.25


def test_bloom_filters_of_users(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("id") % 700).cast("string")).alias("user_id"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("location"), F.timestamp_seconds("id").alias("created_at"))
    tables.write_projects(rows, str(tmp_path / "projects"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "projects").glob("*.parquet"))
    plain = tmp_path / "plain"
    rows.write.parquet(str(plain))
    assert len(raw) > sum(p.stat().st_size for p in plain.glob("*.parquet")) + 50_000
    assert spark.read.parquet(str(tmp_path / "projects")).where("user_id = 'u12'").count() == 5


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_brute_force(spark, k):
    draw = random.Random(k)
    places = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(150)] + [(200 + i, 12.9 + draw.uniform(-0.02, 0.02), 77.5 + draw.uniform(-0.02, 0.02)) for i in range(400)]
    places += [(900, 12.9, 77.5), (901, 12.9, 77.5), (902, 90.0, 10.0), (903, -90.0, 0.0), (904, 0.0, 180.0), (905, None, 3.0), (906, 0.0, -179.999)]
    points = [(1, 12.9, 77.5), (2, 89.9, -170.0), (3, -89.99, 40.0), (4, 0.0, -179.9), (5, 0.0, 179.99), (6, -40.0, -120.0), (7, None, 1.0)] + [(10 + i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(12)]
    p, q = spark.createDataFrame(points, "point_id long, lat double, lng double"), spark.createDataFrame(places, "lgd_code long, centroid_lat double, centroid_lng double")
    got = {(r.point_id, r["rank"]): (r.lgd_code, round(r.km, 6)) for r in space.nearest(p, q, k).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    want = {}
    for i, lat, lng in points:
        if lat is not None:
            best = sorted((km(lat, lng, b, c), a) for a, b, c in places if b is not None)[:k]
            want |= {(i, r + 1): (a, round(d, 6)) for r, (d, a) in enumerate(best)}
    assert got == want
    few = space.nearest(p, q.where("lgd_code in (900, 902)"), 3).collect()
    assert len(few) == 2 * 18 and space.nearest(p.limit(0), q, 2).count() == 0 and space.nearest(p, q.limit(0), 2).count() == 0


def test_dictionary_answers_as_the_search(spark):
    draw = random.Random(2)
    rows = [(f"{draw.choice(('3', '30', '301', '3A', 'x'))}{draw.randint(0, 40)}/{draw.randint(1, 3)}", f"v{draw.randint(0, 3)}", "c", "1", "2", "3", str(draw.randint(1, 4))) for _ in range(500)]
    index = search.survey_index(spark.createDataFrame(rows, "survey_no string, village_name string, village_code string, dist string, taluk string, hobli string, vlg string"))
    known = written(search.prefix_dictionary(index))
    assert "WindowGroupLimit" in search.prefix_dictionary(index)._jdf.queryExecution().executedPlan().toString()
    for q in ("30", "3", "301/7", "3a1", " X4 ", "zz", "3013"):
        assert [tuple(r) for r in search.dictionary_search(known, q).collect()] == [tuple(r) for r in search.survey_search(index, q).collect()]
