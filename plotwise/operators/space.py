"""Village boundaries, places within a radius, the parcel under a point."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..sources.shared import numbered, shuffled, small, written
from . import overlay, quadtree, rings

HIERARCHY = ["dist", "taluk", "hobli", "vlg"]


def outer_segments(parcels: DataFrame, keys: list[str], snap: int = 9) -> DataFrame:
    """Segments (keys, ax, ay, bx, by) that only one ring of the group has, with the polygon on their left: shared borders cancel. Partial
    counts go before the shuffle."""
    each = parcels.where(F.col("mpoly").isNotNull()).select(*keys, F.explode("mpoly").alias("poly")).select(*keys, F.posexplode("poly").alias("i", "ring"))
    snapped = F.transform("ring", lambda p: geo.point(F.round(p["x"], snap), F.round(p["y"], snap)))
    turned = each.select(*keys, snapped.alias("r"), ((geo.signed_area(F.col("ring")) > 0) == (F.col("i") == 0)).alias("left"))
    edges = turned.select(*keys, "left", F.explode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e")).where("e.a <> e.b")
    ordered = edges.select(*keys, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), ((F.col("e.a") < F.col("e.b")) == F.col("left")).alias("up"))
    once = ordered.groupBy(*keys, "a", "b").agg(F.count("*").alias("_n"), F.max("up").alias("up")).where("_n = 1")
    one, two = F.when(F.col("up"), F.col("a")).otherwise(F.col("b")), F.when(F.col("up"), F.col("b")).otherwise(F.col("a"))
    return once.select(*keys, one.alias("p"), two.alias("q")).select(*keys, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def dissolve(parcels: DataFrame, keys: list[str], tile: int = rings.TILE) -> DataFrame:
    """(keys, mpoly, exact): the union of each group's polygons.

    Where neighbours share their borders vertex by vertex these cancel, and what is left is the union: ``exact``. Groups whose rings do not
    nest as shells and holes do, do not close, or whose remaining borders meet, hold overlaps, unequal borders or polygons that cross
    themselves; their union is made by an overlay of the edges and ``exact`` is false. Borders are put together in many tasks (``rings``);
    a group is one row only in the result."""
    outer = written(outer_segments(parcels, keys))
    own = written(rings.nested(rings.rings_of(outer, keys, tile), keys))
    nests = F.when(F.col("area") > 0, F.col("within") == 0).otherwise(F.col("within") == 1)
    told = own.groupBy(*keys).agg(F.min(nests).alias("nests"), F.sum(F.size("ring") - 1).alias("closed"))
    given = parcels.groupBy(*keys).agg(F.count("*").alias("parcels")).join(outer.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left")
    meets = overlay.meeting(overlay.undirected(outer, keys), keys).withColumn("meets", F.lit(True))
    judged = given.join(told, keys, "left").join(meets, keys, "left").select(*keys, F.coalesce(F.col("nests") & (F.col("closed") == F.col("_n")) & F.col("meets").isNull(), F.lit(False)).alias("exact"))
    judged = written(judged)
    plain = rings.polygons(own.join(judged.where("exact"), keys, "left_semi"), keys).withColumn("exact", F.lit(True))
    rough = judged.where("not exact")
    if not rough.limit(1).count():
        return plain
    border = written(overlay.border(parcels.join(rough, keys, "left_semi"), keys))
    other = rings.polygons(rings.nested(rings.rings_of(border, keys, tile), keys), keys)
    return plain.unionByName(other.withColumn("exact", F.lit(False)))


def boundaries(parcels: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Per village: keys, village_name, has_data, mpoly. Villages of the name list without any parcel follow with has_data false.
    A village whose parcels yield no polygon appears in neither part. A village that the list does not name has the name in the first
    row of its first file (columns path and pos, as far as there are; else by survey number)."""
    order = [c for c in ("path", "pos") if c in parcels.columns] or ["survey_no"]
    first = parcels.groupBy(*keys).agg(F.min_by(text.no_null(F.col("village_name")), F.struct(*order)).alias("own_name"))
    own = dissolve(parcels.where(F.size("mpoly") > 0), keys).join(first, keys).join(names.select(*keys, "name"), keys, "left")
    have = own.select(*keys, F.coalesce(F.nullif("name", F.lit("")), F.nullif("own_name", F.lit("")), F.lit("")).alias("village_name"), F.lit(True).alias("has_data"), "mpoly")
    none = names.join(parcels.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("name").alias("village_name"), F.lit(False).alias("has_data"))
    return have.unionByName(none, allowMissingColumns=True).orderBy(F.col("has_data").desc(), *keys)


def enrich(villages: DataFrame, roster: DataFrame, names: DataFrame, with_data: DataFrame) -> DataFrame:
    """Villages with their codes by the roster (last row of a code wins), else by squashed name if the roster is empty
    (first key wins); match_method says which. has_data tells whether the lake has the village. A village without a name takes the
    list's name of its codes, else ''. Other columns of ``villages``, as its geometry, stay."""
    last = roster.groupBy("lgd_code").agg(F.max_by(F.struct(*HIERARCHY), "pos").alias("h")).select("lgd_code", "h.*")
    if roster.isEmpty():
        by_name = names.where("level = 'vlg'").withColumn("k", text.squashed(F.col("name"))).groupBy("k").agg(F.min_by(F.struct(*HIERARCHY), "pos").alias("h")).select("k", "h.*")
        out = villages.withColumn("k", text.squashed(F.col("village_name"))).join(by_name, "k", "left").drop("k").withColumn("match_method", F.when(F.col("vlg").isNotNull(), "name"))
    else:
        out = villages.join(last, "lgd_code", "left").withColumn("match_method", F.when(F.col("vlg").isNotNull(), "roster"))
    have = with_data.select(*HIERARCHY).distinct().withColumn("d", F.lit(True))
    listed = names.where("level = 'vlg'").groupBy(*HIERARCHY).agg(F.min_by("name", "pos").alias("_listed"))
    out = out.join(have, HIERARCHY, "left").join(listed, HIERARCHY, "left")
    name = F.coalesce(F.nullif(text.no_null(F.col("village_name")), F.lit("")), "_listed", F.lit(""))
    return out.withColumns({"has_data": F.coalesce("d", F.lit(False)), "village_name": name}).drop("d", "_listed")


def nearby(places: DataFrame, lat: float, lng: float, km: float = 5.0, id_: str = "lgd_code") -> DataFrame:
    """Places within ``km`` of a point (inclusive), nearest first, with their distance; without a coordinate a place is never near."""
    if not 0.1 <= km <= 50:
        raise ValueError("km must lie in [0.1, 50]")
    at = (F.col("centroid_lat"), F.col("centroid_lng"))
    box = places.where(geo.in_radius_box(*at, lat, lng, km) & geo.valid_coordinate(*at))
    return box.withColumn("km", geo.haversine_km(F.lit(lat), F.lit(lng), *at)).where(F.col("km") <= km).orderBy("km", id_)


class Grid:
    """Cells of the globe for a radius: latitude is cut into bands as high as it, each band into as many cells as the longest reach in
    longitude of a pair that touches it allows, around the whole circle. So cells also meet across 180 degrees, and a band at a pole is
    one cell. A place lies in one cell; all places within the radius of a point lie in the three nearest cells of its own band and of both bands beside it."""

    def __init__(self, km: float):
        self.half = math.sin(km / geo.EARTH_KM / 2)
        self.dlat = math.degrees(km / geo.EARTH_KM) * 1.0001

    def cells(self, band: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs(band * self.dlat), F.abs((band + 1) * self.dlat)) + self.dlat)
        reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(self.half) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))))) * 1.0001
        return F.greatest(F.lit(1.0), F.floor(360 / reach)).cast("long")

    def at(self, lng: str, band: Column) -> Column:
        return F.pmod(F.floor((F.col(lng) + 180) / 360 * self.cells(band)).cast("long"), self.cells(band))

    def lying(self, places: DataFrame) -> DataFrame:
        """Places that have a coordinate, with their cell (cx, cy)."""
        known = places.where(geo.valid_coordinate(F.col("centroid_lat"), F.col("centroid_lng"))).withColumn("cy", F.floor(F.col("centroid_lat") / self.dlat))
        return known.withColumn("cx", self.at("centroid_lng", F.col("cy")))

    def asking(self, points: DataFrame) -> DataFrame:
        """A row for each cell that a point (lat, lng) asks."""
        band = F.floor(F.col("lat") / self.dlat)
        left = points.withColumn("cy", F.explode(F.array(band - 1, band, band + 1)))
        near = F.array_distinct(F.array(*[F.pmod(self.at("lng", F.col("cy")) + i, self.cells(F.col("cy"))) for i in (-1, 0, 1)]))
        return left.withColumn("cx", F.explode(near))


#: Points, and places, of a cell that meet in one group of the join: so a task's pairs depend on neither how full a cell is nor the input's files.
BLOCK = 1024
#: Pairs of rows that a task of the join compares, on average: full blocks of either side make 16 groups, so no task has many times as many.
PAIRS = 1 << 24


def blocks(df: DataFrame, counts: DataFrame, number: int, name: str) -> DataFrame:
    """``df`` (cx, cy, _r) with ``name``, the row's block: cells of ``counts`` (cx, cy, n) are cut in blocks of about ``BLOCK`` by the chance
    ``_r`` that was written with the row, so copies of a row are parted too. ``number`` is how many cells there are."""
    many = F.ceil(F.col("n") / BLOCK)
    return df.join(small(counts, number, 32), ["cx", "cy"]).withColumn(name, F.floor(F.col("_r") * many).cast("int")).drop("n", "_r")


def on_sphere(df: DataFrame, lat: str, lng: str, prefix: str) -> DataFrame:
    """Adds the place's three coordinates on the unit sphere."""
    a, b = F.radians(lat), F.radians(lng)
    return df.withColumns({f"{prefix}x": F.cos(a) * F.cos(b), f"{prefix}y": F.cos(a) * F.sin(b), f"{prefix}z": F.sin(a)})


def nearby_batch(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """All pairs within ``km``, anywhere on the globe, by an equi-join on the cells of ``Grid``.

    Full cells are cut in blocks on both sides, and every block of points meets every block of places, so the pairs of a full cell are
    listed by many tasks: as many as the counted pairs ask for, so the longest does not grow with them. Pairs whose chord through the sphere is too long are left out before the distance is computed."""
    grid, context = Grid(km), points.sparkSession.sparkContext
    # A table of one row group would be placed by one task.
    points, places = (df.repartition(context.defaultParallelism) for df in (points, places))
    asking = written(on_sphere(grid.asking(points), "lat", "lng", "_p").withColumn("_r", F.rand()))
    lying = written(on_sphere(grid.lying(places), "centroid_lat", "centroid_lng", "_q").withColumn("_r", F.rand()))
    count = lambda df, n: df.groupBy("cx", "cy").agg(F.count("*").alias(n))
    # Only cells that both sides have matter.
    full = written(count(asking, "asked").join(count(lying, "placed"), ["cx", "cy"]))
    number, pairs = full.agg(F.count("*"), F.sum(F.col("asked").cast("double") * F.col("placed"))).first()
    rows = lambda n: full.select("cx", "cy", F.col(n).alias("n"))
    left = blocks(asking, rows("asked"), number, "_i").join(small(full.select("cx", "cy", F.ceil(F.col("placed") / BLOCK).alias("_n")), number, 32), ["cx", "cy"])
    right = blocks(lying, rows("placed"), number, "_j").join(small(full.select("cx", "cy", F.ceil(F.col("asked") / BLOCK).alias("_m")), number, 32), ["cx", "cy"])
    left = left.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1))).drop("_n")
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m").cast("int") - 1))).drop("_m")
    chord = reduce(Column.__add__, [(F.col(f"_p{k}") - F.col(f"_q{k}")) * (F.col(f"_p{k}") - F.col(f"_q{k}")) for k in "xyz"])
    key = ["cx", "cy", "_i", "_j"]
    # At least as many parts as a session shuffles to, whatever the bytes, and more as the pairs grow: these are the work, not the rows.
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * context.defaultParallelism, math.ceil((pairs or 0) / PAIRS))
    both = left.repartition(parts, *key).join(right.repartition(parts, *key).hint("shuffle_hash"), key).where(chord <= (2 * math.sin(min(math.pi / 2, km / geo.EARTH_KM / 2))) ** 2 * (1 + 1e-9) + 1e-14)
    both = both.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("centroid_lat"), F.col("centroid_lng")))
    return both.where(F.col("km") <= km).drop(*key, *[f"_{s}{k}" for s in "pq" for k in "xyz"])


def nearest(points: DataFrame, places: DataFrame, k: int, id_: str = "lgd_code", widen: float = 3.0, crowd: int = 64) -> DataFrame:
    """(point_id, rank, id, km): the ``k`` nearest places of each point (point_id, lat, lng), by distance, then id; fewer where there are
    fewer places, none for a point without a valid coordinate.

    Places are counted on grids of growing radius, from one whose fullest cell has at most ``crowd * k`` places. A round compares only
    the points that have k places in the cells they ask, and settles those of them that have k within the radius: these are the nearest.
    The others go on to a radius ``widen`` times as large. So a point meets places of cells that were too poor for it one
    radius before, and no round lists pairs over the globe unless all the places are so few."""
    globe = math.pi * geo.EARTH_KM * (1 + 1e-12)
    slim = written(places.where(geo.valid_coordinate(F.col("centroid_lat"), F.col("centroid_lng"))).select(id_, "centroid_lat", "centroid_lng"))
    total = slim.count()
    left = written(points.where(geo.valid_coordinate(F.col("lat"), F.col("lng"))).select("point_id", "lat", "lng"))
    full = lambda km: Grid(km).lying(slim).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    km = min(globe, math.sqrt(k * 510e6 / max(1, total)))
    while km > 0.01 and (full(km).agg(F.max("n")).first()[0] or 0) > crowd * k:
        km /= widen
    order = Window.partitionBy("point_id").orderBy("km", id_)
    out = None
    while not left.isEmpty():
        last = km >= globe
        rich = left if last else Grid(km).asking(left).join(full(km), ["cx", "cy"]).groupBy("point_id", "lat", "lng").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")
        pairs = nearby_batch(rich, slim, km).select("point_id", id_, "km").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = written(pairs)
        done = found.where(F.col("rank") == (min(k, total) if last else k)).select("point_id")
        out = found.join(done, "point_id", "left_semi") if out is None else out.unionByName(found.join(done, "point_id", "left_semi"))
        if last:
            break
        left = written(left.join(done, "point_id", "left_anti"))
        km = min(globe, km * widen)
    empty = nearby_batch(left.limit(0), slim.limit(0), 1.0).select("point_id", id_, "km").withColumn("rank", F.lit(0))
    return (empty if out is None else out).select("point_id", "rank", id_, "km")


def without_village(places: DataFrame, **codes: str) -> DataFrame:
    """All but the given village, compared null-safely on every code given."""
    same = F.lit(True)
    for k, v in codes.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return places.where(~same)


def nearest_with_data(near: DataFrame, id_: str = "lgd_code") -> DataFrame:
    """The nearest mapped place that has data, else the nearest mapped one."""
    return near.where(F.col("vlg").isNotNull()).orderBy(F.col("has_data").desc(), "km", id_).limit(1)


#: Parts of parcels that points meet in the first round of ``parcels_under``, and how many times as many each next round has.
FIRST, GROWTH = 16_384, 4


def parcels_under(points: DataFrame, parcels: DataFrame, first: int = FIRST) -> DataFrame:
    """Per point (point_id, x, y) the parcel whose box is smallest of those that hold it (first by pos on a tie). A parcel holds what the
    outer ring of any of its parts does, so a point in a hole is a hit. Both sides meet on cells of a quadtree.

    Parcels come in rounds by the size of their box, each with ``GROWTH`` times as many as the one before, and a point that is held goes: no
    later parcel is smaller. So a point under many parcels meets few of them, and hits grow with the points, not with points times parcels."""
    parts = parcels.where(F.size("mpoly") > 0).withColumn("_area", geo.box_area(geo.bbox(F.col("mpoly")))).select("parcel_id", "pos", "_area", F.explode("mpoly").alias("part"))
    ranked = numbered(parts.select("parcel_id", "pos", "_area", F.slice("part", 1, 1).alias("rings")), ["_area", "pos"], "_n", 0)
    total, left, start, size, out = ranked.count(), written(points.select("point_id", "x", "y")), 0, first, None
    while out is None or start < total and not left.isEmpty():
        # The rows of a range lie in few files: they are dealt anew.
        some = ranked.where((F.col("_n") >= start) & (F.col("_n") < start + size)).repartition(left.sparkSession.sparkContext.defaultParallelism, "_n")
        hits = quadtree.held_by(left, written(quadtree.covers(some, ["parcel_id", "pos", "_area"])), "x", "y")
        found = written(hits.groupBy("point_id").agg(F.min_by("parcel_id", F.struct("_area", "pos")).alias("parcel_id")))
        out = found if out is None else out.unionByName(found)
        held = found.select(F.col("point_id").alias("_held"))
        left = written(left.join(shuffled(held), F.col("point_id").eqNullSafe(F.col("_held")), "left_anti"))
        start, size = start + size, size * GROWTH
    return out
