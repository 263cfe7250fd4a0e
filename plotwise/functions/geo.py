"""Geometry as expressions. A point is struct<x, y> (x longitude or easting), a ring an array of points, a polygon an
array of rings (outer first), a multipolygon an array of polygons; a plain polygon is a multipolygon of one part."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: WGS84, and the universal transverse Mercator grid of zone 43 north.
A_AXIS, FLATTENING, SCALE, FALSE_EAST, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 75.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def in_radius_box(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """A box that holds every point within ``km``; longitude is left open at the poles and across 180 degrees."""
    angle = km / EARTH_KM
    dlat = math.degrees(angle)
    box = lat.between(at_lat - dlat, at_lat + dlat)
    reach = math.sin(angle) / max(1e-12, math.cos(math.radians(at_lat)))
    if abs(at_lat) + dlat >= 90 or reach >= 1 or angle >= math.pi / 2:
        return box
    dlng = math.degrees(math.asin(reach))
    if at_lng - dlng < -180 or at_lng + dlng > 180:
        return box
    return box & lng.between(at_lng - dlng, at_lng + dlng)


def _series(n: float) -> tuple[list[float], list[float], float]:
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return beta, delta, A_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def utm43n_inverse(easting: Column, northing: Column) -> Column:
    """Longitude and latitude, as a point, by the Krueger series."""
    beta, delta, radius = _series(FLATTENING / (2 - FLATTENING))
    xi, eta = northing / (SCALE * radius), (easting - FALSE_EAST) / (SCALE * radius)
    xi2, eta2 = xi, eta
    for j, b in enumerate(beta, 1):
        xi2 = xi2 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta2 = eta2 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(chi * (2 * j))
    return point(F.lit(MERIDIAN) + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(lat))


def swapped(p: Column) -> Column:
    return point(p["y"], p["x"])


def map_points(mpoly: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(mpoly, lambda poly: F.transform(poly, lambda ring: F.transform(ring, f)))


def to_wgs84(mpoly: Column) -> Column:
    """Parcels are stored with easting and northing exchanged: swap, then project."""
    return map_points(mpoly, lambda p: utm43n_inverse(p["y"], p["x"]))


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive if it runs counter-clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def polygon_area(poly: Column) -> Column:
    return F.abs(signed_area(poly[0])) - F.aggregate(F.slice(poly, F.lit(2), F.size(poly)), F.lit(0.0), lambda s, r: s + F.abs(signed_area(r)))


def area(mpoly: Column) -> Column:
    return F.aggregate(mpoly, F.lit(0.0), lambda s, poly: s + polygon_area(poly))


def centroid(mpoly: Column) -> Column:
    """Area-weighted plane centroid; holes subtract. Null if the area is 0. One fold over a ring gives its area and its moments."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums_of = lambda s, w, x, y: F.struct((s["w"] + w).alias("w"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"))

    def add(s: Column, e: Column) -> Column:
        k = e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        return sums_of(s, k / 2, (e["a"]["x"] + e["b"]["x"]) * k / 6, (e["a"]["y"] + e["b"]["y"]) * k / 6)

    moments = F.flatten(F.transform(mpoly, lambda poly: F.transform(poly, lambda ring, i: F.struct(F.aggregate(_edges(ring), zero, add).alias("m"), F.when(i == 0, 1.0).otherwise(-1.0).alias("s")))))
    # A ring's moments have the sign of its area, so either direction comes out the same.
    turn = lambda r: F.signum(r["m"]["w"]) * r["s"]
    sums = F.aggregate(moments, zero, lambda acc, r: sums_of(acc, turn(r) * r["m"]["w"], turn(r) * r["m"]["x"], turn(r) * r["m"]["y"]))
    return F.when(F.abs(sums["w"]) > 0, point(sums["x"] / sums["w"], sums["y"] / sums["w"]))


def vertices(mpoly: Column) -> Column:
    return F.flatten(F.flatten(mpoly))


def vertex_mean(mpoly: Column) -> Column:
    """Mean of all vertices of all rings, closing ones included."""
    v = vertices(mpoly)
    total = F.aggregate(v, point(F.lit(0.0), F.lit(0.0)), lambda s, p: point(s["x"] + p["x"], s["y"] + p["y"]))
    return point(total["x"] / F.size(v), total["y"] / F.size(v))


def bbox(mpoly: Column) -> Column:
    """Of the outer rings of all parts."""
    outer = F.flatten(F.transform(mpoly, lambda poly: poly[0]))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def box_area(box: Column) -> Column:
    return (box["max_x"] - box["min_x"]) * (box["max_y"] - box["min_y"])


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast."""
    crossings = F.filter(_edges(ring), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
    return F.size(crossings) % 2 == 1


def contains(mpoly: Column, x: Column, y: Column) -> Column:
    """Any part's outer ring holds the point, so a point in a hole is a hit."""
    return F.exists(mpoly, lambda poly: in_ring(poly[0], x, y))


def valid_coordinate(lat: Column, lng: Column) -> Column:
    ok = lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(ok, F.lit(False))


def morton(lat: Column, lng: Column) -> Column:
    """A place's number along a Z-curve over the globe, 2**24 steps a side: places near one another mostly have near numbers. Null
    without a valid coordinate."""

    def spread(c: Column) -> Column:
        """The bits of a number under 2**24, each followed by an empty one."""
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    def steps(share: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit((1 << 24) - 1), F.floor(share * (1 << 24)))).cast("long")

    z = F.shiftleft(spread(steps((lat + 90) / 180)), 1).bitwiseOR(spread(steps((lng + 180) / 360)))
    return F.when(valid_coordinate(lat, lng), z)


def geojson(mpoly: Column) -> Column:
    """The GeoJSON text of a geometry: Polygon for one part, MultiPolygon for more, null for none."""
    xy = map_points(mpoly, lambda p: F.array(p["x"], p["y"]))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), xy[0].alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), xy.alias("coordinates")))
    return F.when(F.size(mpoly) == 1, one).when(F.size(mpoly) > 1, many)


def from_geojson(text: Column) -> Column:
    """A multipolygon from the text of a Polygon or MultiPolygon; null for other types."""
    kind = F.get_json_object(text, "$.type")
    body = F.get_json_object(text, "$.coordinates")
    one, many = F.from_json(body, "array<array<array<double>>>"), F.from_json(body, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return map_points(parts, lambda c: point(c[0], c[1]))


def feature(geometry: Column, properties: Column) -> Column:
    """A GeoJSON feature as text; nulls are written out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})
