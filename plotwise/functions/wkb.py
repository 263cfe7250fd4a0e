"""Well-known binary to the nested arrays of ``geo``: the one Arrow function, since Spark cannot walk bytes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "kind string, srid int, parts array<array<array<struct<x: double, y: double>>>>"
PAIR, COUNT = struct.Struct("<II"), struct.Struct("<I")
#: The geometry codes of the format.
NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def _read(data: bytes, at: int, depth: int = 0) -> tuple[str, list, int]:
    """(kind, polygons, end). Collections are opened one level."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    extra = max(extra, {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0))
    kind, width = NAMES[code % 1000], 2 + extra

    def points(at: int) -> tuple[list, int]:
        (n,) = struct.unpack_from(order + "I", data, at)
        flat = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
        return [{"x": flat[i], "y": flat[i + 1]} for i in range(0, n * width, width)], at + 4 + 8 * n * width

    if kind == "Point":
        return kind, [], at + 8 * width
    if kind == "LineString":
        return kind, [], points(at)[1]
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == "Polygon":
        rings = []
        for _ in range(n):
            ring, at = points(at)
            if ring and ring[0] != ring[-1]:
                ring.append(dict(ring[0]))
            rings.append(ring)
        return kind, [rings] if rings and rings[0] else [], at
    parts: list = []
    for _ in range(n):
        sub, polygons, at = _read(data, at, depth + 1)
        if sub in ("Polygon", "MultiPolygon") and depth == 0:
            parts += polygons
    return kind, parts, at


def decode(data: bytes | None) -> dict | None:
    """kind, polygon parts and, if the bytes tell it, srid; null for null or unreadable bytes."""
    if not data:
        return None
    try:
        kind, parts, _ = _read(bytes(data), 0)
    except (struct.error, KeyError, IndexError):
        return None
    order = "<" if data[0] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, 1)
    srid = struct.unpack_from(order + "i", data, 5)[0] if code & 0x20000000 else None
    return {"kind": kind, "parts": parts} if srid is None else {"kind": kind, "parts": parts, "srid": srid}


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
TYPE = pa.struct([("kind", pa.string()), ("srid", pa.int32()), ("parts", pa.list_(pa.list_(pa.list_(POINT))))])


def skeleton(data: bytes) -> tuple[str, list[list[tuple[int, int]]]] | None:
    """(kind, parts: rings: place of the first coordinate and number of points) of a plane polygon or multipolygon of little-endian bytes
    whose rings are closed; None for all else. Coordinates are not looked at, but for the ends of rings."""
    if len(data) < 9 or data[0] != 1:
        return None
    code, n = PAIR.unpack_from(data, 1)
    at, parts = 9, []
    if code == 3:
        n, at = 1, 0
    elif code != 6:
        return None
    for _ in range(n):
        if data[at] != 1:
            return None
        kind, rings = PAIR.unpack_from(data, at + 1)
        if kind != 3:
            return None
        at += 9
        part = []
        for _ in range(rings):
            (points,) = COUNT.unpack_from(data, at)
            at += 4
            end = at + 16 * points
            if end > len(data) or points and data[at : at + 16] != data[end - 16 : end]:
                return None
            part.append((at, points))
            at = end
        if not part or not part[0][1]:
            return None
        parts.append(part)
    return ("Polygon" if code == 3 else "MultiPolygon"), parts


def decode_all(values: list[bytes | None]) -> pa.StructArray:
    """``decode`` of many values as one Arrow array. Of plain polygons only the headers are walked; all their coordinates are copied as bytes
    and read as one array. Other values (other byte order, more dimensions, identifiers, open rings, other kinds) are decoded one by one."""
    kinds, srids, known = [], [], []
    chunks, ring_sizes, part_sizes, value_sizes = [], [], [], []
    for v in values:
        try:
            found = skeleton(v) if v else None
        except struct.error:
            found = None
        if found:
            kind, parts = found
            kinds.append(kind)
            srids.append(None)
            known.append(True)
            value_sizes.append(len(parts))
            view = memoryview(v)
            for part in parts:
                part_sizes.append(len(part))
                for at, n in part:
                    ring_sizes.append(n)
                    chunks.append(view[at : at + 16 * n])
            continue
        one = decode(v)
        kinds.append(one and one["kind"])
        srids.append(one and one.get("srid"))
        known.append(one is not None)
        value_sizes.append(len(one["parts"]) if one else 0)
        for part in one["parts"] if one else ():
            part_sizes.append(len(part))
            for ring in part:
                ring_sizes.append(len(ring))
                chunks.append(np.array([(p["x"], p["y"]) for p in ring], "<f8").tobytes())
    xy = np.frombuffer(b"".join(chunks), "<f8").reshape(-1, 2)
    lists = lambda sizes, inner, **more: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), inner, **more)
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], fields=list(POINT))
    parts = lists(value_sizes, lists(part_sizes, lists(ring_sizes, points)), mask=pa.array([not k for k in known], pa.bool_()))
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(srids, pa.int32()), parts], fields=list(TYPE))


def decoded(wkb: Column) -> Column:
    @F.arrow_udf(SCHEMA)
    def run(values: pa.Array) -> pa.Array:
        return decode_all(values.cast(pa.binary()).to_pylist())

    return run(wkb)
