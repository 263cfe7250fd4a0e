"""GeoJSON features and collections, and what a client counts of them.

A collection is one text for each group of ``keys`` (a village, a request's hobli), so that no task holds more than a group; with no
keys it is one text for all rows, for requests whose result is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .search import HIERARCHY, parcels_of
from .valid import make_valid

#: Up to so many features a client shows hover texts, and permanent labels.
TOOLTIPS, LABELS = 500, 1500


def feature_text(geometry: Column, properties: Column) -> Column:
    """A feature from the GeoJSON text of its geometry (null: none) and a struct; nulls are written out."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit("}"))


def collect(features: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, collection): the texts of column ``feature`` in order. Without keys and rows it is the empty collection."""
    listed = F.sort_array(F.collect_list(F.struct(*order, "feature")))
    text = F.array_join(F.transform(listed, lambda x: x["feature"]), ",")
    return features.groupBy(*keys).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), text, F.lit("]}")).alias("collection"))


def parcel_collection(parcels: DataFrame, keys: list[str], order: list[str], survey: str | None = None, repair: list[str] | None = None) -> DataFrame:
    """Parcels of polygon kinds (columns kind, mpoly and attributes), of one survey number if given, as collections in ``order``.
    Properties are all other columns but those of the order. ``repair`` names a parcel; if given, invalid geometries are made valid."""
    shown = [c for c in parcels.columns if c not in ("kind", "mpoly", *[o for o in order if o not in HIERARCHY])]
    own = parcels_of(parcels, survey)
    if repair:
        own = make_valid(own, repair).drop("repaired")
    return collect(own.select(*dict.fromkeys([*keys, *order]), feature_text(geo.geojson(F.col("mpoly")), F.struct(*shown)).alias("feature")), keys, order)


def boundary_features(boundaries: DataFrame, code: str = "vlg") -> DataFrame:
    """Adds ``feature`` to rows of ``space.boundaries``: properties village_code, village_name, has_data; no geometry without data."""
    what = F.struct(F.col(code).alias("village_code"), "village_name", "has_data")
    return boundaries.withColumn("feature", feature_text(geo.geojson(F.col("mpoly")), what))


def place_features(near: DataFrame) -> DataFrame:
    """Adds ``feature`` to places from ``space.nearby``: lgd_code, village_name, has_data and the four codes, which are null where a place
    is not mapped; the geometry is the stored text (geom_geojson)."""
    mapped = F.col("vlg").isNotNull()
    what = F.struct("lgd_code", "village_name", "has_data", *[F.when(mapped, F.col(k)).alias(k) for k in HIERARCHY])
    return near.withColumn("feature", feature_text(F.col("geom_geojson"), what))


def counted(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, tooltips, labels, status) of the features of each group: what a client shows, and what it says after loading."""
    many = F.when(F.col("n") > TOOLTIPS, " (hover tooltips hidden above 500)").otherwise("")
    out = features.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.select(*keys, "n", (F.col("n") <= TOOLTIPS).alias("tooltips"), (F.col("n") <= LABELS).alias("labels"), F.concat(F.col("n").cast("string"), F.lit(" parcel(s) loaded"), many).alias("status"))
