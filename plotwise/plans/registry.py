"""The registered queries: every operator on the driver's tables, with the SQL that stands for it.

Region, nation, customer and order stand for district, taluk, hobli and village; coordinates are arithmetic on keys.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import builds, features, records, search, space, valid
from ..sources import collections, lake, tables
from ..sources.shared import folder, numbered_as_is

T = Callable[[str], DataFrame]
_queries: dict[str, tuple[Callable[[T], DataFrame], str]] = {}


def query(sql: str):
    def keep(f: Callable[[T], DataFrame]):
        _queries[f.__name__] = (f, sql)
        return f

    return keep


def s(c: str):
    return F.col(c).cast("string")


def in_order(df: DataFrame) -> DataFrame:
    """Adds ``place``, where each row stands in a sorted result, so that the order is compared too."""
    return numbered_as_is(df, "place")


def lat_of(k: str):
    return F.lit(11.5) + (F.col(k) * 7919 % 7000) / F.lit(1000.0)


def lng_of(k: str):
    return F.lit(74.0) + (F.col(k) * 104729 % 4500) / F.lit(1000.0)


LAT, LNG = "(11.5::DOUBLE + ({k} * 7919 % 7000) / 1000.0::DOUBLE)", "(74.0::DOUBLE + ({k} * 104729 % 4500) / 1000.0::DOUBLE)"
KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2))))"


def villages(t: T) -> DataFrame:
    """Customers as villages: codes as text, a name, a place."""
    return (
        t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("lgd_code"), s("n_regionkey").alias("dist"), s("c_nationkey").alias("taluk"), F.concat(s("c_nationkey"), F.lit("h")).alias("hobli"), s("c_custkey").alias("vlg"), F.col("c_name").alias("village_name"), lat_of("c_custkey").alias("centroid_lat"), lng_of("c_custkey").alias("centroid_lng"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("segment"))
    )


def names(t: T) -> DataFrame:
    """The three upper levels and the villages as a name list with positions."""
    v = villages(t)
    blank = F.lit("")
    dist = t("region").select(F.lit("dist").alias("level"), s("r_regionkey").alias("dist"), blank.alias("taluk"), blank.alias("hobli"), blank.alias("vlg"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("pos"))
    taluk = t("nation").select(F.lit("taluk").alias("level"), s("n_regionkey").alias("dist"), s("n_nationkey").alias("taluk"), blank.alias("hobli"), blank.alias("vlg"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos"))
    own = v.select(F.lit("vlg").alias("level"), "dist", "taluk", "hobli", "vlg", F.col("village_name").alias("name"), "pos")
    return dist.unionByName(taluk).unionByName(own)


def cell(x, y, w=1.0, h=1.0):
    """A closed rectangle as a multipolygon."""
    p = lambda dx, dy: geo.point(x + F.lit(float(dx)), y + F.lit(float(dy)))
    return F.array(F.array(F.array(p(0, 0), p(w, 0), p(w, h), p(0, h), p(0, 0))))


def cells(t: T) -> DataFrame:
    """Unit squares on a grid 40 wide, one per customer, grouped by nation."""
    k = F.col("c_custkey")
    return t("customer").select(k.alias("parcel_id"), k.alias("pos"), F.col("c_nationkey").alias("vlg"), F.col("c_name").alias("village_name"), s("c_custkey").alias("survey_no"), cell((k % 40).cast("double"), F.floor(k / 40).cast("double")).alias("mpoly"))


CELLS = "c AS (SELECT c_nationkey AS vlg, c_custkey % 40 AS x, c_custkey // 40 AS y, c_name FROM customer)"


@query("SELECT s_suppkey AS code, s_name AS name, s_acctbal AS balance FROM supplier")
def scan_project(t: T) -> DataFrame:
    return t("supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query("SELECT DISTINCT n_regionkey::VARCHAR AS dist, c_nationkey::VARCHAR AS taluk, (c_custkey % 7)::VARCHAR AS hobli, (c_custkey % 50)::VARCHAR AS vlg FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_extract(t: T) -> DataFrame:
    df = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.format_string("lake/dist_%d/taluk_%d/hobli_%d/vlg_%d.parquet", "n_regionkey", "c_nationkey", F.col("c_custkey") % 7, F.col("c_custkey") % 50)
    return lake.with_hierarchy(df.select(path.alias("path"))).drop("path").distinct()


@query("SELECT c_custkey AS lgd_code, c_name AS village_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)")
def hierarchy_filter(t: T) -> DataFrame:
    first = t("nation").where("n_regionkey = 2").agg(F.min("n_nationkey")).first()[0]
    return lake.scoped(villages(t), dist="2", taluk=str(first), hobli="", vlg=None).select("lgd_code", "village_name")


@query("SELECT *, row_number() OVER (ORDER BY name, code::BIGINT) AS place FROM (SELECT k::VARCHAR AS code, CASE WHEN k < 20 THEN (SELECT n_name FROM nation WHERE n_nationkey = k) ELSE k::VARCHAR END AS name FROM (SELECT DISTINCT c_nationkey AS k FROM customer))")
def list_level(t: T) -> DataFrame:
    listed = t("nation").where("n_nationkey < 20").select(s("n_nationkey").alias("taluk"), F.col("n_name").alias("name"))
    return in_order(search.list_level(villages(t).select("taluk"), listed, ["taluk"], "taluk"))


@query("""SELECT 'vlg' AS level, n_regionkey::VARCHAR AS dist, n_nationkey::VARCHAR AS taluk, '1' AS hobli, k::VARCHAR AS vlg, 'v' || min(c) AS name FROM
 (SELECT n_regionkey, n_nationkey, c_custkey % 9 AS k, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL
UNION ALL SELECT 'hobli', n_regionkey::VARCHAR, n_nationkey::VARCHAR, '1', '', 'h1' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'taluk', n_regionkey::VARCHAR, n_nationkey::VARCHAR, '', '', n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT DISTINCT 'dist', n_regionkey::VARCHAR, '', '', '', 'd' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def names_explode(t: T) -> DataFrame:
    df = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = df.select(F.col("c_custkey").alias("pos"), F.concat_ws(",", (F.col("c_custkey") % 9).cast("string"), F.lit("1"), s("n_nationkey"), s("n_regionkey")).alias("vlgcode"), F.concat_ws("|", F.concat(F.lit("v"), s("c_custkey")), F.lit("h1"), "n_name", F.concat(F.lit("d"), s("n_regionkey"))).alias("vlgname"))
    return tables.explode_names(raw)


def surveys(t: T) -> DataFrame:
    number = F.concat_ws("/", s("l_orderkey"), s("l_linenumber"), F.lit("*"))
    return t("lineitem").select(number.alias("survey_no"), F.concat(F.lit("v"), (F.col("l_suppkey") % 50).cast("string")).alias("village_name"), s("l_suppkey").alias("village_code"), F.lit("1").alias("dist"), (F.col("l_suppkey") % 3).cast("string").alias("taluk"), (F.col("l_suppkey") % 7).cast("string").alias("hobli"), (F.col("l_suppkey") % 50).cast("string").alias("vlg"))


SURVEYS = "s AS (SELECT l_orderkey || '/' || l_linenumber || '/*' AS survey_no, 'v' || (l_suppkey % 50) AS village_name, l_suppkey::VARCHAR AS village_code, '1' AS dist, (l_suppkey % 3)::VARCHAR AS taluk, (l_suppkey % 7)::VARCHAR AS hobli, (l_suppkey % 50)::VARCHAR AS vlg, l_orderkey FROM lineitem)"


@query(f"WITH {SURVEYS} SELECT survey_no, village_name, village_code, dist, taluk, hobli, vlg, l_orderkey::VARCHAR AS survey_no_norm, l_orderkey::VARCHAR AS survey_key FROM s")
def survey_index(t: T) -> DataFrame:
    return search.survey_index(surveys(t))


@query("SELECT c_custkey AS parcel_id, '0' || c_nationkey % 5 AS taluk, '0' || c_custkey % 3 AS hobli, (c_custkey % 50)::VARCHAR AS vlg FROM customer WHERE c_nationkey % 5 = 2")
def rewritten_lake(t: T) -> DataFrame:
    """Parcels in folders by district, taluk and hobli; codes keep their zeros, and a taluk is read by its folder."""
    k = F.col("c_custkey")
    own = t("customer").select(k.alias("parcel_id"), s("c_custkey").alias("survey_no"), F.lit("01").alias("dist"), F.concat(F.lit("0"), (F.col("c_nationkey") % 5).cast("string")).alias("taluk"), F.concat(F.lit("0"), (k % 3).cast("string")).alias("hobli"), (k % 50).cast("string").alias("vlg"))
    to = f"{folder(own.sparkSession)}/{uuid.uuid4().hex}"
    lake.rewrite(own, to)
    return lake.scoped(lake.read_rewritten(own.sparkSession, to), dist="01", taluk="02").select("parcel_id", "taluk", "hobli", "vlg")


#: A power of two, so that coordinates are scaled there and back without rounding.
LAKE_SCALE = 8192.0


def village_lake(t: T) -> str:
    """A folder of six village files from the customers, a square each as well-known binary in degrees; two files lack a column. Squares are
    stored at 1/``LAKE_SCALE`` of their grid, so that every customer's is within the degrees of the globe."""
    spark, k = t("customer").sparkSession, F.col("c_custkey")

    @F.arrow_udf("binary")
    def square(x: pa.Array, y: pa.Array) -> pa.Array:
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return pa.array([struct.pack("<BIII10d", 1, 3, 1, 5, *[c for dx, dy in corners for c in ((a + dx) / LAKE_SCALE, (b + dy) / LAKE_SCALE)]) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.binary())

    own = t("customer").select((k % 6).alias("file"), s("c_custkey").alias("survey_no"), F.col("c_name").alias("village_name"), s("c_custkey").alias("village_code"), square((k % 40).cast("double"), F.floor(k / 40).cast("double") / 100).alias("geometry"))
    root = f"{folder(spark)}/{uuid.uuid4().hex}"
    for i in range(6):
        one = own.where(F.col("file") == i).drop("file", *(["village_name"] if i in (1, 4) else []))
        one.coalesce(1).write.parquet(f"{root}/made-{i}")
        store = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        to = f"{root}/lake/dist_1/taluk_{i % 2}/hobli_3"
        store.mkdirs(path(to))
        part = next(x.getPath() for x in store.listStatus(path(f"{root}/made-{i}")) if x.getPath().getName().startswith("part-"))
        store.rename(part, path(f"{to}/vlg_{i}.parquet"))
    return f"{root}/lake"


@query("SELECT c_custkey::VARCHAR AS survey_no, (c_custkey % 6)::VARCHAR AS vlg, (c_custkey % 2)::VARCHAR AS taluk, 'Polygon' AS kind, (c_custkey % 40 + 0.4)::DOUBLE AS x, round((c_custkey // 40)::DOUBLE / 100 + 0.4, 6) AS y FROM customer WHERE c_custkey % 6 NOT IN (1, 4)")
def lake_polygons(t: T) -> DataFrame:
    """Village files are scanned, those without a needed column left out by their footers, geometries decoded; codes come from the paths."""
    spark = t("customer").sparkSession
    got = lake.polygons(lake.scan(spark, village_lake(t), needed=lake.NEEDED), srid=None)
    mean = got.select("survey_no", "vlg", "taluk", "kind", geo.vertex_mean(F.col("mpoly")).alias("m"))
    return mean.select("survey_no", "vlg", "taluk", "kind", F.round(F.col("m.x") * LAKE_SCALE, 6).alias("x"), F.round(F.col("m.y") * LAKE_SCALE, 6).alias("y"))


#: Bytes of a village file's row groups, so that many tasks read a large file.
ROW_GROUP = 8 << 20


@query(f"WITH {SURVEYS} SELECT survey_no, village_name, village_code, dist, taluk, hobli, vlg, l_orderkey::VARCHAR AS survey_no_norm, l_orderkey::VARCHAR AS survey_key FROM s")
def survey_index_resumed(t: T) -> DataFrame:
    """Line items as files of parcels: a build that stops after two batches of three files, and a second one that takes in the rest."""
    spark = t("lineitem").sparkSession
    root = f"{folder(spark)}/{uuid.uuid4().hex}"
    surveys(t).repartition(9, "vlg").write.option("parquet.block.size", ROW_GROUP).parquet(f"{root}/lake")
    read = lambda paths: search.survey_index(spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("file")), ("file",))
    listed = lake.files(spark, f"{root}/lake", "*.parquet")
    builds.build_in_batches(listed, f"{root}/index", read, per_batch=3, batches=2)
    builds.build_in_batches(listed, f"{root}/index", read, per_batch=3)
    return builds.read_index(spark, f"{root}/index").drop("file")


@query(f"WITH {SURVEYS} SELECT survey_no, village_name, dist, taluk, hobli, vlg, row_number() OVER (ORDER BY l_orderkey, village_name, survey_no, dist, taluk, hobli, vlg) AS place FROM (SELECT DISTINCT ON (survey_no, village_name, dist, taluk, hobli, vlg) * FROM s WHERE left(survey_no, 2) = '30') ORDER BY l_orderkey, village_name, survey_no, dist, taluk, hobli, vlg LIMIT 25")
def survey_prefix_search(t: T) -> DataFrame:
    return in_order(search.survey_search(search.survey_index(surveys(t)), " 30/7"))


@query("""WITH s AS (SELECT DISTINCT p_partkey || '/' || p_size AS survey_no, 'v' || (p_size % 9) AS village_name, '1' AS dist, (p_size % 3)::VARCHAR AS taluk, (p_size % 7)::VARCHAR AS hobli, (p_size % 50)::VARCHAR AS vlg, p_partkey AS number FROM part),
e AS (SELECT *, unnest(range(2, length(number::VARCHAR) + 1)) AS n FROM s)
SELECT left(number::VARCHAR, n) AS prefix, row_number() OVER (PARTITION BY left(number::VARCHAR, n) ORDER BY number, village_name, survey_no, dist, taluk, hobli, vlg)::INT AS rank, survey_no, village_name, dist, taluk, hobli, vlg FROM e QUALIFY rank <= 25""")
def survey_prefixes(t: T) -> DataFrame:
    """The first 25 answers to every prefix of the parts' keys."""
    size = lambda n: (F.col("p_size") % n).cast("string")
    own = t("part").select(F.concat_ws("/", s("p_partkey"), s("p_size")).alias("survey_no"), F.concat(F.lit("v"), size(9)).alias("village_name"), s("p_size").alias("village_code"), F.lit("1").alias("dist"), size(3).alias("taluk"), size(7).alias("hobli"), size(50).alias("vlg"))
    return search.prefix_dictionary(search.survey_index(own))


@query("SELECT survey_no, row_number() OVER (ORDER BY survey_no) AS place FROM (SELECT DISTINCT l_orderkey::VARCHAR AS survey_no FROM lineitem WHERE l_suppkey = 7 AND l_orderkey::VARCHAR LIKE '1%')")
def inset_prefix_search(t: T) -> DataFrame:
    return in_order(search.inset_search(surveys(t).where("village_code = '7'"), "1"))


@query("SELECT c_name AS village_name, r_name AS dist_name, n_name AS taluk_name, r_regionkey::VARCHAR AS dist, n_nationkey::VARCHAR AS taluk, n_nationkey || 'h' AS hobli, c_custkey::VARCHAR AS vlg, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0) AND substr(lower(c_name), 1, 16) = 'customer#0000001' ORDER BY c_name, c_custkey LIMIT 20")
def village_prefix_search(t: T) -> DataFrame:
    have = villages(t).join(t("orders").where("o_custkey % 2 = 0"), F.col("lgd_code") == F.col("o_custkey"), "left_semi")
    return in_order(search.village_search(names(t), have, " CUSTOMER#0000001"))


@query("SELECT p_partkey AS parcel_id, p_brand AS survey_no FROM part WHERE p_brand = 'Brand#11' AND p_size BETWEEN 1 AND 30")
def parcel_filter(t: T) -> DataFrame:
    kind = F.when(F.col("p_size") <= 15, "Polygon").when(F.col("p_size") <= 30, "MultiPolygon").otherwise("Point")
    parcels = t("part").select(F.col("p_partkey").alias("parcel_id"), F.col("p_brand").alias("survey_no"), kind.alias("kind"))
    return search.same_base(search.parcels_of(parcels, "Brand#11"), "Brand#11").select("parcel_id", "survey_no")


@query(f"WITH {CELLS} SELECT a.vlg, count(*)::DOUBLE AS area, (4 * count(*) - 2 * ((SELECT count(*) FROM c p JOIN c q ON p.vlg = q.vlg AND p.y = q.y AND q.x = p.x + 1 WHERE p.vlg = a.vlg) + (SELECT count(*) FROM c p JOIN c q ON p.vlg = q.vlg AND p.x = q.x AND q.y = p.y + 1 WHERE p.vlg = a.vlg)))::BIGINT AS perimeter, true AS exact FROM c a GROUP BY a.vlg")
def boundary_village(t: T) -> DataFrame:
    own = cells(t)
    around = space.outer_segments(own, ["vlg"]).groupBy("vlg").agg(F.count("*").alias("perimeter"))
    return space.dissolve(own, ["vlg"]).select("vlg", F.round(geo.area(F.col("mpoly")), 6).alias("area"), "exact").join(around, "vlg")


#: Regions are listed as villages too: these have no parcels.
HOBLI = f"WITH {CELLS}, v AS (SELECT n_nationkey AS vlg, n_name AS village_name, k FROM nation LEFT JOIN (SELECT vlg AS own, count(*) AS k FROM c GROUP BY vlg) ON own = n_nationkey UNION ALL SELECT 100 + r_regionkey, r_name, NULL FROM region)"


def hobli(t: T) -> DataFrame:
    listed = t("nation").select(F.col("n_nationkey").alias("vlg"), F.col("n_name").alias("name"))
    listed = listed.unionByName(t("region").select((F.col("r_regionkey") + 100).alias("vlg"), F.col("r_name").alias("name")))
    return space.boundaries(cells(t), listed, ["vlg"])


@query(f"{HOBLI} SELECT vlg, village_name, k IS NOT NULL AS has_data, k::DOUBLE AS area, row_number() OVER (ORDER BY k IS NULL, vlg) AS place FROM v")
def boundary_hobli(t: T) -> DataFrame:
    return in_order(hobli(t).select("vlg", "village_name", "has_data", F.round(geo.area(F.col("mpoly")), 6).alias("area")))


@query(f"{HOBLI} SELECT vlg, village_name, vlg::VARCHAR AS code, (k IS NOT NULL)::VARCHAR AS has_data, k IS NOT NULL AS drawn, k::DOUBLE AS area FROM v")
def boundary_features(t: T) -> DataFrame:
    got = features.boundary_features(hobli(t))
    part = lambda k: F.get_json_object("feature", f"$.properties.{k}")
    return got.select("vlg", part("village_name").alias("village_name"), part("village_code").alias("code"), part("has_data").alias("has_data"), F.coalesce(F.get_json_object("feature", "$.geometry.type").isin("Polygon", "MultiPolygon"), F.lit(False)).alias("drawn"), F.round(geo.area(geo.from_geojson(F.get_json_object("feature", "$.geometry"))), 6).alias("area"))


@query("SELECT c_nationkey AS vlg, count(DISTINCT (c_custkey % 40 + i) * 1000000 + c_custkey // 40 + j)::DOUBLE AS area FROM customer, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) GROUP BY 1")
def boundary_overlap(t: T) -> DataFrame:
    """Squares two units wide overlap their neighbours."""
    k = F.col("c_custkey")
    own = t("customer").select(F.col("c_nationkey").alias("vlg"), cell((k % 40).cast("double"), F.floor(k / 40).cast("double"), 2.0, 2.0).alias("mpoly"))
    return space.dissolve(own, ["vlg"]).select("vlg", F.round(geo.area(F.col("mpoly")), 6).alias("area"))


@query("""SELECT c_custkey AS parcel_id, CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 1 END::INT AS parts, CASE c_custkey % 6 WHEN 5 THEN 1 ELSE 0 END::INT AS holes,
CASE c_custkey % 6 WHEN 0 THEN w * w / 2 WHEN 3 THEN w * w + 1 WHEN 5 THEN w * w - 1 ELSE w * w END AS area, c_custkey % 6 <> 4 AND c_custkey % 6 <> 5 AS repaired FROM (SELECT c_custkey, (c_custkey % 9 + 4)::DOUBLE AS w FROM customer)""")
def parcels_made_valid(t: T) -> DataFrame:
    """Bow ties, repeated points, spikes, holes outside their shell; plain squares and squares with a hole stay."""
    k = F.col("c_custkey")
    x, y, w = (k % 40 * 50).cast("double"), (F.floor(k / 40) * 50).cast("double"), (k % 9 + 4).cast("double")
    p = lambda dx, dy: geo.point(x + dx, y + dy)
    o = F.lit(0.0)
    square = F.array(p(o, o), p(w, o), p(w, w), p(o, w), p(o, o))
    small_ = lambda d: F.array(*[geo.point(x + d + i, y + 1.0 + j) for i, j in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0))])
    rings = [F.array(F.array(p(o, o), p(w, w), p(w, o), p(o, w), p(o, o))), F.array(F.array(p(o, o), p(w, o), p(w, o), p(w, w), p(o, w), p(o, o))), F.array(F.array(p(o, o), p(w, o), p(w + 9.0, o), p(w, o), p(w, w), p(o, w), p(o, o))), F.array(square, small_(w + 3.0)), F.array(square), F.array(square, small_(F.lit(1.0)))]
    mpoly = F.coalesce(*[F.when(k % 6 == i, F.array(r)) for i, r in enumerate(rings)])
    made = valid.make_valid(t("customer").select(k.alias("parcel_id"), mpoly.alias("mpoly")), ["parcel_id"])
    return made.select("parcel_id", F.size("mpoly").alias("parts"), F.aggregate("mpoly", F.lit(0), lambda n, q: n + F.size(q) - 1).alias("holes"), F.round(geo.area(F.col("mpoly")), 6).alias("area"), "repaired")


SQUARE = """'{"type":"Polygon","coordinates":[[[' || x || ',' || y || '],[' || (x + 1) || ',' || y || '],[' || (x + 1) || ',' || (y + 1) || '],[' || x || ',' || (y + 1) || '],[' || x || ',' || y || ']]]}'"""


@query(f"""SELECT vlg, '{{"type":"FeatureCollection","features":[' || string_agg('{{"type":"Feature","geometry":' || {SQUARE} || ',"properties":{{"parcel_id":' || k || ',"vlg":' || vlg || ',"village_name":"' || c_name || '","survey_no":"' || k || '"}}}}', ',' ORDER BY k) || ']}}' AS collection
FROM (SELECT c_custkey AS k, c_nationkey AS vlg, c_name, (c_custkey % 40)::DOUBLE AS x, (c_custkey // 40)::DOUBLE AS y FROM customer) GROUP BY vlg""")
def parcel_collections(t: T) -> DataFrame:
    return features.parcel_collection(cells(t).withColumn("kind", F.lit("Polygon")), ["vlg"], ["pos"])


@query(f"""SELECT row_number() OVER (ORDER BY c_custkey) AS place, '{{"type":"Feature","geometry":' || {SQUARE} || ',"properties":{{"parcel_id":' || c_custkey || ',"village_name":"' || c_name || '"}}}}' AS feature
FROM (SELECT c_custkey, c_name, (c_custkey % 40)::DOUBLE AS x, (c_custkey // 40)::DOUBLE AS y FROM customer)""")
def collection_file(t: T) -> DataFrame:
    """All parcels as one file that many tasks write, read again."""
    own = cells(t)
    to = f"{folder(own.sparkSession)}/{uuid.uuid4().hex}.geojson"
    text_ = features.feature_text(geo.geojson(F.col("mpoly")), F.struct("parcel_id", "village_name"))
    collections.write_collection(own.select("pos", text_.alias("feature")), ["pos"], to)
    return collections.read_collection(own.sparkSession, to)


@query(f"SELECT (c_custkey % 400) AS lgd_code, arg_max(c_name, c_custkey) AS village_name, round(max(c_custkey) % 40 + 0.5, 6)::DOUBLE AS centroid_lng, round(max(c_custkey) // 40 + 0.5, 6)::DOUBLE AS centroid_lat FROM customer WHERE c_nationkey = 3 GROUP BY 1")
def lgd_load(t: T) -> DataFrame:
    # Stored at 1/8192 of the SQL's grid, an exact scaling, so that every customer's place is a valid coordinate.
    k, unit = F.col("c_custkey"), 1 / 8192
    raw = t("customer").select((k % 400).alias("vil_lgd"), F.col("c_name").alias("vilname11"), F.col("c_nationkey").alias("state_lgd"), cell((k % 40) * F.lit(unit), F.floor(k / 40) * F.lit(unit), unit, unit).alias("mpoly"), k.alias("pos"))
    out = tables.load_villages(raw, state=3)
    return out.select("lgd_code", "village_name", F.round(F.col("centroid_lng") / unit, 6).alias("centroid_lng"), F.round(F.col("centroid_lat") / unit, 6).alias("centroid_lat"))


@query("SELECT lgd_code, village_name, rows, villages, errors FROM (SELECT (c_custkey % 400) AS lgd_code, arg_max(c_name, c_custkey) AS village_name FROM customer WHERE c_nationkey = 3 AND c_custkey % 11 <> 0 GROUP BY 1), (SELECT count(*) AS rows, count(DISTINCT c_custkey % 400) FILTER (c_custkey % 11 <> 0) AS villages, count(*) FILTER (c_custkey % 11 = 0) AS errors FROM customer WHERE c_nationkey = 3)")
def village_table(t: T) -> DataFrame:
    """The table of villages is built, clustered by place, and read again beside its counters; every eleventh row has no place."""
    k, unit = F.col("c_custkey"), 1 / 8192
    square = cell((k % 40) * F.lit(unit), F.floor(k / 40) * F.lit(unit), unit, unit)
    raw = t("customer").select((k % 400).alias("vil_lgd"), F.col("c_name").alias("vilname11"), F.col("c_nationkey").alias("state_lgd"), F.when(k % 11 != 0, square).alias("mpoly"), k.alias("pos"))
    to = f"{folder(raw.sparkSession)}/{uuid.uuid4().hex}"
    counted = builds.build_villages(raw, to, state=3).first()
    return raw.sparkSession.read.parquet(to).select("lgd_code", "village_name", *[F.lit(counted[c]).alias(c) for c in ("rows", "villages", "errors")])


@query("SELECT c_custkey AS lgd_code, max(o_orderkey)::VARCHAR AS vlg, max(o_orderkey) IS NOT NULL AS mapped FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1")
def roster_join(t: T) -> DataFrame:
    roster = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("lgd_code"), F.lit("1").alias("dist"), F.lit("1").alias("taluk"), F.lit("1").alias("hobli"), s("o_orderkey").alias("vlg"), F.col("o_orderkey").alias("pos"))
    out = space.enrich(t("customer").select(F.col("c_custkey").alias("lgd_code"), F.col("c_name").alias("village_name")), roster, names(t), villages(t))
    return out.select("lgd_code", "vlg", F.col("match_method").isNotNull().alias("mapped"))


@query("SELECT p.p_partkey AS lgd_code, m.k::VARCHAR AS vlg FROM part p JOIN (SELECT lower(replace(p_name, ' ', '')) AS n, min(p_partkey) AS k FROM part GROUP BY 1) m ON lower(replace(p.p_name, ' ', '')) = m.n")
def name_match_join(t: T) -> DataFrame:
    own = t("part").select(F.col("p_partkey").alias("lgd_code"), F.upper("p_name").alias("village_name"))
    listed = t("part").select(F.lit("vlg").alias("level"), F.lit("1").alias("dist"), F.lit("1").alias("taluk"), F.lit("1").alias("hobli"), s("p_partkey").alias("vlg"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_partkey").alias("pos"))
    roster = listed.where(F.lit(False)).select(F.col("pos").alias("lgd_code"), "dist", "taluk", "hobli", "vlg", "pos")
    return space.enrich(own, roster, listed, listed).select("lgd_code", "vlg")


NEAR = f"near AS (SELECT c_custkey AS lgd_code, c_name AS village_name, c_nationkey AS taluk, {KM.format(a='12.9716', b=LAT.format(k='c_custkey'), c='77.5946', d=LNG.format(k='c_custkey'))} AS km, c_custkey % 3 = 0 AS has_data FROM customer)"


def flagged(t: T) -> DataFrame:
    v = villages(t)
    roster = v.select("lgd_code", "dist", "taluk", "hobli", "vlg", "pos")
    return space.enrich(v.select("lgd_code", "village_name", "centroid_lat", "centroid_lng"), roster, names(t), v.where("lgd_code % 3 = 0"))


@query(f"WITH {NEAR} SELECT lgd_code, village_name, taluk::VARCHAR AS taluk, round(km, 4) AS km, has_data, row_number() OVER (ORDER BY near.km, lgd_code) AS place FROM near WHERE near.km <= 50")
def nearby(t: T) -> DataFrame:
    return in_order(space.nearby(flagged(t), 12.9716, 77.5946, 50.0).select("lgd_code", "village_name", "taluk", F.round("km", 4).alias("km"), "has_data"))


@query(f"""WITH {NEAR}, f AS (SELECT *, lgd_code AS k, lgd_code % 7 = 0 AS lost, (lgd_code % 40)::DOUBLE AS x, (lgd_code // 40)::DOUBLE AS y FROM near WHERE km <= 50)
SELECT lgd_code, '{{"type":"Feature","geometry":' || CASE WHEN k % 2 = 0 THEN {SQUARE} ELSE 'null' END || ',"properties":{{"lgd_code":' || k || ',"village_name":"' || CASE WHEN k % 5 = 0 AND lost THEN '' ELSE village_name END || '","has_data":' || (has_data AND NOT lost) || ',"dist":' ||
 CASE WHEN lost THEN 'null,"taluk":null,"hobli":null,"vlg":null' ELSE '"' || n_regionkey || '","taluk":"' || taluk || '","hobli":"' || taluk || 'h","vlg":"' || k || '"' END || '}}}}' AS feature, row_number() OVER (ORDER BY km, lgd_code) AS place FROM f JOIN nation ON n_nationkey = taluk""")
def nearby_features(t: T) -> DataFrame:
    """Every fifth village has no name of its own, every seventh is not on the roster, every second has a stored geometry."""
    v, k = villages(t), F.col("lgd_code")
    stored = F.when(k % 2 == 0, geo.geojson(cell((k % 40).cast("double"), F.floor(k / 40).cast("double"))))
    own = v.select("lgd_code", F.when(k % 5 == 0, " ").otherwise(F.col("village_name")).alias("village_name"), "centroid_lat", "centroid_lng", stored.alias("geom_geojson"))
    roster = v.where("lgd_code % 7 <> 0").select("lgd_code", "dist", "taluk", "hobli", "vlg", "pos")
    near = space.nearby(space.enrich(own, roster, names(t), v.where("lgd_code % 3 = 0")), 12.9716, 77.5946, 50.0)
    return in_order(features.place_features(near).select("lgd_code", "feature"))


@query("SELECT count(*) AS rows, (count(*) FILTER (c_custkey % 7 <> 0))::BIGINT AS mapped, (count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 = 0))::BIGINT AS with_data FROM customer")
def load_counts(t: T) -> DataFrame:
    v = villages(t)
    roster = v.where("lgd_code % 7 <> 0").select("lgd_code", "dist", "taluk", "hobli", "vlg", "pos")
    return builds.load_counts(space.enrich(v.select("lgd_code", "village_name"), roster, names(t), v.where("lgd_code % 3 = 0")))


GROUPS = "CASE WHEN l_linenumber >= 6 THEN 'n' || l_linenumber ELSE 's' || l_suppkey END"


@query(f"SELECT {GROUPS} AS part, count(*) AS n, count(*) <= 500 AS tooltips, count(*) <= 1500 AS labels, count(*) || ' parcel(s) loaded' || CASE WHEN count(*) > 500 THEN ' (hover tooltips hidden above 500)' ELSE '' END AS status FROM lineitem GROUP BY 1")
def feature_counts(t: T) -> DataFrame:
    part = F.when(F.col("l_linenumber") >= 6, F.concat(F.lit("n"), s("l_linenumber"))).otherwise(F.concat(F.lit("s"), s("l_suppkey")))
    return features.counted(t("lineitem").select(part.alias("part")), ["part"])


@query("SELECT l_orderkey || '/' || min(l_linenumber) || '/*' AS survey_no FROM lineitem WHERE l_orderkey = 7 GROUP BY l_orderkey")
def first_of_base(t: T) -> DataFrame:
    return search.first_of_base(surveys(t).withColumn("pos", F.split_part("survey_no", F.lit("/"), F.lit(2)).cast("int")), "7/9", ["pos"]).select("survey_no")


@query(f"WITH {SURVEYS} SELECT DISTINCT survey_no, dist, taluk, hobli, vlg FROM s WHERE left(survey_no, 2) = '30' AND l_orderkey % 2 = 0 AND taluk = '1'")
def loaded_results(t: T) -> DataFrame:
    odd = F.split_part("survey_no", F.lit("/"), F.lit(1)).cast("long") % 2 == 0
    found, loaded = surveys(t).where(F.col("survey_no").startswith("30")), surveys(t).where(odd).select("survey_no")
    return search.in_loaded(found, loaded, dist="1", taluk="1", hobli="").select("survey_no", *search.HIERARCHY)


@query("SELECT path, row_number() OVER (ORDER BY path, k) AS place FROM (SELECT c_custkey AS k, 'dist_1/taluk_' || c_nationkey || '/hobli_1/vlg_' || c_custkey % 50 || '.parquet' AS path FROM customer)")
def path_order(t: T) -> DataFrame:
    path = F.format_string("dist_1/taluk_%d/hobli_1/vlg_%d.parquet", "c_nationkey", F.col("c_custkey") % 50)
    return in_order(lake.in_path_order(t("customer").select(path.alias("path"), F.col("c_custkey").alias("pos")))).select("path", "place")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%-d %b %Y') AS day, strftime(o_orderdate, '%Y-%m-01 00:00:00') AS month_start, printf('%.2f', o_totalprice / 7) AS price FROM orders")
def texts(t: T) -> DataFrame:
    month = F.date_format(text.month_start(F.col("o_orderdate")), "yyyy-MM-dd HH:mm:ss")
    return t("orders").select(F.col("o_orderkey").alias("id"), text.day_text(F.col("o_orderdate")).alias("day"), month.alias("month_start"), text.fixed(F.col("o_totalprice") / 7, 2).alias("price"))


@query(f"WITH p AS (SELECT s_suppkey AS id, {LAT.format(k='s_suppkey * 13')} AS la, {LNG.format(k='s_suppkey * 13')} AS ln FROM supplier), q AS (SELECT c_custkey AS lgd_code, {LAT.format(k='c_custkey')} AS lb, {LNG.format(k='c_custkey')} AS lm FROM customer) SELECT id AS point_id, lgd_code, round({KM.format(a='la', b='lb', c='ln', d='lm')}, 4) AS km FROM p, q WHERE {KM.format(a='la', b='lb', c='ln', d='lm')} <= 20")
def nearby_batch(t: T) -> DataFrame:
    points = t("supplier").withColumn("k", F.col("s_suppkey") * 13).select(F.col("s_suppkey").alias("point_id"), lat_of("k").alias("lat"), lng_of("k").alias("lng"))
    return space.nearby_batch(points, villages(t).select("lgd_code", "centroid_lat", "centroid_lng"), 20.0).select("point_id", "lgd_code", F.round("km", 4).alias("km"))


GLOBE = "(({k} * {a} % 18001) / 100.0::DOUBLE - 90)", "(({k} * {b} % 36001) / 100.0::DOUBLE - 180)"


@query(f"WITH p AS (SELECT s_suppkey AS id, {GLOBE[0].format(k='s_suppkey', a=7919)} AS la, {GLOBE[1].format(k='s_suppkey', b=104729)} AS ln FROM supplier), q AS (SELECT c_custkey AS lgd_code, {GLOBE[0].format(k='c_custkey', a=6271)} AS lb, {GLOBE[1].format(k='c_custkey', b=15485)} AS lm FROM customer) SELECT id AS point_id, lgd_code, round({KM.format(a='la', b='lb', c='ln', d='lm')}, 4) AS km FROM p, q WHERE {KM.format(a='la', b='lb', c='ln', d='lm')} <= 400")
def nearby_globe(t: T) -> DataFrame:
    """Places all over the globe, poles and 180 degrees included."""
    points, places = globe(t)
    return space.nearby_batch(points, places, 400.0).select("point_id", "lgd_code", F.round("km", 4).alias("km"))


def globe(t: T) -> tuple[DataFrame, DataFrame]:
    lat = lambda k, a: (F.col(k) * a % 18001) / F.lit(100.0) - 90
    lng = lambda k, b: (F.col(k) * b % 36001) / F.lit(100.0) - 180
    points = t("supplier").select(F.col("s_suppkey").alias("point_id"), lat("s_suppkey", 7919).alias("lat"), lng("s_suppkey", 104729).alias("lng"))
    places = t("customer").select(F.col("c_custkey").alias("lgd_code"), lat("c_custkey", 6271).alias("centroid_lat"), lng("c_custkey", 15485).alias("centroid_lng"))
    return points, places


@query(f"WITH p AS (SELECT s_suppkey AS id, {GLOBE[0].format(k='s_suppkey', a=7919)} AS la, {GLOBE[1].format(k='s_suppkey', b=104729)} AS ln FROM supplier), q AS (SELECT c_custkey AS lgd_code, {GLOBE[0].format(k='c_custkey', a=6271)} AS lb, {GLOBE[1].format(k='c_custkey', b=15485)} AS lm FROM customer) SELECT id AS point_id, row_number() OVER (PARTITION BY id ORDER BY d, lgd_code)::INT AS rank, lgd_code, round(d, 4) AS km FROM (SELECT id, lgd_code, {KM.format(a='la', b='lb', c='ln', d='lm')} AS d FROM p, q) QUALIFY rank <= 5")
def nearest_places(t: T) -> DataFrame:
    """The five nearest of places all over the globe, poles and 180 degrees included."""
    points, places = globe(t)
    return space.nearest(points, places, 5).select("point_id", "rank", "lgd_code", F.round("km", 4).alias("km"))


@query(f"SELECT c_custkey AS lgd_code, list_sum([(((y >> i) & 1) << (2 * i + 1)) + (((x >> i) & 1) << (2 * i)) FOR i IN range(24)])::BIGINT AS z FROM (SELECT c_custkey, floor(({LAT.format(k='c_custkey')} + 90) / 180 * 16777216)::BIGINT AS y, floor(({LNG.format(k='c_custkey')} + 180) / 360 * 16777216)::BIGINT AS x FROM customer)")
def curve_order(t: T) -> DataFrame:
    """Where places stand along the Z-curve that their table is clustered by."""
    return t("customer").select(F.col("c_custkey").alias("lgd_code"), geo.morton(lat_of("c_custkey"), lng_of("c_custkey")).alias("z"))


@query(f"WITH {NEAR} SELECT lgd_code FROM near WHERE km <= 50 AND lgd_code <> (SELECT arg_min(lgd_code, km) FROM near)")
def nearby_exclude(t: T) -> DataFrame:
    near = space.nearby(flagged(t), 12.9716, 77.5946, 50.0)
    one = near.first()
    codes = {k: one[k] for k in ("dist", "taluk", "hobli", "vlg")} if one else {"vlg": ""}
    return space.without_village(near, **codes).select("lgd_code")


@query(f"WITH {NEAR} SELECT lgd_code FROM near WHERE km <= 50 ORDER BY has_data DESC, km, lgd_code LIMIT 1")
def nearest_with_data(t: T) -> DataFrame:
    return space.nearest_with_data(space.nearby(flagged(t), 12.9716, 77.5946, 50.0)).select("lgd_code")


def quads(t: T) -> DataFrame:
    """Tilted quadrilaterals that overlap, one per part."""
    k = F.col("p_partkey")
    x, y, w = (k * 37 % 997).cast("double"), (k * 91 % 991).cast("double"), (k % 23 + 5).cast("double")
    ring = F.array(geo.point(x, y), geo.point(x + w, y + 2.0), geo.point(x + w + 1.0, y + w), geo.point(x - 1.0, y + w + 3.0), geo.point(x, y))
    return t("part").select(k.alias("parcel_id"), k.alias("pos"), F.array(F.array(ring)).alias("mpoly"))


QUADS = "q AS (SELECT p_partkey AS id, (p_partkey * 37 % 997)::DOUBLE AS x, (p_partkey * 91 % 991)::DOUBLE AS y, (p_partkey % 23 + 5)::DOUBLE AS w FROM part)"
CORNERS = "v AS (SELECT id, 1 AS n, x AS vx, y AS vy FROM q UNION ALL SELECT id, 2, x + w, y + 2 FROM q UNION ALL SELECT id, 3, x + w + 1, y + w FROM q UNION ALL SELECT id, 4, x - 1, y + w + 3 FROM q)"


@query(f"""WITH {QUADS}, {CORNERS}, e AS (SELECT a.id, a.vx AS ax, a.vy AS ay, b.vx AS bx, b.vy AS "by" FROM v a JOIN v b ON a.id = b.id AND b.n = a.n % 4 + 1),
p AS (SELECT s_suppkey AS pid, (s_suppkey * 53 % 997)::DOUBLE + 0.37 AS px, (s_suppkey * 29 % 991)::DOUBLE + 0.41 AS py FROM supplier),
h AS (SELECT pid, id FROM p, e WHERE ((e.ay > py) != (e."by" > py)) AND px < (e.bx - e.ax) * (py - e.ay) / (e."by" - e.ay) + e.ax GROUP BY pid, id HAVING count(*) % 2 = 1)
SELECT pid AS point_id, arg_min(h.id, struct_pack(a := (w + 2) * (w + 3), i := h.id)) AS parcel_id FROM h JOIN q ON h.id = q.id GROUP BY pid""")
def point_in_polygon(t: T) -> DataFrame:
    k = F.col("s_suppkey")
    points = t("supplier").select(k.alias("point_id"), ((k * 53 % 997).cast("double") + 0.37).alias("x"), ((k * 29 % 991).cast("double") + 0.41).alias("y"))
    return space.parcels_under(points, quads(t))


@query(f"WITH {QUADS}, {CORNERS} SELECT id AS parcel_id, min(vx) AS min_x, min(vy) AS min_y, max(vx) AS max_x, max(vy) AS max_y FROM v GROUP BY id")
def bbox(t: T) -> DataFrame:
    return quads(t).select("parcel_id", geo.bbox(F.col("mpoly")).alias("b")).select("parcel_id", "b.*")


@query(f"WITH {QUADS}, {CORNERS} SELECT id AS parcel_id, round((sum(vx) + sum(vx) FILTER (n = 1)) / 5, 6) AS x, round((sum(vy) + sum(vy) FILTER (n = 1)) / 5, 6) AS y FROM v GROUP BY id")
def vertex_mean(t: T) -> DataFrame:
    m = quads(t).select("parcel_id", geo.vertex_mean(F.col("mpoly")).alias("m"))
    return m.select("parcel_id", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


@query(f"""WITH {QUADS}, {CORNERS}, r AS (SELECT id, list(vx ORDER BY n) AS xs, list(vy ORDER BY n) AS ys FROM v GROUP BY id),
t AS (SELECT id, unnest([2, 3]) AS i, xs, ys FROM r),
g AS (SELECT id, (xs[1] + xs[i] + xs[i + 1]) / 3 AS cx, (ys[1] + ys[i] + ys[i + 1]) / 3 AS cy, ((xs[i] - xs[1]) * (ys[i + 1] - ys[1]) - (xs[i + 1] - xs[1]) * (ys[i] - ys[1])) / 2 AS a FROM t)
SELECT id AS parcel_id, round(sum(cx * a) / sum(a), 6) AS x, round(sum(cy * a) / sum(a), 6) AS y, round(sum(a), 6) AS area FROM g GROUP BY id""")
def centroid(t: T) -> DataFrame:
    m = quads(t).select("parcel_id", geo.centroid(F.col("mpoly")).alias("m"), geo.area(F.col("mpoly")).alias("area"))
    return m.select("parcel_id", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"), F.round("area", 6).alias("area"))


#: The forward series, so that the inverse is checked by going there and back: latitude and longitude come out as they went in.
FORWARD = """WITH g AS (SELECT c_custkey AS k, radians({lat}) AS la, radians({lng} - 75.0) AS lo FROM customer),
h AS (SELECT *, sinh(atanh(sin(la)) - 0.08181919084262149 * atanh(0.08181919084262149 * sin(la))) AS t FROM g) SELECT k AS parcel_id, round(degrees(la), 6) AS lat, round(degrees(lo) + 75.0, 6) AS lng FROM h"""


@query(FORWARD.format(lat=LAT.format(k="c_custkey"), lng=LNG.format(k="c_custkey")))
def utm_inverse(t: T) -> DataFrame:
    """Places are projected forward by the published series, stored with exchanged coordinates, and brought back by the operator."""
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    radius, ecc = geo.A_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64), (geo.FLATTENING * (2 - geo.FLATTENING)) ** 0.5
    la, lo = F.radians(lat_of("c_custkey")), F.radians(lng_of("c_custkey") - 75.0)
    tau = F.sinh(F.atanh(F.sin(la)) - F.lit(ecc) * F.atanh(F.lit(ecc) * F.sin(la)))
    xi, eta = F.atan2(tau, F.cos(lo)), F.atanh(F.sin(lo) / F.sqrt(1 + tau * tau))
    north, east = xi, eta
    for j, a in enumerate(alpha, 1):
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    stored = t("customer").select(F.col("c_custkey").alias("parcel_id"), geo.point(north * (geo.SCALE * radius), F.lit(geo.FALSE_EAST) + east * (geo.SCALE * radius)).alias("p"))
    back = stored.select("parcel_id", geo.swapped(F.col("p")).alias("p")).select("parcel_id", geo.utm43n_inverse(F.col("p.x"), F.col("p.y")).alias("g"))
    return back.select("parcel_id", F.round("g.y", 6).alias("lat"), F.round("g.x", 6).alias("lng"))


@query("SELECT c_custkey AS id, NOT (abs(c_acctbal / 100) > 90 OR abs(c_acctbal / 40) > 180) AS ok FROM customer")
def coord_validate(t: T) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), geo.valid_coordinate(F.col("c_acctbal") / 100, F.col("c_acctbal") / 40).alias("ok"))


@query("SELECT event_id, 0::INTEGER AS pos, (props->>'k')::BIGINT AS k FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def payload_parse(t: T) -> DataFrame:
    body = F.concat(F.lit('{"data":['), "props", F.lit("]}"))
    doubly = F.to_json(F.struct(body.alias("b")))
    inner = F.substring(doubly, 6, 1 << 20)
    inner = F.substr(inner, F.lit(1), F.length(inner) - 1)
    sent = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, "NoData").otherwise('"nodata"')).when(F.col("event_id") % 2 == 0, inner).otherwise(body)
    raw = t("events").select("event_id", sent.alias("body"), F.when(F.col("event_id") % 7 == 0, 502).otherwise(200).alias("status"))
    return tables.payload_records(raw, "k: bigint")


@query("""WITH r AS (SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE user_id::VARCHAR END AS ack, event_type, event_id, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS rank FROM events WHERE event_type IN ('click', 'view')),
k AS (SELECT ack, arg_min(event_id, rank * 1000000000 + event_id) AS event_id FROM r WHERE ack <> '' GROUP BY ack UNION ALL SELECT ack, event_id FROM r WHERE ack = '')
SELECT k.ack AS ack_no, k.event_id AS pos, r.event_type AS status, (r.event_id % 9) || '/' || CASE WHEN r.event_id % 2 = 0 THEN '-' ELSE 'x' END || '/-' AS survey_no FROM k JOIN r ON r.event_id = k.event_id""")
def rtc_owners(t: T) -> DataFrame:
    return records.owners(cases(t)).select("ack_no", "pos", "status", "survey_no")


def cases(t: T) -> DataFrame:
    ack = F.when(F.col("user_id") % 10 == 0, "").otherwise(s("user_id"))
    one = lambda kind, rank: t("events").where(F.col("event_type") == kind).select(ack.alias("Ack_No"), (F.col("event_id") % 9).cast("string").alias("Survey_no"), F.when(F.col("event_id") % 2 == 0, "").otherwise("x").alias("surnoc"), F.lit(None).cast("string").alias("hissano"), F.lit("o").alias("ownername"), F.col("event_type").alias("Case_Status"), F.lit(rank).alias("rank"), F.col("event_id").alias("pos"))
    return one("click", 0).unionByName(one("view", 1))


@query(f"SELECT * FROM ({_queries['rtc_owners'][1]}) WHERE split_part(survey_no, '/', 1) = '3'")
def rtc_owners_survey(t: T) -> DataFrame:
    """Only numbers whose preferred case has the base; 3 is another one than 13."""
    return records.owners(cases(t), "3/1").select("ack_no", "pos", "status", "survey_no")


@query("SELECT c_custkey::VARCHAR AS mr_number, c_mktsegment AS kind, c_name AS survey_numbers FROM customer WHERE contains(c_name, '13')")
def rtc_mutations(t: T) -> DataFrame:
    raw = t("customer").select(s("c_custkey").alias("MRNumber"), F.col("c_mktsegment").alias("TypeofTransaction"), F.col("c_name").alias("SurveyNumbers"), F.lit("s").alias("status"), F.lit("a").alias("applicant"))
    return records.mutations(raw, "13/2").select("mr_number", "kind", "survey_numbers")


@query("SELECT user_id, event_type, event_id, value FROM events WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id, event_type)")
def first_wins(t: T) -> DataFrame:
    return tables.first_wins(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, event_id, value FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id, event_type)")
def last_wins(t: T) -> DataFrame:
    return tables.last_wins(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def project_rows(t: T) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "needs-review").otherwise(F.col("o_orderstatus"))
    return t("orders").select(s("o_orderkey").alias("id"), s("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("location"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'needs-review' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS location, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey::VARCHAR) AS place FROM orders WHERE o_custkey = 7")
def projects_list(t: T) -> DataFrame:
    return in_order(records.projects(project_rows(t), "7").select("id", "status", "location"))


@query("SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'needs-review' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS location FROM orders WHERE o_custkey = 13 UNION ALL SELECT 'added', 'needs-review', ''")
def projects_stored(t: T) -> DataFrame:
    """Projects as a table that is looked up by user, one more appended."""
    rows = project_rows(t).withColumn("created_at", F.col("created_at").cast("timestamp"))
    to = f"{folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    tables.write_projects(rows, to)
    tables.add_project(rows.sparkSession, to, {"id": "added", "user_id": "13", "name": "n", "created_at": datetime(1999, 1, 1)})
    return records.projects(rows.sparkSession.read.parquet(to), "13").select("id", "status", "location")


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS user_id FROM orders WHERE o_orderkey = 7")
def project_by_id(t: T) -> DataFrame:
    owner = t("orders").where("o_orderkey = 7").first()
    return records.project(project_rows(t), str(owner.o_custkey) if owner else "", "7").select("id", "user_id")


@query("SELECT count(*) AS total, sum((o_orderstatus = 'F')::INT)::BIGINT AS complete, sum((o_orderstatus <> 'F')::INT)::BIGINT AS needs_review, sum((o_orderdate >= TIMESTAMP '1998-03-01')::INT)::BIGINT AS this_month FROM orders")
def project_stats(t: T) -> DataFrame:
    return records.project_stats(project_rows(t), F.expr("TIMESTAMP_NTZ '1998-03-01 00:00:00'"))


@query("SELECT p_partkey AS parcel_id, 'p_brand' AS key, 'Brand' AS label, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', 'p type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', 'p size', p_size::VARCHAR FROM part WHERE p_size % 2 = 0")
def property_unpivot(t: T) -> DataFrame:
    parcels = t("part").select(F.col("p_partkey").alias("parcel_id"), "p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, s("p_size")).when(F.col("p_size") % 3 == 0, "nan").otherwise(" ").alias("p_size"), F.col("p_name").alias("survey_no"))
    labels = t("region").where("r_regionkey = 0").select(F.lit("p_brand").alias("key"), F.lit("Brand").alias("label"))
    return search.property_sheet(parcels, ["parcel_id"], labels)


@query("""SELECT s_suppkey AS id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (s_suppkey % 90) || ',' || (s_suppkey % 45) || ']},"properties":{"name":"' || s_name || '","village":' || CASE WHEN s_suppkey % 2 = 0 THEN '"' || s_nationkey || '"' ELSE 'null' END || '}}' AS feature FROM supplier""")
def geojson_feature(t: T) -> DataFrame:
    where = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") % 90, F.col("s_suppkey") % 45).alias("coordinates"))
    what = F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, s("s_nationkey")).alias("village"))
    return t("supplier").select(F.col("s_suppkey").alias("id"), geo.feature(where, what).alias("feature"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_by_name(t: T) -> DataFrame:
    one = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return one.unionByName(t("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id")), allowMissingColumns=True)


@query("SELECT c_nationkey AS taluk, count(*) AS n, (count(*) FILTER (c_custkey % 3 = 0))::BIGINT AS with_data, CASE WHEN count(*) > 65 THEN 'many' WHEN count(*) > 55 THEN 'some' ELSE 'few' END AS label FROM customer GROUP BY 1")
def counts(t: T) -> DataFrame:
    out = t("customer").groupBy(F.col("c_nationkey").alias("taluk")).agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 3 == 0).alias("with_data"))
    return out.withColumn("label", F.when(F.col("n") > 65, "many").when(F.col("n") > 55, "some").otherwise("few"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")) for name, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _queries.items()}
