"""Views that several queries share, in both dialects: DataFrames, and DuckDB text for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.uris import uri_key
from ..operators.proximity import site_points
from ..sources.tables import table


def entities(spark: SparkSession, d: str) -> DataFrame:
    """The current record of each site (greatest ``updated_at``, then ``record_id``), parsed and located."""
    own = ("updated_at", "record_id", "label", "description", "historical_info", "region_id", "coverage", "category_uri", "geometry_uri", "property_type")
    sites = table(spark, d, "sites")
    now = sites.where("identifier is not null").groupBy("identifier").agg(F.max(F.struct(*own)).alias("r")).select(F.col("identifier").alias("id"), "r.*")
    points = site_points(sites, table(spark, d, "geometries")).withColumnRenamed("key", "id")
    return now.join(points, "id", "left").select(
        "id", F.col("record_id").alias("load_order"), "label", "description", "historical_info", "region_id", "coverage", "category_uri", "geometry_uri", "lat", "lon",
        text.site_name(F.col("label")).alias("name"), text.period_in_label(F.col("label")).alias("period_label"), text.region_name(F.col("region_id")).alias("region"),
    )


def members(df: DataFrame, key: str, uris: str) -> DataFrame:
    """(key, member) of the distinct normalised members of a list."""
    return df.select(key, F.explode(uris).alias("u")).select(key, uri_key(F.col("u")).alias("member")).where("member is not null").distinct()


# --- the SQL side -----------------------------------------------------------------------------


def sql_key(uri: str) -> str:
    return f"nullif(lower(trim(regexp_extract(regexp_replace({uri}, '[\\s/]+$', ''), '[^/]*$'))), '')"


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


def sql_valid(lat: str, lon: str) -> str:
    return f"coalesce({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 AND NOT ({lat} = 0 AND {lon} = 0), false)"


def sql_period(label: str) -> str:
    raw = f"regexp_extract({label}, '\\(([^)]+)\\)\\s*$', 1)"
    words = "|".join(w.replace(".", "\\.") for w in text.PERIOD_WORDS)
    return f"CASE WHEN {label} IS NULL OR {raw} = '' THEN NULL WHEN contains(upper({raw}), 'PERIODIZZAZIONI') THEN trim(list_last(string_split({raw}, '/'))) WHEN regexp_matches(lower({raw}), '{words}') THEN trim({raw}) END"


def sql_name(label: str) -> str:
    bare = f"CASE WHEN lower({label}) LIKE 'dolmen,%' THEN trim(substr({label}, 8)) ELSE {label} END"
    head = f"regexp_extract({bare}, '^([^(]+)', 1)"
    return f"CASE WHEN {label} IS NULL THEN NULL WHEN {head} <> '' THEN trim(string_split(trim({head}), ' - ')[1]) ELSE trim(string_split({bare}, ',')[1]) END"


def sql_region(region_id: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in text.REGIONS.items())
    return f"CASE CASE WHEN length({region_id}) < 2 THEN lpad({region_id}, 2, '0') ELSE {region_id} END {cases} END"


#: CTEs ``cur`` (current records), ``pts`` (points by site) and ``entities``; use after WITH.
POINT = "(?i)^\\s*(?:SRID\\s*=\\s*[0-9]+\\s*;)?\\s*POINT\\s*(?:ZM|Z|M)?\\s*\\(\\s*([-+]?[0-9.]+)\\s+([-+]?[0-9.]+)(?:\\s+[-+0-9.eE]+)*\\s*\\)\\s*$"
ENTITIES = f"""
cur AS (SELECT * FROM sites WHERE identifier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY updated_at DESC NULLS LAST, record_id DESC) = 1),
geo0 AS (SELECT {sql_key('geometry_uri')} g, latitude, longitude, try_cast(nullif(regexp_extract(wkt, '{POINT}', 2), '') AS double) wlat, try_cast(nullif(regexp_extract(wkt, '{POINT}', 1), '') AS double) wlon FROM geometries),
geo1 AS (SELECT g, CASE WHEN {sql_valid('latitude', 'longitude')} THEN latitude WHEN {sql_valid('wlat', 'wlon')} THEN wlat END lat, CASE WHEN {sql_valid('latitude', 'longitude')} THEN longitude WHEN {sql_valid('wlat', 'wlon')} THEN wlon END lon FROM geo0),
geo AS (SELECT g, min(lat) lat, min(lon) lon FROM geo1 WHERE lat IS NOT NULL AND lon IS NOT NULL AND g IS NOT NULL GROUP BY g),
pts AS (SELECT s.id, min(geo.lat) lat, min(geo.lon) lon FROM (SELECT DISTINCT identifier id, {sql_key('geometry_uri')} g FROM sites WHERE identifier IS NOT NULL) s LEFT JOIN geo ON geo.g = s.g GROUP BY s.id),
entities AS (SELECT cur.identifier id, record_id load_order, label, description, historical_info, region_id, coverage, category_uri, geometry_uri, pts.lat, pts.lon, {sql_name('label')} AS name, {sql_period('label')} AS period_label, {sql_region('region_id')} AS region FROM cur LEFT JOIN pts ON pts.id = cur.identifier)"""


def sql_members(name: str, source: str, key: str, uris: str) -> str:
    """A CTE (key, member) of distinct normalised members."""
    return f"{name} AS (SELECT DISTINCT {key}, member FROM (SELECT {key}, {sql_key('u')} AS member FROM (SELECT {key}, unnest({uris}) u FROM {source})) WHERE member IS NOT NULL)"
