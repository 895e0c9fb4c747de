"""Queries on points near points and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.proximity import near_or_inside
from ..sources.tables import table
from .base import ENTITIES, sql_haversine, sql_key


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_or_inside(*(table(spark, d, t) for t in ("sites", "geometries", "history_relations", "protected_areas")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("key_a", "key_b").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their kind, and the distance of those found by distance."""
    return _pairs(spark, d).withColumn("distance_km", F.round("distance_km", 6)).distinct()


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}

_KM = "CASE WHEN lower(trim(json_extract_string(metadata, '$.unit'))) = 'm' THEN value / 1000.0 ELSE value END"
_GAP = "\\)\\s*,\\s*\\("
_P1 = f"""WITH {ENTITIES},
spots AS (SELECT id, lat, lon FROM pts WHERE lat IS NOT NULL),
near AS (SELECT a.id x, b.id y, {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} km FROM spots a JOIN spots b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.002),
rec AS (SELECT DISTINCT least({sql_key('source_uri')}, {sql_key('target_uri')}) x, greatest({sql_key('source_uri')}, {sql_key('target_uri')}) y FROM history_relations WHERE relation_type = 'nearTo' AND {_KM} BETWEEN 0.0 AND 0.15),
poly AS (SELECT area_id, p, polys[p] poly FROM (SELECT area_id, polys, unnest(generate_series(1, len(polys))) p FROM (SELECT area_id, string_split(regexp_replace(regexp_extract(wkt, '(?is)polygon[^(]*(.*)$', 1), '\\)\\s*\\)\\s*,\\s*\\(\\s*\\(', '|', 'g'), '|') polys FROM protected_areas WHERE wkt LIKE '%(%'))),
ring AS (SELECT area_id, p, r, string_split(trim(rings[r], '() '), ',') cs FROM (SELECT area_id, p, rings, unnest(generate_series(1, len(rings))) r FROM (SELECT area_id, p, string_split(regexp_replace(poly, '{_GAP}', '|', 'g'), '|') rings FROM poly))),
corner AS (SELECT area_id, p, r, i, CAST(string_split(trim(cs[i]), ' ')[1] AS double) x, CAST(list_last(string_split(trim(cs[i]), ' ')) AS double) y FROM (SELECT *, unnest(generate_series(1, len(cs))) i FROM ring)),
edge AS (SELECT * FROM (SELECT area_id, p, x x1, y y1, lead(x) OVER w x2, lead(y) OVER w y2 FROM corner WINDOW w AS (PARTITION BY area_id, p, r ORDER BY i)) WHERE x2 IS NOT NULL),
inside AS (SELECT DISTINCT id x, area_id y FROM (SELECT id, area_id, p FROM spots JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)),
pairs AS (SELECT x, y, 'distance' kind, round(km, 6) distance_km FROM near WHERE km <= 0.15
UNION SELECT rec.x, rec.y, 'record', NULL FROM rec JOIN pts a ON a.id = rec.x JOIN pts b ON b.id = rec.y WHERE rec.x < rec.y AND (a.lat IS NULL OR b.lat IS NULL)
UNION SELECT x, y, 'inside', NULL FROM inside)"""
SQL = {
    "p1_found": f"{_P1} SELECT DISTINCT least(x, y) key_a, greatest(x, y) key_b FROM pairs",
    "p1_pairs": f"{_P1} SELECT least(x, y) key_a, greatest(x, y) key_b, kind, distance_km FROM pairs",
}
