"""Which catalogued sites lie near each other, near by record, or inside protected areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import valid_coordinates
from ..functions.uris import uri_key
from ..session import cut
from .spatial import locations, near_locations, point_of_wkt, points_in_regions


def site_points(sites: DataFrame, geometries: DataFrame) -> DataFrame:
    """(key, lat, lon) of each identifier; nulls where none of its geometries states a point.

    Usable latitude and longitude come before the WKT text. Rows without identifier are left
    out; if a site's geometries differ, the smallest (lat, lon) counts.
    """
    wkt_lat, wkt_lon = point_of_wkt(F.col("wkt"))
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    stated = valid_coordinates(lat, lon)
    # points written in WKT must be places on earth as well; (0, 0) there is none
    usable = valid_coordinates(wkt_lat, wkt_lon)
    point = F.when(stated, F.struct(lat.alias("lat"), lon.alias("lon"))).when(usable, F.struct(wkt_lat.alias("lat"), wkt_lon.alias("lon")))
    by_geometry = geometries.select(uri_key(F.col("geometry_uri")).alias("g"), point.alias("p")).where("g is not null and p is not null").groupBy("g").agg(F.min("p").alias("p"))
    named = sites.where(F.col("identifier").isNotNull()).select(F.col("identifier").alias("key"), uri_key(F.col("geometry_uri")).alias("g")).distinct()
    return named.join(by_geometry, "g", "left").groupBy("key").agg(F.min("p").alias("p")).select("key", "p.lat", "p.lon")


def recorded_near_pairs(relations: DataFrame, radius_km: float) -> DataFrame:
    """(a, b) of the site keys, a < b, that some nearTo row puts at most ``radius_km`` apart.

    Values whose metadata has the unit "m" are metres. Null and negative values say nothing.
    """
    unit = F.get_json_object("metadata", "$.unit")
    km = F.when(F.lower(F.trim(unit)) == "m", F.col("value") / 1000.0).otherwise(F.col("value"))
    a, b = uri_key(F.col("source_uri")), uri_key(F.col("target_uri"))
    return (
        relations.where((F.col("relation_type") == "nearTo") & km.between(0.0, radius_km))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(a.isNotNull() & b.isNotNull() & (F.col("a") < F.col("b")))
        .distinct()
    )


def near_or_inside(sites: DataFrame, geometries: DataFrame, relations: DataFrame, areas: DataFrame, radius_km: float = 0.15) -> DataFrame:
    """(key_a, key_b, kind, distance_km): near sites, sites near by record, areas around a site.

    ``kind`` is ``distance``, ``record`` (at least one site has no point) or ``inside``.
    The smaller key comes first. Sites at one place are swept as one and expanded at the end.
    """
    points = cut(site_points(sites, geometries), "points")
    places = cut(locations(points), "places")
    members = points.join(places, ["lat", "lon"]).select("key", "rep")
    a, b = members.select(F.col("key").alias("key_a"), F.col("rep").alias("rep_a")), members.select(F.col("key").alias("key_b"), F.col("rep").alias("rep_b"))
    # what the sweeps find is written first: the planner would take it for as small as their input and broadcast it
    apart = cut(near_locations(places, radius_km), "near").join(a, "rep_a").join(b, "rep_b").select("key_a", "key_b", "distance_km")
    together = a.join(b, F.col("rep_a") == F.col("rep_b")).where("key_a < key_b").select("key_a", "key_b", F.lit(0.0).alias("distance_km"))
    inside = cut(points_in_regions(places, areas, "area_id", "wkt"), "inside").join(members, "rep").select(F.col("key").alias("key_a"), F.col("region").alias("key_b"), F.lit(None).cast("double").alias("distance_km"))
    # record pairs name sites by normalised key; both must be in the catalogue
    known = points.select(F.lower(F.trim("key")).alias("k"), "key", F.col("lat").isNotNull().alias("located"))
    recorded = (
        recorded_near_pairs(relations, radius_km)
        .join(known.select(F.col("k").alias("a"), F.col("key").alias("key_a"), F.col("located").alias("la")), "a")
        .join(known.select(F.col("k").alias("b"), F.col("key").alias("key_b"), F.col("located").alias("lb")), "b")
        .where(~(F.col("la") & F.col("lb")))
        .select("key_a", "key_b", F.lit(None).cast("double").alias("distance_km"))
    )
    parts = [part.withColumn("kind", F.lit(kind)) for kind, part in (("distance", apart.unionByName(together)), ("record", recorded), ("inside", inside))]
    first, second = F.least("key_a", "key_b"), F.greatest("key_a", "key_b")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(first.alias("key_a"), second.alias("key_b"), "kind", "distance_km")
