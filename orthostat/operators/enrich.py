"""Enrichment of catalogue records by lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def address_batch(wanted: DataFrame, labels: DataFrame, cities: DataFrame) -> DataFrame:
    """(address_uri, address_full, municipality) of the wanted addresses that have a label.

    ``labels`` has (uri, label) of addresses and cities, ``cities`` (address_uri, city_uri). The city
    is looked up in two steps and may be missing, as may its label. The smallest label counts
    where there are several.
    """
    named = labels.where("uri is not null and label is not null").groupBy("uri").agg(F.min("label").alias("label"))
    city = cities.join(named, F.col("city_uri") == F.col("uri")).groupBy("address_uri").agg(F.min("label").alias("municipality"))
    found = wanted.select("address_uri").distinct().join(named, F.col("address_uri") == F.col("uri")).select("address_uri", F.col("label").alias("address_full"))
    return found.join(city, "address_uri", "left")


def resolve_entities(entities: DataFrame, geometries: DataFrame, addresses: DataFrame, datings: DataFrame, places: DataFrame) -> DataFrame:
    """Entities with their looked-up point, address and dating, and whether anything was found.

    Expects ``geometry_key``, ``address_uri``, ``dating_uri`` and ``municipality`` in
    ``entities``; ``geometries`` (geometry_key, g_lat, g_lon), ``addresses`` (address_uri,
    address_full, a_municipality), ``datings`` (dating_uri, dating_label) and ``places``
    (name_lower, p_lat, p_lon), each with unique keys. Address fields overwrite only where they
    say something; a place's coordinates serve where no point was found.
    """
    rows = entities.join(geometries.withColumn("g_hit", F.lit(True)), "geometry_key", "left")
    rows = rows.join(addresses.withColumn("a_hit", F.lit(True)), "address_uri", "left").join(datings.withColumn("d_hit", F.lit(True)), "dating_uri", "left")
    said = F.when(F.trim("a_municipality") != "", F.col("a_municipality"))
    rows = rows.withColumns({"lat": F.col("g_lat"), "lon": F.col("g_lon"), "municipality": F.coalesce(said, "municipality")})
    # only rows that still lack a point look for their municipality
    rows = rows.withColumn("name_lower", F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.lower("municipality")))
    rows = rows.join(places.withColumn("p_hit", F.lit(True)), "name_lower", "left")
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    source = F.when(~missing, "geometry").when(F.col("p_hit"), "municipality").otherwise("none")
    resolved = F.coalesce("g_hit", "a_hit", "d_hit", "p_hit", F.lit(False))
    kept = [c for c in entities.columns if c not in ("lat", "lon", "municipality")]
    return rows.select(*kept, "municipality", F.when(missing, F.col("p_lat")).otherwise(F.col("lat")).alias("lat"), F.when(missing, F.col("p_lon")).otherwise(F.col("lon")).alias("lon"), "address_full", "dating_label", source.alias("coordinate_source"), resolved.alias("resolved"))


def member_warnings(members: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """(key, member, warning) of listed members that are unknown or have no usable point."""
    from ..functions.geo import valid_coordinates

    known = sites.select(F.col("id").alias("member"), "lat", "lon", F.lit(True).alias("known"))
    rows = members.join(known, "member", "left")
    warning = F.when(F.col("known").isNull(), "not found").when(~valid_coordinates(F.col("lat"), F.col("lon")), "invalid coordinates")
    return rows.select(key, "member", warning.alias("warning")).where("warning is not null")


def subclass_closure(edges: DataFrame, child: str, parent: str, max_depth: int = 32) -> DataFrame:
    """(class, ancestor) reachable by one step or more, and each class with itself.

    Rounds double the length of the paths, so that a hierarchy of depth n takes log n rounds;
    cycles end by themselves since pairs are distinct.
    """
    step = edges.select(F.col(child).alias("c"), F.col(parent).alias("a")).where("c is not null and a is not null").distinct()
    nodes = step.select(F.explode(F.array("c", "a")).alias("c")).distinct()
    reach, count, depth = step.unionByName(nodes.select("c", F.col("c").alias("a"))).distinct(), -1, 1
    while depth <= max_depth and (now := reach.count()) != count:
        count, depth = now, depth * 2
        further = reach.select("c", F.col("a").alias("m")).join(reach.select(F.col("c").alias("m"), "a"), "m").select("c", "a")
        from ..session import cut

        reach = cut(further.distinct(), "closure")
    return reach.select(F.col("c").alias("class"), F.col("a").alias("ancestor"))


def flatten_caches(caches: DataFrame) -> DataFrame:
    """(key, lat, lon) of cached maps (cache_id, points map); the last cache wins."""
    rows = caches.select("cache_id", F.explode("points").alias("key", "p"))
    return rows.groupBy("key").agg(F.max_by("p", "cache_id").alias("p")).select("key", "p.lat", "p.lon")
