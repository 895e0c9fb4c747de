"""Validators of proposed clusters, relations and paths: aggregate, then score.

Proposals are tables, wherever they come from. Each validator reports validity, score and
reason for every proposal; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import haversine_km, valid_coordinates
from ..functions.period import common_range
from ..functions.vector import cosine


def ramp(distance: Column, most: float) -> Column:
    """1 up to 5 km, then linearly down to a half at ``most``."""
    return F.when(distance < 5.0, 1.0).otherwise(1.0 - 0.5 * (distance - 5.0) / (most - 5.0))


def geographic_clusters(proposals: DataFrame, sites: DataFrame, max_radius_km: float = 10.0, least: int = 2, most: int | None = None) -> DataFrame:
    """(cluster_id, proposed, valid_members, missing, unlocated, centroid_lat, centroid_lon, radius_km, is_valid, score, reason).

    ``proposals`` has one row (cluster_id, member) per listed member, ``sites`` (id, lat, lon).
    The centroid is the mean of the coordinates, the radius the greatest distance from it.
    A member that is listed twice counts twice.
    """
    rows = proposals.join(sites.select(F.col("id").alias("member"), "lat", "lon", F.lit(True).alias("known")), "member", "left")
    rows = rows.withColumn("ok", valid_coordinates(F.col("lat"), F.col("lon")))
    counted = rows.groupBy("cluster_id").agg(
        F.count("*").alias("proposed"), F.count_if("ok").alias("valid_members"), F.count_if(F.col("known").isNull()).alias("missing"),
        F.count_if(F.col("known") & ~F.col("ok")).alias("unlocated"),
        F.avg(F.when(F.col("ok"), F.col("lat"))).alias("centroid_lat"), F.avg(F.when(F.col("ok"), F.col("lon"))).alias("centroid_lon"),
    )
    n = F.col("valid_members")
    sized = F.when(n < least, "too few members").when(n > most, "too many members") if most else F.when(n < least, "too few members")
    # only clusters of a fit size are measured
    fit = counted.withColumn("size_reason", sized)
    far = (
        rows.where("ok").select("cluster_id", "lat", "lon").join(fit.where("size_reason is null").select("cluster_id", "centroid_lat", "centroid_lon"), "cluster_id")
        .groupBy("cluster_id").agg(F.max(haversine_km(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon"))).alias("radius_km"))
    )
    out = fit.join(far, "cluster_id", "left")
    reason = F.coalesce(F.col("size_reason"), F.when(F.col("radius_km") > max_radius_km, "radius exceeds maximum"))
    score = F.when(reason.isNotNull(), 0.0).otherwise(ramp(F.col("radius_km"), max_radius_km))
    return out.select("cluster_id", "proposed", "valid_members", "missing", "unlocated", "centroid_lat", "centroid_lon", "radius_km", reason.isNull().alias("is_valid"), score.alias("score"), reason.alias("reason"))


def _both_ends(relations: DataFrame, sites: DataFrame, columns: list[str]) -> DataFrame:
    """Relations (…, source, target) with the columns of both ends and whether each is known."""
    side = lambda s: sites.select(F.col("id").alias("source" if s == "a" else "target"), F.lit(True).alias(f"known_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return relations.join(side("a"), "source", "left").join(side("b"), "target", "left")


def near_relations(relations: DataFrame, sites: DataFrame, max_km: float = 30.0) -> DataFrame:
    """Relations (…, source, target) with distance_km, is_valid, score, reason and strength."""
    rows = _both_ends(relations, sites, ["lat", "lon"])
    ok = {s: valid_coordinates(F.col(f"lat_{s}"), F.col(f"lon_{s}")) for s in "ab"}
    km = F.when(ok["a"] & ok["b"], haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    reason = (
        F.when(F.col("known_a").isNull(), "source not found").when(F.col("known_b").isNull(), "target not found")
        .when(~ok["a"], "source without coordinates").when(~ok["b"], "target without coordinates").when(F.col("distance_km") > max_km, "too far apart")
    )
    rows = rows.withColumn("distance_km", km).withColumn("reason", reason)
    score = F.when(F.col("reason").isNotNull(), 0.0).otherwise(ramp(F.col("distance_km"), max_km))
    strength = F.when(F.col("distance_km") < max_km, 1 - F.col("distance_km") / max_km).when(F.col("distance_km").isNotNull(), 0.0)
    return rows.select(*relations.columns, "distance_km", F.col("reason").isNull().alias("is_valid"), score.alias("score"), "reason", strength.alias("strength"))


def chronological_clusters(proposals: DataFrame, sites: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """By the number of distinct period labels among the members that have one."""
    label = F.lower("period_label")
    rows = proposals.join(sites.select(F.col("id").alias("member"), "period_label"), "member", "left")
    own = rows.groupBy("cluster_id").agg(F.count("*").alias("proposed"), F.count_if(F.coalesce(F.col("period_label"), F.lit("")) != "").alias("dated"), F.countDistinct(F.when(label != "", label)).alias("periods"))
    n, u = F.col("dated"), F.col("periods")
    reason = F.when(n < least, "too few dated members").when(n > most, "too many members") if most else F.when(n < least, "too few dated members")
    score = F.when(reason.isNotNull(), 0.0).when(u == 1, 1.0).when(u == 2, 0.7).when(u <= n / 2, 0.5).otherwise(0.3)
    return own.select("cluster_id", "proposed", "dated", "periods", reason.isNull().alias("is_valid"), score.alias("score"), reason.alias("reason"))


def contemporary_relations(relations: DataFrame, sites: DataFrame) -> DataFrame:
    """T4: equal labels, or one standard period that both name."""
    rows = _both_ends(relations, sites, ["period_label"])
    a, b = F.lower("period_label_a"), F.lower("period_label_b")
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    matched = F.when(both & (a != b), common_range(a, b))
    reason = F.when(F.col("known_a").isNull(), "source not found").when(F.col("known_b").isNull(), "target not found").when(~both, "missing period").when((a != b) & matched.isNull(), "no common period")
    score = F.when(F.col("known_a").isNull() | F.col("known_b").isNull() | ~both, 0.0).when(a == b, 1.0).when(matched.isNotNull(), 0.8).otherwise(0.3)
    return rows.select(*relations.columns, matched.alias("matched_period"), reason.isNull().alias("is_valid"), score.alias("score"), reason.alias("reason"))


def _with_features(proposals: DataFrame, features: DataFrame) -> DataFrame:
    """(cluster_id, n): the number of members that have features."""
    return proposals.join(features.select(F.col("entity").alias("member")).distinct(), "member", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n"))


def shared_features(proposals: DataFrame, features: DataFrame, majority: float = 0.6) -> DataFrame:
    """(cluster_id, feature, k, n): features that k of the n members with features have, a majority and two at least."""
    rows = proposals.join(features.withColumnRenamed("entity", "member"), "member")
    counts = rows.groupBy("cluster_id", "feature").agg(F.count("*").alias("k")).join(_with_features(proposals, features), "cluster_id")
    return counts.where(F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") * majority + 1e-9)))


def typological_clusters(proposals: DataFrame, features: DataFrame, min_shared: int = 1, majority: float = 0.6, least: int = 2, most: int | None = None) -> DataFrame:
    """Y2: by the features that a majority of the members with features share.

    ``features`` has distinct (entity, feature). Coverage is the mean share of members that have
    a shared feature.
    """
    n = _with_features(proposals, features)
    shared = shared_features(proposals, features, majority).groupBy("cluster_id").agg(F.count("*").alias("shared"), F.sum("k").alias("covered"))
    out = proposals.select("cluster_id").distinct().join(n, "cluster_id", "left").join(shared, "cluster_id", "left").fillna(0, ["n", "shared", "covered"])
    size = F.when(F.col("n") < least, "too few members with features").when(F.col("n") > most, "too many members") if most else F.when(F.col("n") < least, "too few members with features")
    reason = F.coalesce(size, F.when(F.col("shared") < min_shared, "too few shared features"))
    coverage = F.when((F.col("shared") > 0) & (F.col("n") > 0), F.col("covered") / (F.col("shared") * F.col("n"))).otherwise(0.0)
    raw = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("shared") / 5) + 0.2 * coverage)
    score = F.when(size.isNotNull(), 0.0).when(reason.isNotNull(), 0.3).otherwise(raw)
    return out.select("cluster_id", F.col("n").alias("with_features"), "shared", coverage.alias("coverage"), reason.isNull().alias("is_valid"), score.alias("score"), reason.alias("reason"))


def similar_relations(relations: DataFrame, vectors: DataFrame, stated: str, least: float = 0.7, weight: float = 0.7) -> DataFrame:
    """Relations (…, source, target, stated) whose blend of stated score and cosine reaches ``least``.

    ``vectors`` has (id, vector); a missing vector makes a relation invalid with score 0.
    """
    rows = _both_ends(relations, vectors, ["vector"])
    both = F.col("vector_a").isNotNull() & F.col("vector_b").isNotNull()
    rows = rows.withColumn("cosine", F.when(both, cosine(F.col("vector_a"), F.col("vector_b"))))
    score = F.when(both, weight * F.col(stated) + (1 - weight) * F.col("cosine")).otherwise(0.0)
    return rows.select(*relations.columns, "cosine", score.alias("score"), (both & (score >= least)).alias("is_valid"))


def thematic_paths(stops: DataFrame, sites: DataFrame, kinds: DataFrame, max_total_km: float = 200.0) -> DataFrame:
    """Paths from stops (path_id, ord, member) and kinds (path_id, path_type).

    Legs run between consecutive known stops, if all known stops have coordinates. Geographic
    paths score by even legs and short length, others by the number of stops.
    """
    rows = stops.join(sites.select(F.col("id").alias("member"), "lat", "lon", F.lit(True).alias("known")), "member", "left")
    order = Window.partitionBy("path_id").orderBy("ord", "member")
    known = rows.where("known").withColumn("ok", valid_coordinates(F.col("lat"), F.col("lon")))
    known = known.withColumn("leg", haversine_km(F.col("lat"), F.col("lon"), F.lead("lat").over(order), F.lead("lon").over(order)))
    legs = known.groupBy("path_id").agg(F.count("*").alias("known_stops"), F.min("ok").alias("located"), F.sum("leg").alias("total_km"), F.avg("leg").alias("mean_leg"), F.stddev_pop("leg").alias("sd_leg"))
    counts = stops.groupBy("path_id").agg(F.count("*").alias("stops"))
    out = kinds.join(counts, "path_id", "left").join(legs, "path_id", "left").fillna(0, ["stops", "known_stops"]).withColumn("located", F.coalesce("located", F.lit(False)))
    out = out.withColumn("total_km", F.when(F.col("located") & (F.col("known_stops") >= 2), F.col("total_km")))
    geographic = F.lower("path_type") == "geographic"
    reason = (
        F.when(F.col("stops") < 2, "too few stops").when(F.col("known_stops") < 2, "too few known stops")
        .when(geographic & ~F.col("located"), "coordinates missing").when(geographic & (F.col("total_km") > max_total_km), "too long")
    )
    even = F.greatest(F.lit(0.5), 1 - F.when(F.col("mean_leg") > 0, F.col("sd_leg") / F.col("mean_leg")).otherwise(0.0) / 2)
    strict = (even + 1 - 0.5 * F.col("total_km") / max_total_km) / 2
    loose = 0.8 + F.least(F.lit(0.1), 0.02 * F.col("known_stops")) - F.when(F.col("located"), 0.0).otherwise(0.05)
    score = F.when(reason.isNotNull(), 0.0).when(geographic, strict).otherwise(F.round(loose, 2))
    return out.select("path_id", "path_type", "stops", "known_stops", "total_km", reason.isNull().alias("is_valid"), score.alias("score"), reason.alias("reason"))
