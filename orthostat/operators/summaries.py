"""What the members of clusters say about them: region and centroid, or years."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .fallback import dominant


def geographic(members: DataFrame, sites: DataFrame) -> DataFrame:
    """(cluster_id, region, centroid_lat, centroid_lon, known) of clusters (cluster_id, member).

    ``sites`` has (id, load_order, lat, lon) and perhaps ``region``. The region is the most frequent
    one, ``Unknown`` among them; ties go to the one seen first. Members that aren't in ``sites``
    don't count; a cluster without known member has no row.
    """
    region = F.coalesce("region", F.lit("Unknown")) if "region" in sites.columns else F.lit("Unknown")
    rows = members.join(sites.select(F.col("id").alias("member"), region.alias("region"), "load_order", "lat", "lon"), "member")
    middle = rows.groupBy("cluster_id").agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.count("*").alias("known"))
    return middle.join(dominant(rows, "cluster_id", "region", "load_order"), "cluster_id").select("cluster_id", "region", "centroid_lat", "centroid_lon", "known")


def chronological(members: DataFrame, dated: DataFrame) -> DataFrame:
    """(cluster_id, start_year, end_year): from the earliest to the latest year of the members of ``dated`` (id, start_year, end_year)."""
    rows = members.join(dated.select(F.col("id").alias("member"), "start_year", "end_year"), "member")
    return rows.groupBy("cluster_id").agg(F.min("start_year").alias("start_year"), F.max("end_year").alias("end_year"))
