"""Deterministic fallbacks that cluster entities without proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .ordering import with_next
from .spatial import locations, near_locations


def dominant(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the most frequent value of each key; ties go to the one seen first."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def greedy_clusters(sites: DataFrame, radius_km: float, max_rounds: int = 200) -> DataFrame:
    """(cluster, id) of greedy single-pass clusters in load order, of two members or more.

    A cluster starts with the first free site; each later free site joins if it lies within
    ``radius_km`` of a member, in one pass. A site hence belongs to the earliest site that leads
    to it over near sites of ever later load order, which is a fixed point of least labels along
    edges from earlier to later sites: no cluster is held in one task. ``sites`` has unique
    (id, load_order) and (lat, lon); the cluster is named by its first site.
    """
    order = sites.select("id", F.col("load_order").cast("long").alias("o"))
    places = cut(locations(sites, "id"), "places")
    at = cut(sites.select(F.col("load_order").cast("long").alias("o"), "lat", "lon").join(places, ["lat", "lon"]).select("rep", "o"), "at")
    # sites of one place, and of two near places, follow each other in load order: no pair of sites is made
    pairs = cut(near_locations(places, radius_km), "near").select("rep_a", "rep_b", F.explode(F.array("rep_a", "rep_b")).alias("rep"))
    of_place = with_next(at, ["rep"], "o", "o").select("o", "next")
    of_pair = with_next(pairs.join(at, "rep").select("rep_a", "rep_b", "o"), ["rep_a", "rep_b"], "o", "o").select("o", "next")
    chains = of_place.unionByName(of_pair)
    edges = cut(chains.where("next is not null").select(F.col("o").alias("early"), F.col("next").alias("late")).distinct(), "edges")
    labels = cut(edges.select(F.explode(F.array("early", "late")).alias("o")).distinct().withColumn("label", F.col("o")), "labels")
    before = None
    for _ in range(max_rounds):
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
        moved = edges.join(labels.withColumnRenamed("o", "early"), "early").select(F.col("late").alias("o"), "label")
        least = labels.unionByName(moved).groupBy("o").agg(F.min("label").alias("label"))
        # the label of a label is an earlier start of the same chain
        jump = labels.select(F.col("o").alias("label"), F.col("label").alias("further"))
        labels = cut(least.join(jump, "label", "left").select("o", F.least("label", "further").alias("label")), "labels")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    large = labels.groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    found = labels.join(large, "label").join(order, "o").select("label", "id")
    return found.join(order.select(F.col("o").alias("label"), F.col("id").alias("cluster")), "label").select("cluster", "id")


def period_clusters(sites: DataFrame, confidence: float = 0.5) -> DataFrame:
    """T5: clusters of sites of one normalised period, of two members or more."""
    rows = sites.where("period is not null").groupBy("period").agg(F.count("*").alias("site_count"), F.min("start_year").alias("start_year"), F.max("end_year").alias("end_year"))
    return rows.where("site_count >= 2").withColumn("confidence", F.lit(confidence))


def category_clusters(features: DataFrame, order: DataFrame, most: int = 6) -> DataFrame:
    """Clusters of the first ``most`` sites, in load order, of each functional category."""
    rows = features.where(F.col("feature").startswith("cat:")).join(order.select(F.col("id").alias("entity"), "load_order"), "entity")
    first = Window.partitionBy("feature").orderBy("load_order", "entity")
    rows = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    large = rows.groupBy("feature").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.join(large, "feature").select(F.col("feature").alias("category"), "entity", "k", F.lit(0.5).alias("confidence"))


def cluster_paths(members: DataFrame, clusters: DataFrame, most_clusters: int = 3, most_stops: int = 10) -> DataFrame:
    """P5: (path_id, stop_order, member, duration_hours) from the first clusters, two known members or more.

    ``members`` has (cluster_id, ord, member) of known members, ``clusters`` (cluster_id, rank).
    """
    first = clusters.orderBy("rank", "cluster_id").limit(most_clusters)
    order = Window.partitionBy("cluster_id").orderBy("ord", "member")
    rows = members.join(first.select("cluster_id"), "cluster_id").withColumn("stop_order", F.row_number().over(order)).where(F.col("stop_order") <= most_stops)
    large = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.join(large, "cluster_id").select(F.concat(F.lit("path_"), "cluster_id").alias("path_id"), "stop_order", "member", (0.5 * F.col("n")).alias("duration_hours"))


def simulated_clusters(sites: DataFrame) -> DataFrame:
    """A cluster per region (0.85) and per period (0.80) with two sites or more."""
    parts = []
    for kind, value, confidence in (("geographic", "region", 0.85), ("chronological", "period_label", 0.80)):
        rows = sites.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(value).alias("label")).agg(F.count("*").alias("site_count")).where("site_count >= 2")
        parts.append(rows.select(F.lit(kind).alias("cluster_type"), "label", "site_count", F.lit(confidence).alias("confidence")))
    return parts[0].unionByName(parts[1])


def simulated_relations(sites: DataFrame) -> DataFrame:
    """Relations between consecutive sites of a region (0.75) and of a period (0.72)."""
    parts = []
    for kind, value, confidence in (("nearTo", "region", 0.75), ("contemporaryWith", "period_label", 0.72)):
        rows = sites.where(F.col(value).isNotNull() & (F.col(value) != "")).select(value, "load_order", "id")
        rows = with_next(rows, [value], "load_order", "id").where("next is not null")
        parts.append(rows.select(F.lit(kind).alias("relation_type"), F.col("id").alias("source"), F.col("next").alias("target"), F.lit(confidence).alias("confidence")))
    return parts[0].unionByName(parts[1])
