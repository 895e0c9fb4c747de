"""Materialised features, path assertions and the context that an analyzer gets to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import confidence
from ..functions.text import excerpt, feature_label


def materialized_features(rows: DataFrame, total: int, canonical: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(category, feature, entity, n, confidence) of features that ``least`` entities or more have.

    ``rows`` has (category, label, entity); labels are normalised, blank ones left out.
    ``canonical`` (category, label, canonical) merges similar labels. Repeated rows count once.
    """
    own = rows.select("category", feature_label(F.col("label")).alias("feature"), "entity").where("entity is not null and feature != ''")
    if canonical is not None:
        names = canonical.select("category", F.col("label").alias("feature"), "canonical")
        own = own.join(names, ["category", "feature"], "left").withColumn("feature", F.coalesce("canonical", "feature")).drop("canonical")
    own = own.distinct()
    counts = own.groupBy("category", "feature").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    score = F.round(confidence.feature(F.col("n"), F.lit(total), F.col("category")), 2)
    return own.join(counts, ["category", "feature"]).select("category", "feature", "entity", "n", score.alias("confidence"))


def kept_stops(stops: Column, most: int) -> Column:
    """The first ``most`` stops, if there are over half as many again."""
    return F.when(F.size(stops) > 1.5 * most, F.slice(stops, 1, most)).otherwise(stops)


def path_stops(paths: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """(path_id, stop_id, stop_order, member, label) of paths (path_id, stops array of members).

    The label comes from the site's name, else it is the member; the order counts from 1.
    """
    rows = paths.select("path_id", F.posexplode(kept_stops(F.col("stops"), most)).alias("i", "member")).where("member is not null")
    order = Window.partitionBy("path_id").orderBy("i")
    rows = rows.withColumn("stop_order", F.row_number().over(order)).join(names.select(F.col("id").alias("member"), "name"), "member", "left")
    stop = F.concat(F.lit("stop_"), "path_id", F.lit("_"), F.col("stop_order").cast("string"))
    return rows.select("path_id", stop.alias("stop_id"), "stop_order", "member", F.coalesce("name", "member").alias("label"))


def site_context(sites: DataFrame, description: int = 200, history: int = 150) -> DataFrame:
    """(id, name, region, period, description, history) with excerpts."""
    return sites.select("id", "name", "region", F.col("period_label").alias("period"), excerpt(F.col("description"), description).alias("description"), excerpt(F.col("historical_info"), history).alias("history"))


def as_json(context: DataFrame) -> DataFrame:
    """(id, value): each row of a context as a JSON object without its null fields."""
    return context.select("id", F.to_json(F.struct(*context.columns)).alias("value"))
