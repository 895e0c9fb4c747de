"""What earlier runs know, as lines of text and as an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _top(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group by item, with their place ``k`` and the number ``more`` of the others."""
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("item"))).where(F.col("k") <= most)
    more = F.greatest(F.col("total") - most, F.lit(0)).alias("more")
    return first.join(rows.groupBy(*by).agg(F.count("*").alias("total")), by).select("*", more)


def _preview(array: Column, most: int, between: str) -> Column:
    rest = F.size(array) - most
    return F.concat(F.coalesce(F.array_join(F.slice(array, 1, most), between), F.lit("")), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))


def relation_lines(relations: DataFrame, most: int = 20) -> DataFrame:
    """(kind, k, line, more) of the first relations (item, kind, a, b) of each type; nearTo has a direction."""
    arrow = F.when(F.col("kind") == "nearTo", " → ").otherwise(" ↔ ")
    line = F.concat(F.lit("- "), F.coalesce("a", F.lit("")), arrow, F.coalesce("b", F.lit("")))
    return _top(relations, ["kind"], most).select("kind", "k", line.alias("line"), "more")


def path_lines(paths: DataFrame, most: int = 5, stops: int = 4) -> DataFrame:
    """(k, line, more) of the first paths (item, theme, path_type, stops).

    The first are found by a top-k, not by a sort of all paths in one task.
    """
    total = paths.count()
    first = paths.orderBy("item").limit(most)
    rows = first.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item")))  # ``most`` rows
    said = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(F.lit("- "), said("theme"), F.lit(" ("), said("path_type"), F.lit("): "), _preview(F.col("stops"), stops, " → "))
    return rows.select("k", line.alias("line"), F.lit(max(total - most, 0)).cast("long").alias("more"))


def number_lines(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(part, name, line): how many distinct items (item, kind) each part has by kind."""
    out = None
    for rows, name in parts:
        n = rows.where("kind is not null").groupBy(F.col("kind").alias("name")).agg(F.countDistinct("item").alias("n"))
        line = F.concat(F.lit("  - "), "name", F.lit(": "), F.col("n").cast("string"), F.lit(f" {name}"))
        part = n.select(F.lit(name).alias("part"), "name", line.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def cluster_context(clusters: DataFrame, previews: int = 5) -> DataFrame:
    """(cluster_id, cluster_type, label, size, first_members) of clusters with ``members``."""
    size = F.coalesce(F.when(F.col("members").isNotNull(), F.size("members")), F.lit(0))
    first = F.coalesce(F.array_join(F.slice("members", 1, previews), ", "), F.lit(""))
    return clusters.select("cluster_id", "cluster_type", "label", size.alias("size"), first.alias("first_members"))


def export(clusters: DataFrame, relations: DataFrame, paths: DataFrame) -> DataFrame:
    """(part, value): each row of the history as a JSON object."""
    parts = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("value")) for name, df in (("clusters", clusters), ("relations", relations), ("paths", paths))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
