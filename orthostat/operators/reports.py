"""Aggregate reports over assertions, runs and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.confidence import level, tier


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of an even number, as an aggregate."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def confidence_report(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row with count, mean, least, greatest and a histogram by level; zeros for an empty table."""
    c = F.coalesce(F.col(confidence), F.lit(0.0))
    counts = [F.count_if(level(c) == name).alias(name) for name in ("high", "medium", "low", "very_low")]
    return df.agg(F.count("*").alias("n"), *(F.coalesce(f(c), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "greatest"))), *counts)


def by_tier(df: DataFrame) -> DataFrame:
    """A3: (kind, tier, n) overall (kind null) and by kind, in one pass of grouping sets."""
    rows = df.withColumn("tier", tier(F.col("confidence")))
    return rows.groupingSets([[F.col("tier")], [F.col("kind"), F.col("tier")]], F.col("kind"), F.col("tier")).agg(F.count("*").alias("n"))


def novelty_totals(df: DataFrame) -> DataFrame:
    """A2, M9: (agent, proposed, novel, filtered, rate) by agent and in all (agent null)."""
    out = df.rollup("agent").agg(F.count("*").alias("proposed"), F.count_if("novel").alias("novel"))
    return out.select("agent", "proposed", "novel", (F.col("proposed") - F.col("novel")).alias("filtered"), F.round(F.col("novel") / F.col("proposed"), 6).alias("rate"))


def stability(items: DataFrame) -> DataFrame:
    """A4: (run_id, kind, distinct_items, new_items, cumulative, novelty) of (run_id, kind, item).

    An item is new in the first run that has it. The first run of a kind has novelty 1.
    """
    own = items.select("run_id", "kind", "item").distinct()
    first = own.groupBy("kind", "item").agg(F.min("run_id").alias("run_id")).groupBy("run_id", "kind").agg(F.count("*").alias("new_items"))
    runs = own.groupBy("run_id", "kind").agg(F.count("*").alias("distinct_items")).join(first, ["run_id", "kind"], "left").fillna(0, ["new_items"])
    before = Window.partitionBy("kind").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    novelty = F.round(F.col("new_items") / F.greatest(F.col("distinct_items"), F.lit(1)), 3)
    return runs.select("run_id", "kind", "distinct_items", "new_items", F.sum("new_items").over(before).alias("cumulative"), novelty.alias("novelty"))


def saturation(runs: DataFrame) -> DataFrame:
    """A5: (position, run_id, assertions, cumulative) of (run_id, n) in run order."""
    order = Window.orderBy("run_id")  # one row per run
    total = runs.groupBy("run_id").agg(F.sum("n").alias("assertions"))
    return total.select(F.row_number().over(order).alias("position"), "run_id", "assertions", F.sum("assertions").over(order).alias("cumulative"))


def confidence_statistics(df: DataFrame) -> DataFrame:
    """(key, n, mean, median, least, greatest, sd) of (key, confidence); the upper median, the population sd.

    The median comes from counts of the distinct values, so that no list of a key is ever held.
    """
    rows = df.where("confidence is not null")
    counts = rows.groupBy("key", "confidence").agg(F.count("*").alias("k"))
    order = Window.partitionBy("key").orderBy("confidence")
    placed = counts.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy("key")))
    median = placed.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("key").agg(F.min("confidence").alias("median"))
    rest = rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("greatest"), F.stddev_pop("confidence").alias("sd"))
    return rest.join(median, "key").select("key", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "least", "greatest", "sd")))


def compare_corpora(df: DataFrame) -> DataFrame:
    """(corpus, n, mean, sd, least, greatest, validated, pending, rejected) with shares of tiers."""
    share = lambda name: F.round(F.count_if(tier(F.col("confidence")) == name) / F.count("*"), 6)
    c = "confidence"
    return df.where("confidence is not null").groupBy("corpus").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("sd"), F.min(c).alias("least"), F.max(c).alias("greatest"), share("Validated").alias("validated"), share("PendingReview").alias("pending"), share("Rejected").alias("rejected"))


def mean_by_kind(df: DataFrame, corpora: list[str]) -> DataFrame:
    """(kind, one column per corpus) with mean confidence, 0 where a corpus lacks a kind."""
    return df.groupBy("kind").pivot("corpus", corpora).agg(F.round(F.avg("confidence"), 6)).fillna(0.0, corpora)


def histogram(df: DataFrame, start: float = 0.45, width: float = 0.05) -> DataFrame:
    """(corpus, bin, n); values are counted from ``start`` in steps of ``width``, below it in bin -1."""
    place = F.floor((F.col("confidence") - start) / width + 1e-9)
    return df.where("confidence is not null").groupBy("corpus", F.greatest(place, F.lit(-1)).alias("bin")).agg(F.count("*").alias("n"))


def summary_by_kind(df: DataFrame) -> DataFrame:
    """A10: (kind, n, mean, validated_share) by kind and overall (kind null)."""
    ok = F.count_if(F.col("confidence") >= 0.70) / F.count("*")
    return df.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(ok, 6).alias("validated_share"))


def history_summary(clusters: DataFrame, relations: DataFrame, paths: DataFrame, themes: int = 10) -> DataFrame:
    """(part, name, n): clusters and relations by type, and the first themes of the paths."""
    first = paths.where("theme is not null").groupBy("theme").agg(F.count("*").alias("n")).orderBy("theme").limit(themes)
    by = lambda df, col, part: df.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return by(clusters, "cluster_type", "cluster").unionByName(by(relations, "relation_type", "relation")).unionByName(first.select(F.lit("theme").alias("part"), F.col("theme").alias("name"), "n"))


def context_lines(clusters: DataFrame, most: int = 10, previews: int = 3) -> DataFrame:
    """(kind, line, more) of the first clusters of each kind, with member previews; ``more`` counts the rest.

    ``clusters`` has (item, kind, label, tokens).
    """
    order = Window.partitionBy("kind").orderBy("item")
    total = clusters.groupBy("kind").agg(F.count("*").alias("total"))
    rest = F.size("tokens") - previews
    preview = F.concat(F.array_join(F.slice("tokens", 1, previews), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""))
    line = F.concat(F.lit("- "), F.coalesce("label", F.lit("")), F.lit(": "), preview)
    rows = clusters.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).join(total, "kind")
    return rows.select("kind", "k", line.alias("line"), F.greatest(F.col("total") - most, F.lit(0)).alias("more"))
