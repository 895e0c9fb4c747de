"""The next row of a group, without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Width of a part of a group, in steps of the order.
SPAN = 1_000_000


def with_next(rows: DataFrame, by: list[str], order: str, value: str, span: int = SPAN) -> DataFrame:
    """``rows`` with ``next``: the value of the row that follows in the group, null for the last.

    ``order`` is an integer and unique within a group, so that a part of ``span`` steps has at
    most as many rows. Rows follow each other within a part; the last of a part is joined with the
    first of the group's next part, found among the parts only.
    """
    part = F.floor(F.col(order) / span).cast("long").alias("_part")
    cut = rows.select("*", part)
    inside = cut.withColumn("_next", F.lead(value).over(Window.partitionBy(*by, "_part").orderBy(order)))
    parts = cut.groupBy(*by, "_part").agg(F.min_by(value, order).alias("_first"))
    follow = parts.withColumn("_follow", F.lead("_first").over(Window.partitionBy(*by).orderBy("_part"))).select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_part").alias("_at"), "_follow")
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    both = inside.join(follow, same & (F.col("_part") == F.col("_at")), "left")
    return both.select(*rows.columns, F.coalesce("_next", "_follow").alias("next"))
