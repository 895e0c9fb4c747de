"""Sliding-window rate limits over request times, backoff, and the stopping rules of a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: The fixed order in which the analyzers run.
AGENTS = ["geographic", "temporal", "typological", "path"]
#: In microseconds; and what a row of an hour is: a request of it, one of the last minute before it
#: or of the hour a day ago, or the number of requests in the 23 hours between.
_MINUTE, _HOUR, _DAY = 60_000_000, 3_600_000_000, 86_400_000_000
_OWN, _MINUTE_AGO, _DAY_AGO, _BETWEEN = range(4)


def waits(requests: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """L1, L2: (event_id, in_minute, in_day, wait_seconds, over_quota) of (event_id, ts).

    Counts look back 60 s and 24 h, both ends included. A request waits until the one
    ``per_minute`` before it is 60 s old. Requests are handled by hour: of the hours before, a task
    gets the last minute, the hour a day ago, and of those between their number of requests only.
    """
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = requests.where("ts is not null").select("event_id", u.alias("u")).withColumn("hour", F.col("u") - F.pmod("u", F.lit(_HOUR)))
    copies = [F.struct(F.col("hour"), F.lit(_OWN).alias("role")), F.struct((F.col("hour") + _DAY).alias("hour"), F.lit(_DAY_AGO).alias("role"))]
    late = F.when(F.col("hour") + _HOUR - F.col("u") <= _MINUTE, F.struct((F.col("hour") + _HOUR).alias("hour"), F.lit(_MINUTE_AGO).alias("role")))
    each = rows.select("event_id", "u", F.explode(F.array_compact(F.array(*copies, late))).alias("e")).select("event_id", "u", "e.hour", "e.role")
    # requests in the 23 hours between; hours are windowed by day, each with a copy of the day before
    day = F.col("hour") - F.pmod("hour", F.lit(_DAY))
    hours = rows.groupBy("hour").agg(F.count("*").alias("n")).withColumn("day", F.explode(F.array(day, day + _DAY)))
    between = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("hour").rangeBetween(_HOUR - _DAY, -1)), F.lit(0))
    between = hours.withColumn("u", between).where(F.col("day") == day).select(F.lit(None).cast(rows.schema["event_id"].dataType).alias("event_id"), "u", "hour", F.lit(_BETWEEN).alias("role"))

    def count(group: pa.Table) -> pa.Table:
        u, role = group["u"].to_numpy(), group["role"].to_numpy()
        near = group.filter(pa.array((role == _OWN) | (role == _MINUTE_AGO))).sort_by([("u", "ascending"), ("event_id", "ascending")])
        n, far = int((role == _OWN).sum()), np.sort(u[role == _DAY_AGO])
        known = near["u"].to_numpy()
        before = len(known) - n  # those of the hour before come first
        own = known[before:]
        upto = np.searchsorted(known, own, "right")
        in_minute = upto - np.searchsorted(known, own - _MINUTE, "left")
        in_day = upto - before + u[role == _BETWEEN].sum() + len(far) - np.searchsorted(far, own - _DAY, "left")
        # a request per_minute earlier that isn't here is over 60 s old and makes nobody wait
        at = np.arange(before, len(known)) - per_minute
        wait = np.zeros(n)
        wait[at >= 0] = np.maximum(0.0, 60 - (own[at >= 0] / 1e6 - known[at[at >= 0]] / 1e6))
        return pa.table({"event_id": near["event_id"].slice(before), "in_minute": in_minute, "in_day": in_day, "wait": wait})

    schema = StructType([rows.schema["event_id"], *(StructField(c, LongType()) for c in ("in_minute", "in_day")), StructField("wait", DoubleType())])
    counts = each.unionByName(between).groupBy("hour").applyInArrow(count, schema)
    return counts.select("event_id", "in_minute", "in_day", F.round("wait", 3).alias("wait_seconds"), (F.col("in_day") > per_day).alias("over_quota"))


def backoff(base: float, attempt: Column, jitter: Column) -> Column:
    """L3: min(base * 2^attempt, 60) times 1 plus half of a jitter in [0, 1]."""
    return F.least(F.lit(60.0), base * F.pow(F.lit(2.0), attempt)) * (1 + 0.5 * jitter)


def next_agent(done: set[str]) -> str | None:
    """The first analyzer that has not run."""
    return next((a for a in AGENTS if a not in done), None)


def should_stop(iteration: int, done: set[str], mode: str = "comprehensive", coverage: float = 0.0, kinds: int = 0, most: int = 20) -> bool:
    """Enough iterations, all analyzers done, or (autonomous) coverage and diversity reached."""
    return iteration >= most or set(AGENTS) <= done or (mode == "autonomous" and coverage >= 0.8 and kinds >= 2)


def should_generate_paths(clusters: int, relations: int) -> bool:
    """Two clusters or three relations suffice."""
    return clusters >= 2 or relations >= 3
