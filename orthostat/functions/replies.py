"""Decisions in the replies of a proposer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .text import unfenced

# The names by which agents are asked for.
AGENT_NAMES = {
    "geo_analyzer": "geo_analyzer", "geospatial": "geo_analyzer", "temporal_analyzer": "temporal_analyzer", "chronological": "temporal_analyzer",
    "type_analyzer": "type_analyzer", "typological": "type_analyzer", "path_generator": "path_generator", "narrative": "path_generator",
    "triple_generator": "triple_generator", "validator": "validator", "validation": "validator", "terminate": "terminate",
}


def decisions(rows: DataFrame, reply: str) -> DataFrame:
    """``rows`` with ``agent``, ``task`` and ``outcome``: task, end, unknown agent, or unreadable.

    A reply is a JSON object, perhaps in a code fence; names of agents count without case and
    with blanks for underscores.
    """
    read = F.from_json(unfenced(F.col(reply)), "agent string, task string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    known = F.create_map(*(F.lit(x) for pair in AGENT_NAMES.items() for x in pair))
    name = F.replace(F.lower("_read.agent"), F.lit(" "), F.lit("_"))
    readable = F.col("_read").isNotNull() & (F.col("_read.agent").isNotNull() | F.col("_read.task").isNotNull())
    out = rows.withColumn("_read", read).withColumn("agent", F.when(readable, known[name]))
    outcome = F.when(~readable, "unreadable").when(F.col("agent").isNull(), "unknown agent").when(F.col("agent") == "terminate", "end").otherwise("task")
    return out.withColumns({"task": F.col("_read.task"), "outcome": outcome}).drop("_read")
