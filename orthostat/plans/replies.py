"""Replies of proposers, contexts of earlier knowledge, and address chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import replies
from ..functions.json_repair import repaired
from ..functions.uris import uri_key
from ..operators import contexts, enrich
from ..sources.tables import table
from .base import sql_key

#: Ways in which a reply was cut off, by event, and what is left of it.
_CUTS = {
    0: ("'[' || props || ', {\"cut'", "'[' || props || ']'"),
    1: ("'[' || props || ', \"key'", "'[' || props || ']'"),
    2: ("'{\"list\": [' || props || ', '", "'{\"list\": [' || props || ']}'"),
    3: ("'{\"outer\": {\"list\": [' || props", "'{\"outer\": {\"list\": [' || props || ']}}'"),
    4: ("'[' || event_id || ', {\"k\": 1, \"x_confidence\": null}'", "'[' || event_id || ']'"),
    5: ("'[' || event_id || ', {\"description\": \"\"}'", "'[' || event_id || ']'"),
    6: ("'[' || props || ', {\"name\": \"a [b] {c}\"}'", "'[' || props || ', {\"name\": \"a [b] {c}\"}]'"),
    7: ("props", "props"),
}


def _case(which: int) -> str:
    return f"CASE event_id % {len(_CUTS)} " + " ".join(f"WHEN {k} THEN {v[which]}" for k, v in _CUTS.items()) + " END"


def n19_cut_replies(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut off in several ways, repaired."""
    return table(spark, d, "events").select("event_id", F.expr(_case(0)).alias("text")).select("event_id", repaired(F.col("text")).alias("fixed"))


_ASKED = ["geospatial", "Type Analyzer", "TERMINATE", "narrative", "nobody", "validation", "temporal_analyzer"]
_MEANT = ["geo_analyzer", "type_analyzer", "terminate", "path_generator", None, "validator", "temporal_analyzer"]
_BODY = "'{\"agent\": \"' || CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_ASKED)) + " END || '\", \"task\": \"t' || event_id || '\"}'"
_REPLY = f"CASE event_id % 4 WHEN 0 THEN {_BODY} WHEN 1 THEN 'Sure:\\n```json\\n' || {_BODY} || '\\n```' WHEN 2 THEN '```\\n' || {_BODY} || '\\n``` ok' ELSE 'no json here ' || event_id END"


def n20_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What replies, fenced or not, decide: the agent, the task, and whether they could be read."""
    return replies.decisions(table(spark, d, "events").select("event_id", F.expr(_REPLY).alias("reply")), "reply").drop("reply")


def j6_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Customers as addresses, nations as cities; some have no city, and one city no label."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    wanted = c.select(F.concat(F.lit("a/"), "c_custkey").alias("address_uri"))
    labels = c.where("c_mktsegment != 'BUILDING'").select(F.concat(F.lit("a/"), "c_custkey").alias("uri"), F.concat("c_name", F.lit(", Bari (BA)")).alias("label"))
    cities = c.where("c_nationkey < 20").select(F.concat(F.lit("a/"), "c_custkey").alias("address_uri"), F.concat(F.lit("c/"), "c_nationkey").alias("city_uri"))
    names = n.where("n_nationkey != 3").select(F.concat(F.lit("c/"), "n_nationkey").alias("uri"), F.col("n_name").alias("label"))
    return enrich.address_batch(wanted, labels.unionByName(names), cities)


def _relations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history_relations").where("confidence >= 0.70")
    return rows.groupBy(F.col("relation_id").alias("item"), F.col("relation_type").alias("kind")).agg(F.min(F.struct(uri_key(F.col("source_uri")).alias("a"), uri_key(F.col("target_uri")).alias("b"))).alias("r")).select("item", "kind", "r.*")


def m11_relation_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first relations of each type."""
    return contexts.relation_lines(_relations(spark, d))


def m11_path_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first paths with their first stops."""
    rows = table(spark, d, "history_paths").where("confidence >= 0.70").groupBy(F.col("path_id").alias("item")).agg(F.min(F.struct("theme", "path_type", F.transform("stop_uris", uri_key).alias("stops"))).alias("r")).select("item", "r.*")
    return contexts.path_lines(rows)


def m11_generic_lines(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of all that is known."""
    clusters, relations, paths = (table(spark, d, f"history_{t}") for t in ("clusters", "relations", "paths"))
    parts = [(clusters, "cluster_id", "cluster_type", "clusters"), (relations, "relation_id", "relation_type", "relations"), (paths, "path_id", "path_type", "paths")]
    return contexts.number_lines([(rows.select(F.col(i).alias("item"), F.col(k).alias("kind")), name) for rows, i, k, name in parts])


def path_cluster_context(spark: SparkSession, d: str) -> DataFrame:
    """The clusters that paths are made from, with their first members."""
    rows = table(spark, d, "history_clusters").groupBy("cluster_id").agg(F.min(F.struct("cluster_type", "label", F.transform("member_uris", uri_key).alias("members"))).alias("r"))
    return contexts.cluster_context(rows.select("cluster_id", "r.*"))


def k10_export(spark: SparkSession, d: str) -> DataFrame:
    """The history as JSON rows by part."""
    return contexts.export(*(table(spark, d, f"history_{t}").distinct() for t in ("clusters", "relations", "paths")))


QUERIES = {
    "n19_cut_replies": n19_cut_replies, "n20_decisions": n20_decisions, "j6_addresses": j6_addresses, "m11_relation_lines": m11_relation_lines, "m11_path_lines": m11_path_lines,
    "m11_generic_lines": m11_generic_lines, "path_cluster_context": path_cluster_context, "k10_export": k10_export,
}

_KEYS = f"list_transform({{}}, lambda x: {sql_key('x')})"
_MEANS = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {f'{chr(39)}{a}{chr(39)}' if a else 'NULL'}" for k, a in enumerate(_MEANT)) + " END"
SQL = {
    "n19_cut_replies": f"SELECT event_id, {_case(1)} fixed FROM events",
    "n20_decisions": f"SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN {_MEANS} END agent, CASE WHEN event_id % 4 <> 3 THEN 't' || event_id END task, CASE WHEN event_id % 4 = 3 THEN 'unreadable' WHEN event_id % 7 = 4 THEN 'unknown agent' WHEN event_id % 7 = 2 THEN 'end' ELSE 'task' END outcome FROM events",
    "j6_addresses": "SELECT 'a/' || c_custkey address_uri, c_name || ', Bari (BA)' address_full, CASE WHEN c_nationkey < 20 AND n_nationkey <> 3 THEN n_name END municipality FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'BUILDING'",
    "m11_relation_lines": f"""WITH r0 AS (SELECT relation_id item, relation_type kind, {sql_key('source_uri')} a, {sql_key('target_uri')} b FROM history_relations WHERE confidence >= 0.70),
r1 AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY item, kind ORDER BY a NULLS FIRST, b NULLS FIRST) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY item) k, count(*) OVER (PARTITION BY kind) total FROM r1)
SELECT kind, k::int k, '- ' || coalesce(a, '') || CASE WHEN kind = 'nearTo' THEN ' → ' ELSE ' ↔ ' END || coalesce(b, '') line, greatest(total - 20, 0) more FROM r WHERE k <= 20""",
    "m11_path_lines": f"""WITH p0 AS (SELECT path_id item, theme, path_type, {_KEYS.format('stop_uris')} stops FROM history_paths WHERE confidence >= 0.70),
p1 AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY theme NULLS FIRST, path_type NULLS FIRST, stops NULLS FIRST) = 1), p AS (SELECT *, row_number() OVER (ORDER BY item) k, count(*) OVER () total FROM p1)
SELECT k::int k, '- ' || coalesce(theme, '') || ' (' || coalesce(path_type, '') || '): ' || coalesce(array_to_string(list_filter(stops[1:4], lambda x: x IS NOT NULL), ' → '), '') || CASE WHEN len(stops) > 4 THEN ' +' || (len(stops) - 4)::varchar || ' more' ELSE '' END line, greatest(total - 5, 0) more FROM p WHERE k <= 5""",
    "m11_generic_lines": "SELECT 'clusters' part, cluster_type AS name, '  - ' || cluster_type || ': ' || count(DISTINCT cluster_id)::varchar || ' clusters' line FROM history_clusters WHERE cluster_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'relations', relation_type, '  - ' || relation_type || ': ' || count(DISTINCT relation_id)::varchar || ' relations' FROM history_relations WHERE relation_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'paths', path_type, '  - ' || path_type || ': ' || count(DISTINCT path_id)::varchar || ' paths' FROM history_paths WHERE path_type IS NOT NULL GROUP BY 2",
    "path_cluster_context": f"""WITH c0 AS (SELECT cluster_id, cluster_type, label, {_KEYS.format('member_uris')} members FROM history_clusters), c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY cluster_type NULLS FIRST, label NULLS FIRST, members NULLS FIRST) = 1)
SELECT cluster_id, cluster_type, label, coalesce(len(members), 0)::int size, coalesce(array_to_string(list_filter(members[1:5], lambda x: x IS NOT NULL), ', '), '') first_members FROM c""",
}
