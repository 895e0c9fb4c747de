"""Features, path stops, contexts, vectors and the remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.json_repair import repaired
from ..functions.uris import uri_key
from ..functions.vector import cosine
from ..operators import features, ratelimit
from ..sources.tables import table
from .base import ENTITIES, entities, sql_key

_LISTS = {"architectural": "architectural_features", "contextual": "shared_features"}


def y10_features(spark: SparkSession, d: str) -> DataFrame:
    """Y10 over the feature lists of the typological clusters, for each site that they name."""
    rows = table(spark, d, "typological_clusters").select(*_LISTS.values(), F.explode("subject_uris").alias("u"))
    parts = [rows.select(F.lit(kind).alias("category"), F.explode(column).alias("label"), uri_key(F.col("u")).alias("entity")) for kind, column in _LISTS.items()]
    total = entities(spark, d).count()
    return features.materialized_features(parts[0].unionByName(parts[1]), total)


_NORMAL = "trim(regexp_replace(regexp_replace(lower(trim(label)), '[_-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_Y10 = "WITH raw AS (" + " UNION ALL ".join(f"SELECT '{k}' category, label, {sql_key('u')} entity FROM (SELECT u, unnest({c}) label FROM (SELECT {c}, unnest(subject_uris) u FROM typological_clusters))" for k, c in _LISTS.items()) + f""" ),
own AS (SELECT DISTINCT category, CASE {_NORMAL} WHEN 'periurban' THEN 'peri urban' WHEN 'piedritti' THEN 'piedritto' ELSE {_NORMAL} END feature, entity FROM raw WHERE entity IS NOT NULL AND {_NORMAL} <> ''),
cnt AS (SELECT category, feature, count(*) n FROM own GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT category, feature, entity, n, round(greatest(0.30, least(0.95, 0.70 + least(0.15, 0.30 * (n::double / (SELECT count(DISTINCT identifier) FROM sites))) + CASE WHEN category = 'architectural' THEN 0.05 ELSE 0.0 END)), 2) confidence FROM own JOIN cnt USING (category, feature)"""


def path_stops(spark: SparkSession, d: str) -> DataFrame:
    """The stops of the stored paths, long paths cut to ten stops."""
    rows = table(spark, d, "history_paths").select("path_id", F.transform("stop_uris", uri_key).alias("stops")).groupBy("path_id").agg(F.min("stops").alias("stops"))
    return features.path_stops(rows, entities(spark, d).select("id", "name"))


_STOPS = f"""WITH {ENTITIES}, p AS (SELECT path_id, min(list_transform(stop_uris, lambda x: {sql_key('x')})) s FROM history_paths GROUP BY 1), c AS (SELECT path_id, CASE WHEN len(s) > 15 THEN s[1:10] ELSE s END s FROM p),
r AS (SELECT path_id, unnest(s) member, generate_subscripts(s, 1) i FROM c), o AS (SELECT path_id, member, row_number() OVER (PARTITION BY path_id ORDER BY i) k FROM r WHERE member IS NOT NULL)
SELECT path_id, 'stop_' || path_id || '_' || k::varchar stop_id, k::int stop_order, member, coalesce(name, member) AS label FROM o LEFT JOIN entities ON id = member"""


def g8_context(spark: SparkSession, d: str) -> DataFrame:
    return features.site_context(entities(spark, d))


def _cut(column: str, n: int) -> str:
    return f"CASE WHEN length({column}) > {n} THEN substr({column}, 1, {n}) || '...' ELSE {column} END"


def y5_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector and the next one."""
    v = table(spark, d, "embeddings")
    a, b = v.select("vec_id", F.col("embedding").alias("x")), v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


def l3_backoff(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 8
    return table(spark, d, "events").select("event_id", F.round(ratelimit.backoff(2.0, n, (F.col("event_id") % 5) / 4), 6).alias("seconds"))


def l5_usage(spark: SparkSession, d: str) -> DataFrame:
    """Requests by day, the busiest minute, and what is left of 400 a day."""
    ts = F.col("ts").cast("timestamp")
    minutes = table(spark, d, "events").groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_trunc("minute", ts).alias("m")).agg(F.count("*").alias("n"))
    return minutes.groupBy("day").agg(F.sum("n").alias("requests"), F.max("n").alias("busiest_minute")).withColumn("left", F.greatest(F.lit(0), 400 - F.col("requests")))


def n19_repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Event properties cut off and repaired, and whether they parse."""
    rows = table(spark, d, "events").select("event_id", repaired(F.concat(F.lit("["), F.col("props"), F.lit(", {\"cut"))).alias("fixed"))
    return rows.select("event_id", "fixed", F.from_json("fixed", "array<map<string,string>>").isNotNull().alias("parses"))


QUERIES = {
    "y10_features": y10_features, "path_stops": path_stops, "g8_context": g8_context, "y5_cosine": y5_cosine, "l3_backoff": l3_backoff, "l5_usage": l5_usage, "n19_repaired_json": n19_repaired_json,
}
SQL = {
    "y10_features": _Y10,
    "path_stops": _STOPS,
    "g8_context": f"WITH {ENTITIES} SELECT id, name, region, period_label period, {_cut('description', 200)} description, {_cut('historical_info', 150)} history FROM entities",
    "y5_cosine": "SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)))), 6) similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "l3_backoff": "SELECT event_id, round(least(60.0, 2.0 * pow(2.0, event_id % 8)) * (1 + 0.5 * ((event_id % 5) / 4.0)), 6) AS \"seconds\" FROM events",
    "l5_usage": "WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, date_trunc('minute', ts) mi, count(*) n FROM events GROUP BY 1, 2) SELECT day, sum(n)::bigint requests, max(n) busiest_minute, greatest(0, 400 - sum(n))::bigint AS \"left\" FROM m GROUP BY day",
    "n19_repaired_json": "SELECT event_id, '[' || props || ']' fixed, true parses FROM events",
}
