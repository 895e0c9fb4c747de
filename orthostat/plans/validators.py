"""Validators over the stored clusters, relations and paths, taken as proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import confidence
from ..functions.period import STANDARD_RANGES, overlap_score, normalized_period
from ..functions.text import features_in
from ..functions.uris import uri_key
from ..operators import validation
from ..sources.tables import table
from .base import ENTITIES, entities, sql_haversine, sql_key, sql_valid
from .scalar import SQL_TIER, _WORDS, _sql_normal, sql_cluster, sql_hybrid, sql_path, sql_relation

#: The stored clusters are spread over the whole country, so that the queries allow such radii.
RADIUS_KM, NEAR_KM, PATH_KM = 300.0, 300.0, 2000.0


def proposals(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """(cluster_id, member) of each listed member of the stored clusters; repeated rows of a cluster count once."""
    rows = table(spark, d, "history_clusters")
    rows = rows.where(F.col("cluster_type") == kind) if kind else rows
    return rows.select("cluster_id", "member_uris").distinct().select("cluster_id", F.explode("member_uris").alias("u")).select("cluster_id", uri_key(F.col("u")).alias("member")).where("member is not null")


def sql_proposals(kind: str | None = None) -> str:
    where = f"WHERE cluster_type = '{kind}'" if kind else ""
    return f"prop AS (SELECT cluster_id, member FROM (SELECT cluster_id, {sql_key('u')} member FROM (SELECT cluster_id, unnest(member_uris) u FROM (SELECT DISTINCT cluster_id, member_uris FROM history_clusters {where}))) WHERE member IS NOT NULL)"


def relations(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(relation_id, source, target, stated) of the distinct stored relations of a type."""
    rows = table(spark, d, "history_relations").where(F.col("relation_type") == kind)
    return rows.select("relation_id", uri_key(F.col("source_uri")).alias("source"), uri_key(F.col("target_uri")).alias("target"), F.col("confidence").alias("stated")).distinct()


def sql_relations(kind: str) -> str:
    return f"rel AS (SELECT DISTINCT relation_id, {sql_key('source_uri')} source, {sql_key('target_uri')} target, confidence stated FROM history_relations WHERE relation_type = '{kind}')"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def g2_geographic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validation.geographic_clusters(proposals(spark, d, "geographic"), entities(spark, d), RADIUS_KM), "centroid_lat", "centroid_lon", "radius_km", "score")


_G2 = f"""{ENTITIES}, {sql_proposals('geographic')},
mem AS (SELECT p.cluster_id, e.id, e.lat, e.lon, {sql_valid('e.lat', 'e.lon')} ok FROM prop p LEFT JOIN entities e ON e.id = p.member),
cnt AS (SELECT cluster_id, count(*) proposed, count(*) FILTER (ok) valid_members, count(*) FILTER (id IS NULL) missing, count(*) FILTER (id IS NOT NULL AND NOT ok) unlocated, avg(lat) FILTER (ok) clat, avg(lon) FILTER (ok) clon FROM mem GROUP BY 1),
far AS (SELECT m.cluster_id, max({sql_haversine('c.clat', 'c.clon', 'm.lat', 'm.lon')}) radius FROM mem m JOIN cnt c USING (cluster_id) WHERE ok AND valid_members >= 2 GROUP BY 1),
g2 AS (SELECT *, CASE WHEN valid_members < 2 THEN 'too few members' WHEN radius > {RADIUS_KM} THEN 'radius exceeds maximum' END reason FROM cnt LEFT JOIN far USING (cluster_id)),
g2s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0.0 WHEN radius < 5 THEN 1.0 ELSE 1.0 - 0.5 * (radius - 5.0) / ({RADIUS_KM} - 5.0) END score FROM g2)"""


def g5_scored_geographic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Accepted clusters with confidence (by the proposed members) and tier."""
    valid = validation.geographic_clusters(proposals(spark, d, "geographic"), entities(spark, d), RADIUS_KM).where("is_valid")
    stated = table(spark, d, "history_clusters").select("cluster_id", F.coalesce("confidence", F.lit(0.0)).alias("stated")).distinct()
    score = confidence.cluster(F.col("stated"), F.col("score"), F.col("proposed"))
    return valid.join(stated, "cluster_id").select("cluster_id", F.col("valid_members").alias("site_count"), F.round(score, 6).alias("confidence"), confidence.tier(F.round(score, 6)).alias("tier"))


def g3_near_relations(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validation.near_relations(relations(spark, d, "nearTo"), entities(spark, d), NEAR_KM), "distance_km", "score", "strength").drop("stated")


_G3 = f"""{ENTITIES}, {sql_relations('nearTo')},
ends AS (SELECT r.*, a.id ka, b.id kb, {sql_valid('a.lat', 'a.lon')} oka, {sql_valid('b.lat', 'b.lon')} okb, CASE WHEN {sql_valid('a.lat', 'a.lon')} AND {sql_valid('b.lat', 'b.lon')} THEN {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} END km FROM rel r LEFT JOIN entities a ON a.id = r.source LEFT JOIN entities b ON b.id = r.target),
g3 AS (SELECT *, CASE WHEN ka IS NULL THEN 'source not found' WHEN kb IS NULL THEN 'target not found' WHEN NOT oka THEN 'source without coordinates' WHEN NOT okb THEN 'target without coordinates' WHEN km > {NEAR_KM} THEN 'too far apart' END reason FROM ends),
g3s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0.0 WHEN km < 5 THEN 1.0 ELSE 1.0 - 0.5 * (km - 5.0) / ({NEAR_KM} - 5.0) END score, CASE WHEN km < {NEAR_KM} THEN 1 - km / {NEAR_KM} WHEN km IS NOT NULL THEN 0.0 END strength FROM g3)"""


def g6_scored_near_relations(spark: SparkSession, d: str) -> DataFrame:
    """Accepted near relations with label, value and confidence."""
    sites = entities(spark, d)
    valid = validation.near_relations(relations(spark, d, "nearTo"), sites, NEAR_KM).where("is_valid")
    names = sites.select("id", "name")
    both = valid.join(names.select(F.col("id").alias("source"), F.col("name").alias("na")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("nb")), "target")
    score = F.round(confidence.relation(F.col("stated"), F.col("score"), F.col("strength")), 6)
    return both.select("relation_id", F.concat("na", F.lit(" near to "), "nb").alias("label"), F.round("distance_km", 6).alias("relation_value"), score.alias("confidence"), confidence.tier(score).alias("tier"))


def t2_chronological_clusters(spark: SparkSession, d: str) -> DataFrame:
    return validation.chronological_clusters(proposals(spark, d, "chronological"), entities(spark, d))


_T2 = f"""{ENTITIES}, {sql_proposals('chronological')},
t2 AS (SELECT cluster_id, count(*) proposed, count(*) FILTER (coalesce(period_label, '') <> '') dated, count(DISTINCT nullif(lower(period_label), '')) periods FROM prop p LEFT JOIN entities e ON e.id = p.member GROUP BY 1)
SELECT cluster_id, proposed, dated, periods, dated >= 2 is_valid, CAST(CASE WHEN dated < 2 THEN 0.0 WHEN periods = 1 THEN 1.0 WHEN periods = 2 THEN 0.7 WHEN periods <= dated / 2.0 THEN 0.5 ELSE 0.3 END AS double) score, CASE WHEN dated < 2 THEN 'too few dated members' END reason FROM t2"""


def t3_period_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the normalised periods of related sites."""
    sites = entities(spark, d).withColumn("p", normalized_period(F.col("period_label"))).select("id", "p.start_year", "p.end_year")
    rows = validation._both_ends(relations(spark, d, "contemporaryWith"), sites, ["start_year", "end_year"])
    return rows.select("relation_id", F.round(overlap_score(F.col("start_year_a"), F.col("end_year_a"), F.col("start_year_b"), F.col("end_year_b")), 6).alias("overlap"))


_RANGE = "CASE " + " ".join(f"WHEN contains(la, '{n}') AND contains(lb, '{n}') THEN '{n}'" for n in STANDARD_RANGES) + " END"


def t4_contemporary_relations(spark: SparkSession, d: str) -> DataFrame:
    return validation.contemporary_relations(relations(spark, d, "contemporaryWith"), entities(spark, d)).drop("stated")


_T4 = f"""{ENTITIES}, {sql_relations('contemporaryWith')},
ends AS (SELECT r.*, a.id ka, b.id kb, lower(a.period_label) la, lower(b.period_label) lb FROM rel r LEFT JOIN entities a ON a.id = r.source LEFT JOIN entities b ON b.id = r.target),
t4 AS (SELECT *, coalesce(la, '') <> '' AND coalesce(lb, '') <> '' AS two, CASE WHEN coalesce(la, '') <> '' AND coalesce(lb, '') <> '' AND la <> lb THEN {_RANGE} END m FROM ends),
t4r AS (SELECT *, CASE WHEN ka IS NULL THEN 'source not found' WHEN kb IS NULL THEN 'target not found' WHEN NOT two THEN 'missing period' WHEN la <> lb AND m IS NULL THEN 'no common period' END reason FROM t4)
SELECT relation_id, source, target, m matched_period, reason IS NULL is_valid, CAST(CASE WHEN ka IS NULL OR kb IS NULL OR NOT two THEN 0.0 WHEN la = lb THEN 1.0 WHEN m IS NOT NULL THEN 0.8 ELSE 0.3 END AS double) score, reason FROM t4r"""


def site_features(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (entity, feature): the features of clusters that list a site, else words of its text."""
    rows = table(spark, d, "typological_clusters")
    listed = rows.select(F.explode("subject_uris").alias("u"), "shared_features").select(uri_key(F.col("u")).alias("entity"), F.explode("shared_features").alias("feature")).where("entity is not null and trim(feature) != ''").distinct()
    sites = entities(spark, d)
    found = sites.join(listed.select(F.col("entity").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("entity"), F.explode(features_in(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("historical_info", F.lit(""))))).alias("feature"))
    return listed.unionByName(found).distinct()


_FEATURES = f"""listed AS (SELECT DISTINCT entity, feature FROM (SELECT {sql_key('u')} entity, unnest(shared_features) feature FROM (SELECT unnest(subject_uris) u, shared_features FROM typological_clusters)) WHERE entity IS NOT NULL AND trim(feature) <> ''),
feats AS (SELECT * FROM listed UNION SELECT id, feature FROM (SELECT id, unnest({_WORDS.replace('lower(text)', "lower(coalesce(description, '') || ' ' || coalesce(historical_info, ''))")}) feature FROM entities WHERE id NOT IN (SELECT entity FROM listed)))"""


def y3_site_features(spark: SparkSession, d: str) -> DataFrame:
    return site_features(spark, d)


def y2_typological_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validation.typological_clusters(proposals(spark, d, "typological"), site_features(spark, d)), "coverage", "score")


_Y2 = f"""{ENTITIES}, {_FEATURES}, {sql_proposals('typological')},
n AS (SELECT cluster_id, count(*) n FROM prop WHERE member IN (SELECT entity FROM feats) GROUP BY 1),
k AS (SELECT cluster_id, feature, count(*) k FROM prop JOIN feats ON entity = member GROUP BY 1, 2),
sh AS (SELECT cluster_id, count(*) shared, sum(k) covered FROM k JOIN n USING (cluster_id) WHERE k >= greatest(2, floor(n * 0.6 + 1e-9)) GROUP BY 1),
y2 AS (SELECT cluster_id, coalesce(n, 0) n, coalesce(shared, 0) shared, CASE WHEN coalesce(shared, 0) > 0 THEN covered::double / (shared * n) ELSE 0.0 END coverage FROM (SELECT DISTINCT cluster_id FROM prop) LEFT JOIN n USING (cluster_id) LEFT JOIN sh USING (cluster_id))
SELECT cluster_id, n with_features, shared, round(coverage, 6) coverage, n >= 2 AND shared >= 1 is_valid, round(CASE WHEN n < 2 THEN 0.0 WHEN shared < 1 THEN 0.3 ELSE least(1.0, least(1.0, shared / 5.0) + 0.2 * coverage) END, 6) score, CASE WHEN n < 2 THEN 'too few members with features' WHEN shared < 1 THEN 'too few shared features' END reason FROM y2"""


def y7_similar_relations(spark: SparkSession, d: str) -> DataFrame:
    """Similar relations by vectors; sites take the vector of their number."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.max("vec_id") + 1).first()[0]
    place = F.pmod(F.substring("id", -4, 4).cast("long"), F.lit(n))
    sites = entities(spark, d).select("id", place.alias("vec_id")).join(vectors, "vec_id").select("id", F.col("embedding").alias("vector"))
    return _rounded(validation.similar_relations(relations(spark, d, "similarTo").where("stated is not null"), sites, "stated", least=0.5), "cosine", "score").drop("stated")


def stops(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history_paths").select("path_id", "stop_uris").distinct()
    return rows.select("path_id", F.posexplode("stop_uris").alias("ord", "u")).select("path_id", "ord", uri_key(F.col("u")).alias("member")).where("member is not null")


_STOPS = f"stops AS (SELECT path_id, ord, member FROM (SELECT path_id, ord - 1 ord, {sql_key('u')} member FROM (SELECT path_id, unnest(stop_uris) u, generate_subscripts(stop_uris, 1) ord FROM (SELECT DISTINCT path_id, stop_uris FROM history_paths))) WHERE member IS NOT NULL)"


def p_thematic_paths(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "history_paths").select("path_id", "path_type").distinct()
    return _rounded(validation.thematic_paths(stops(spark, d), entities(spark, d), kinds, PATH_KM), "total_km", "score")


_P1 = f"""{ENTITIES}, {_STOPS},
known AS (SELECT path_id, ord, member, lat, lon, {sql_valid('lat', 'lon')} ok FROM stops JOIN entities ON id = member),
legs0 AS (SELECT *, lead(lat) OVER w nlat, lead(lon) OVER w nlon FROM known WINDOW w AS (PARTITION BY path_id ORDER BY ord, member)),
legs AS (SELECT path_id, count(*) known_stops, bool_and(ok) located, sum({sql_haversine('lat', 'lon', 'nlat', 'nlon')}) total, avg({sql_haversine('lat', 'lon', 'nlat', 'nlon')}) mean_leg, stddev_pop({sql_haversine('lat', 'lon', 'nlat', 'nlon')}) sd FROM legs0 GROUP BY 1),
p0 AS (SELECT k.path_id, path_type, coalesce(c.stops, 0) stops, coalesce(known_stops, 0) known_stops, coalesce(located, false) located, CASE WHEN coalesce(located, false) AND known_stops >= 2 THEN total END total_km, mean_leg, sd FROM (SELECT DISTINCT path_id, path_type FROM history_paths) k LEFT JOIN (SELECT path_id, count(*) stops FROM stops GROUP BY 1) c USING (path_id) LEFT JOIN legs USING (path_id)),
p1 AS (SELECT *, lower(path_type) = 'geographic' geographic, CASE WHEN stops < 2 THEN 'too few stops' WHEN known_stops < 2 THEN 'too few known stops' WHEN lower(path_type) = 'geographic' AND NOT located THEN 'coordinates missing' WHEN lower(path_type) = 'geographic' AND total_km > {PATH_KM} THEN 'too long' END reason FROM p0),
p1s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0.0 WHEN geographic THEN (greatest(0.5, 1 - CASE WHEN mean_leg > 0 THEN sd / mean_leg ELSE 0.0 END / 2) + 1 - 0.5 * total_km / {PATH_KM}) / 2 ELSE round(0.8 + least(0.1, 0.02 * known_stops) - CASE WHEN located THEN 0.0 ELSE 0.05 END, 2) END score FROM p1)"""


def p_scored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths are scored and kept, also those that validation rejects."""
    kinds = table(spark, d, "history_paths").select("path_id", "path_type").distinct()
    scored = validation.thematic_paths(stops(spark, d), entities(spark, d), kinds, PATH_KM)
    stated = table(spark, d, "history_paths").select("path_id", F.coalesce("confidence", F.lit(0.0)).alias("stated")).distinct()
    score = F.round(confidence.path(F.col("stated"), F.col("score"), F.col("stops"), F.lit(None).cast("double")), 6)
    return scored.join(stated, "path_id").select("path_id", "is_valid", score.alias("confidence"), confidence.tier(score).alias("tier"))


QUERIES = {
    "g2_geographic_clusters": g2_geographic_clusters, "g3_near_relations": g3_near_relations, "g5_scored_geographic_clusters": g5_scored_geographic_clusters,
    "g6_scored_near_relations": g6_scored_near_relations, "t2_chronological_clusters": t2_chronological_clusters, "t3_period_overlap": t3_period_overlap,
    "t4_contemporary_relations": t4_contemporary_relations, "y2_typological_clusters": y2_typological_clusters, "y3_site_features": y3_site_features,
    "y7_similar_relations": y7_similar_relations, "path_validation": p_thematic_paths, "path_scores": p_scored_paths,
}
SQL = {
    "g2_geographic_clusters": f"WITH {_G2} SELECT cluster_id, proposed, valid_members, missing, unlocated, round(clat, 6) centroid_lat, round(clon, 6) centroid_lon, round(radius, 6) radius_km, reason IS NULL is_valid, round(score, 6) score, reason FROM g2s",
    "g5_scored_geographic_clusters": f"WITH {_G2}, st AS (SELECT DISTINCT cluster_id, coalesce(confidence, 0.0) stated FROM history_clusters), sc AS (SELECT cluster_id, valid_members site_count, round({sql_cluster('stated', 'score', 'proposed')}, 6) confidence FROM g2s JOIN st USING (cluster_id) WHERE reason IS NULL) SELECT *, {SQL_TIER.format('confidence')} tier FROM sc",
    "g3_near_relations": f"WITH {_G3} SELECT relation_id, source, target, round(km, 6) distance_km, reason IS NULL is_valid, round(score, 6) score, reason, round(strength, 6) strength FROM g3s",
    "g6_scored_near_relations": f"WITH {_G3}, sc AS (SELECT relation_id, a.name || ' near to ' || b.name AS label, round(km, 6) relation_value, round({sql_relation('stated', 'score', 'strength')}, 6) confidence FROM g3s JOIN entities a ON a.id = source JOIN entities b ON b.id = target WHERE reason IS NULL) SELECT *, {SQL_TIER.format('confidence')} tier FROM sc",
    "t2_chronological_clusters": f"WITH {_T2}",
    "t3_period_overlap": f"""WITH {ENTITIES}, {sql_relations('contemporaryWith')}, per AS (SELECT id, {_sql_normal('period_label', 1)} s, {_sql_normal('period_label', 2)} e FROM entities),
o AS (SELECT relation_id, a.s - 100 s1, a.e + 100 e1, b.s - 100 s2, b.e + 100 e2 FROM rel LEFT JOIN per a ON a.id = source LEFT JOIN per b ON b.id = target)
SELECT relation_id, round(CASE WHEN NOT coalesce(s1 <= e2 AND s2 <= e1, false) THEN 0.0 WHEN least(e1 - s1, e2 - s2) <= 0 THEN 0.5 ELSE least(1.0, (least(e1, e2) - greatest(s1, s2))::double / least(e1 - s1, e2 - s2)) END, 6) overlap FROM o""",
    "t4_contemporary_relations": f"WITH {_T4}",
    "y2_typological_clusters": f"WITH {_Y2}",
    "y3_site_features": f"WITH {ENTITIES}, {_FEATURES} SELECT entity, feature FROM feats",
    "y7_similar_relations": f"""WITH {ENTITIES}, {sql_relations('similarTo')}, ids AS (SELECT id, CAST(right(id, 4) AS bigint) % n vec_id FROM entities, (SELECT max(vec_id) + 1 n FROM embeddings)),
vec AS (SELECT id, list_transform(embedding, lambda x: x::double) v FROM ids JOIN embeddings USING (vec_id)),
y7 AS (SELECT r.*, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN greatest(0.0, least(1.0, list_cosine_similarity(a.v, b.v))) END cosine FROM rel r LEFT JOIN vec a ON a.id = source LEFT JOIN vec b ON b.id = target WHERE stated IS NOT NULL)
SELECT relation_id, source, target, round(cosine, 6) cosine, round(CASE WHEN cosine IS NOT NULL THEN 0.7 * stated + 0.3 * cosine ELSE 0.0 END, 6) score, cosine IS NOT NULL AND 0.7 * stated + 0.3 * cosine >= 0.5 is_valid FROM y7""",
    "path_validation": f"WITH {_P1} SELECT path_id, path_type, stops, known_stops, round(total_km, 6) total_km, reason IS NULL is_valid, round(score, 6) score, reason FROM p1s",
    "path_scores": f"WITH {_P1}, st AS (SELECT DISTINCT path_id, coalesce(confidence, 0.0) stated FROM history_paths), sc AS (SELECT path_id, reason IS NULL is_valid, round({sql_path('stated', 'score', 'stops', 'NULL::double')}, 6) confidence FROM p1s JOIN st USING (path_id)) SELECT *, {SQL_TIER.format('confidence')} tier FROM sc",
}
