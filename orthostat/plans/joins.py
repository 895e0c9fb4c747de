"""Enrichment joins, near pairs, similarity joins and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import confidence, text
from ..functions.period import normalized_period
from ..functions.uris import uri_key
from ..operators import enrich, fallback, similarity
from ..operators.spatial import near_points
from ..operators.validation import ramp
from ..sources.tables import table
from .base import ENTITIES, entities, sql_haversine, sql_key, sql_period, sql_valid
from .scalar import SQL_TIER, _MUNICIPALITY, _sql_normal, sql_relation
from .validators import _FEATURES, proposals, site_features, sql_proposals, stops

NEAR_KM = 30.0


def _located(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("lat is not null and lon is not null")


def j9_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sites at most 30 km apart, by the strip sweep; sites at one place are expanded."""
    return near_points(_located(spark, d), NEAR_KM, key="id").withColumn("distance_km", F.round("distance_km", 6))


def j9_customer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J9 at a larger scale: sites laid out from the customers' numbers, many of them at one place."""
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.format_string("c%09d", n).alias("id"), (37 + (n * 37 % 400) / 100).alias("lat"), (8 + (n * 53 % 600) / 100).alias("lon"))
    return near_points(rows, NEAR_KM, key="id").withColumn("distance_km", F.round("distance_km", 5))


_J9 = f"{ENTITIES}, spots AS (SELECT id, lat, lon FROM entities WHERE {sql_valid('lat', 'lon')}), near AS (SELECT a.id a, b.id b, {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} km FROM spots a JOIN spots b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.28)"


def near_sites_scored(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: near pairs with score, confidence (a stated 0.9) and tier."""
    pairs = j9_near_pairs(spark, d)
    km = F.col("distance_km")
    strength = F.when(km < NEAR_KM, 1 - km / NEAR_KM).otherwise(0.0)
    score = F.round(confidence.relation(F.lit(0.9), ramp(km, NEAR_KM), strength), 6)
    return pairs.withColumn("confidence", score).withColumn("tier", confidence.tier(F.col("confidence")))


def j1_resolved_sites(spark: SparkSession, d: str) -> DataFrame:
    """Current records with points of their geometry, else the mean point of their municipality."""
    lat, lon = F.col("latitude"), F.col("longitude")
    sites = table(spark, d, "sites").where("identifier is not null")
    own = F.max(F.struct("updated_at", "record_id", "label", "geometry_uri", "address_uri", "dating_uri", "coverage"))
    rows = sites.groupBy("identifier").agg(own.alias("r")).select(F.col("identifier").alias("id"), uri_key(F.col("r.geometry_uri")).alias("geometry_key"), "r.address_uri", "r.dating_uri", text.municipality(F.col("r.coverage")).alias("municipality"))
    from ..functions.geo import valid_coordinates

    points = table(spark, d, "geometries").where(valid_coordinates(lat, lon)).groupBy(uri_key(F.col("geometry_uri")).alias("geometry_key")).agg(F.min("latitude").alias("g_lat"), F.min("longitude").alias("g_lon"))
    addresses = sites.where("address_uri is not null").groupBy("address_uri").agg(F.min("coverage").alias("address_full"), F.min(text.municipality(F.col("coverage"))).alias("a_municipality"))
    datings = sites.where("dating_uri is not null").groupBy("dating_uri").agg(F.min(text.period_in_label(F.col("label"))).alias("dating_label"))
    places = entities(spark, d).where("lat is not null").groupBy(F.lower(text.municipality(F.col("coverage"))).alias("name_lower")).agg(F.avg("lat").alias("p_lat"), F.avg("lon").alias("p_lon")).where("name_lower is not null")
    out = enrich.resolve_entities(rows, points, addresses, datings, places)
    return out.select("id", "municipality", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "address_full", "dating_label", "coordinate_source", "resolved")


_J1 = f"""{ENTITIES},
g AS (SELECT {sql_key('geometry_uri')} k, min(latitude) g_lat, min(longitude) g_lon FROM geometries WHERE {sql_valid('latitude', 'longitude')} GROUP BY 1),
ad AS (SELECT address_uri, min(coverage) address_full, min({_MUNICIPALITY}) am FROM sites WHERE identifier IS NOT NULL AND address_uri IS NOT NULL GROUP BY 1),
da AS (SELECT dating_uri, min({sql_period('label')}) dating_label FROM sites WHERE identifier IS NOT NULL AND dating_uri IS NOT NULL GROUP BY 1),
pl AS (SELECT lower({_MUNICIPALITY}) nl, avg(lat) p_lat, avg(lon) p_lon FROM entities WHERE lat IS NOT NULL GROUP BY 1),
r0 AS (SELECT identifier id, coalesce(CASE WHEN trim(am) <> '' THEN am END, {_MUNICIPALITY}) municipality, g_lat, g_lon, address_full, dating_label, g.k IS NOT NULL OR ad.address_uri IS NOT NULL OR da.dating_uri IS NOT NULL hit FROM cur LEFT JOIN g ON g.k = {sql_key('geometry_uri')} LEFT JOIN ad ON ad.address_uri = cur.address_uri LEFT JOIN da ON da.dating_uri = cur.dating_uri)
SELECT id, municipality, round(CASE WHEN g_lat IS NULL THEN p_lat ELSE g_lat END, 6) lat, round(CASE WHEN g_lat IS NULL THEN p_lon ELSE g_lon END, 6) lon, address_full, dating_label, CASE WHEN g_lat IS NOT NULL THEN 'geometry' WHEN nl IS NOT NULL THEN 'municipality' ELSE 'none' END coordinate_source, hit OR nl IS NOT NULL resolved FROM r0 LEFT JOIN pl ON nl = CASE WHEN g_lat IS NULL THEN lower(municipality) END"""


def j3_member_warnings(spark: SparkSession, d: str) -> DataFrame:
    return enrich.member_warnings(proposals(spark, d), entities(spark, d), "cluster_id").distinct()


def j5_geometry_batch(spark: SparkSession, d: str) -> DataFrame:
    """The requested geometries with their point, coordinates before WKT."""
    from ..operators.proximity import site_points

    wanted = table(spark, d, "sites").select(uri_key(F.col("geometry_uri")).alias("identifier")).where("identifier is not null").distinct()
    return site_points(wanted.withColumn("geometry_uri", F.col("identifier")), table(spark, d, "geometries")).select(F.col("key").alias("geometry"), "lat", "lon").where("lat is not null")


def j8_region_closure(spark: SparkSession, d: str) -> DataFrame:
    """Reachable classes over a hierarchy of nations under regions under the world."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return enrich.subclass_closure(edges.unionByName(r.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))), "child", "parent")


def j10_feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J10 between classes of sites with equal features."""
    pairs = similarity.feature_pairs(similarity.feature_classes(site_features(spark, d)))
    return pairs.select(F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"), "n_a", "n_b", "shared", F.round("similarity", 6).alias("similarity"))


_J10 = f"""{ENTITIES}, {_FEATURES}, sz AS (SELECT entity, count(*) n FROM feats GROUP BY 1 HAVING count(*) >= 2),
fo AS (SELECT f.entity, feature, n, load_order o FROM feats f JOIN sz USING (entity) JOIN entities ON id = f.entity),
pr AS (SELECT a.entity a, b.entity b, a.o oa, b.o ob, count(*) shared, a.n + b.n - count(*) u FROM fo a JOIN fo b ON a.feature = b.feature AND a.o < b.o GROUP BY a.entity, b.entity, a.n, b.n, a.o, b.o)"""
_CLASSES = f"""{ENTITIES}, {_FEATURES}, st AS (SELECT entity, list_sort(list(feature)) s FROM feats GROUP BY 1 HAVING count(*) >= 2), cl AS (SELECT s, count(*) n FROM st GROUP BY s), ex AS (SELECT s, n, unnest(s) f FROM cl),
cp AS (SELECT a.s a, b.s b, a.n n_a, b.n n_b, count(*) shared FROM ex a JOIN ex b ON a.f = b.f AND a.s < b.s GROUP BY 1, 2, 3, 4 UNION ALL SELECT s, s, n, n, len(s) FROM cl WHERE n > 1)"""


def y9_first_feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.first_feature_pairs(site_features(spark, d), entities(spark, d)).withColumn("similarity", F.round("similarity", 6))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("category"), F.format_string("v%06d", "vec_id").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def j11_vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.vector_pairs(_vectors(spark, d), 0.3).withColumn("cosine", F.round("cosine", 6))


_J11 = "v AS (SELECT label::varchar category, printf('v%06d', vec_id) label, list_transform(embedding, lambda x: x::double) vector FROM embeddings), pr AS (SELECT a.category, a.label a, b.label b, list_cosine_similarity(a.vector, b.vector) cosine FROM v a JOIN v b ON a.category = b.category AND a.label < b.label)"


def y11_merged_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels merged over similar vectors; a label's entities are counted by its number."""
    v = _vectors(spark, d)
    counts = v.select("category", "label", (F.substring("label", 2, 6).cast("int") % 7).alias("n"))
    return similarity.merge_labels(counts, similarity.vector_pairs(v, 0.35))


def g7_greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return fallback.greedy_clusters(_located(spark, d), 5.0)


def g7_dominant_regions(spark: SparkSession, d: str) -> DataFrame:
    """A14 on the stored clusters: the most frequent region among the members, ties by load order."""
    rows = proposals(spark, d, "geographic").join(entities(spark, d).select(F.col("id").alias("member"), F.coalesce("region", F.lit("Unknown")).alias("region"), "load_order"), "member")
    return fallback.dominant(rows, "cluster_id", "region", "load_order")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).withColumn("p", normalized_period(F.col("period_label"))).select("id", "load_order", "p.*")


def t5_period_clusters(spark: SparkSession, d: str) -> DataFrame:
    return fallback.period_clusters(_dated(spark, d))


def y8_category_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Y8 over the words of each site's texts."""
    return fallback.category_clusters(_text_features(spark, d), entities(spark, d))


def _text_features(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("historical_info", F.lit("")))
    return entities(spark, d).select(F.col("id").alias("entity"), F.explode(text.features_in(both)).alias("feature"))


def p5_cluster_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history_clusters").select("cluster_id", "member_uris").distinct().select("cluster_id", F.posexplode("member_uris").alias("ord", "u"))
    known = rows.select("cluster_id", "ord", uri_key(F.col("u")).alias("member")).join(entities(spark, d).select(F.col("id").alias("member")), "member")
    clusters = known.select("cluster_id").distinct().withColumn("rank", F.lit(0))
    return fallback.cluster_paths(known, clusters)


def p7_next_stops(spark: SparkSession, d: str) -> DataFrame:
    """Each stop with the next one of its path."""
    from pyspark.sql import Window

    order = Window.partitionBy("path_id").orderBy("ord", "member")
    rows = stops(spark, d).withColumn("next_member", F.lead("member").over(order))
    return rows.select("path_id", (F.col("ord") + 1).alias("stop_order"), "member", "next_member")


def a17_simulated_clusters(spark: SparkSession, d: str) -> DataFrame:
    return fallback.simulated_clusters(entities(spark, d))


def a17_simulated_relations(spark: SparkSession, d: str) -> DataFrame:
    return fallback.simulated_relations(entities(spark, d))


QUERIES = {
    "near_sites_scored": near_sites_scored, "j1_resolved_sites": j1_resolved_sites, "j3_member_warnings": j3_member_warnings, "j5_geometry_batch": j5_geometry_batch,
    "j8_region_closure": j8_region_closure, "j9_near_pairs": j9_near_pairs, "j9_customer_pairs": j9_customer_pairs, "j10_feature_pairs": j10_feature_pairs, "j11_vector_pairs": j11_vector_pairs,
    "y8_category_clusters": y8_category_clusters, "y9_first_feature_pairs": y9_first_feature_pairs, "y11_merged_labels": y11_merged_labels,
    "g7_greedy_clusters": g7_greedy_clusters, "a14_dominant_regions": g7_dominant_regions, "t5_period_clusters": t5_period_clusters,
    "cluster_paths": p5_cluster_paths, "next_stops": p7_next_stops, "a17_simulated_clusters": a17_simulated_clusters, "a17_simulated_relations": a17_simulated_relations,
}
_TEXTS = _FEATURES.split("UNION SELECT id, feature FROM ")[1].split(" WHERE id NOT IN")[0].strip("() \n")
_SIM = lambda kind, rel, value, conf: f"SELECT '{rel}' relation_type, id source, lead(id) OVER (PARTITION BY {value} ORDER BY load_order) target, {conf}::double confidence FROM entities WHERE {value} <> ''"
SQL = {
    "j9_customer_pairs": f"WITH q AS (SELECT printf('c%09d', c_custkey) id, 37 + (c_custkey * 37 % 400) / 100.0::double lat, 8 + (c_custkey * 53 % 600) / 100.0::double lon FROM customer), p AS (SELECT a.id a, b.id b, {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} km FROM q a JOIN q b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.28) SELECT a, b, round(km, 5) distance_km FROM p WHERE km <= {NEAR_KM}",
    "j9_near_pairs": f"WITH {_J9} SELECT a, b, round(km, 6) distance_km FROM near WHERE km <= {NEAR_KM}",
    "near_sites_scored": f"WITH {_J9}, r AS (SELECT a, b, round(km, 6) distance_km FROM near WHERE km <= {NEAR_KM}), s AS (SELECT *, round({sql_relation('0.9', f'(CASE WHEN distance_km < 5 THEN 1.0 ELSE 1.0 - 0.5 * (distance_km - 5.0) / ({NEAR_KM} - 5.0) END)', f'(CASE WHEN distance_km < {NEAR_KM} THEN 1 - distance_km / {NEAR_KM} ELSE 0.0 END)')}, 6) confidence FROM r) SELECT *, {SQL_TIER.format('confidence')} tier FROM s",
    "j1_resolved_sites": f"WITH {_J1}",
    "j3_member_warnings": f"WITH {ENTITIES}, {sql_proposals()} SELECT DISTINCT cluster_id, member, CASE WHEN id IS NULL THEN 'not found' ELSE 'invalid coordinates' END warning FROM prop LEFT JOIN entities ON id = member WHERE id IS NULL OR NOT {sql_valid('lat', 'lon')}",
    "j5_geometry_batch": f"WITH {ENTITIES} SELECT g geometry, lat, lon FROM geo WHERE g IN (SELECT {sql_key('geometry_uri')} FROM sites)",
    "j8_region_closure": "WITH RECURSIVE e AS (SELECT n_name c, r_name a FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region), t AS (SELECT c, a FROM e UNION SELECT c, c FROM e UNION SELECT a, a FROM e UNION SELECT t.c, e.a FROM t JOIN e ON e.c = t.a) SELECT DISTINCT c AS class, a AS ancestor FROM t",
    "j10_feature_pairs": f"WITH {_CLASSES} SELECT array_to_string(a, '|') a, array_to_string(b, '|') b, n_a, n_b, shared, round(shared::double / (len(a) + len(b) - shared), 6) similarity FROM cp WHERE shared::double / (len(a) + len(b) - shared) >= 0.3 - 1e-9",
    "y9_first_feature_pairs": f"WITH {_J10} SELECT a, b, shared, round(shared::double / u, 6) similarity FROM pr WHERE shared::double / u >= 0.3 - 1e-9 ORDER BY oa, ob LIMIT 20",
    "j11_vector_pairs": f"WITH {_J11} SELECT category, a, b, round(cosine, 6) cosine FROM pr WHERE cosine >= 0.3",
    "y11_merged_labels": f"WITH RECURSIVE {_J11}, ed AS (SELECT category, a x, b y FROM pr WHERE cosine >= 0.35 UNION SELECT category, b, a FROM pr WHERE cosine >= 0.35), reach AS (SELECT category, label x, label y FROM v UNION SELECT r.category, r.x, ed.y FROM reach r JOIN ed ON ed.category = r.category AND ed.x = r.y) SELECT category, x AS label, first(y ORDER BY CAST(substr(y, 2) AS int) % 7 DESC, y) canonical, CAST(substr(x, 2) AS int) % 7 n FROM reach GROUP BY category, x",
    "g7_greedy_clusters": f"WITH RECURSIVE {ENTITIES}, spots AS (SELECT id, lat, lon, load_order o FROM entities WHERE {sql_valid('lat', 'lon')}), ed AS (SELECT a.o x, b.o y FROM spots a JOIN spots b ON a.o < b.o AND abs(a.lat - b.lat) <= 0.05 AND {sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 5.0), reach AS (SELECT o x, o y FROM spots UNION SELECT reach.x, ed.y FROM reach JOIN ed ON ed.x = reach.y), lb AS (SELECT y, min(x) x FROM reach GROUP BY y) SELECT c.id AS cluster, m.id FROM lb JOIN spots c ON c.o = lb.x JOIN spots m ON m.o = lb.y WHERE lb.x IN (SELECT x FROM lb GROUP BY x HAVING count(*) >= 2)",
    "a14_dominant_regions": f"WITH {ENTITIES}, {sql_proposals('geographic')}, k AS (SELECT cluster_id, coalesce(region, 'Unknown') region, count(*) n, min(load_order) f FROM prop JOIN entities ON id = member GROUP BY 1, 2) SELECT cluster_id, region FROM k QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) = 1",
    "t5_period_clusters": f"WITH {ENTITIES}, q AS (SELECT {_sql_normal('period_label', 0)} period, {_sql_normal('period_label', 1)} s, {_sql_normal('period_label', 2)} e FROM entities) SELECT period, count(*) site_count, min(s) start_year, max(e) end_year, 0.5::double confidence FROM q WHERE period IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "y8_category_clusters": f"WITH {ENTITIES}, tf AS ({_TEXTS}), k AS (SELECT feature, id, row_number() OVER (PARTITION BY feature ORDER BY load_order, id) k, count(*) OVER (PARTITION BY feature) n FROM tf JOIN entities USING (id) WHERE feature LIKE 'cat:%') SELECT feature category, id entity, k::int k, 0.5::double confidence FROM k WHERE k <= 6 AND n >= 2",
    "cluster_paths": f"WITH {ENTITIES}, o AS (SELECT cluster_id, unnest(member_uris) u, generate_subscripts(member_uris, 1) ord FROM (SELECT DISTINCT cluster_id, member_uris FROM history_clusters)), m AS (SELECT cluster_id, ord, {sql_key('u')} member FROM o), kn AS (SELECT * FROM m WHERE member IN (SELECT id FROM entities)), f AS (SELECT DISTINCT cluster_id FROM kn ORDER BY 1 LIMIT 3), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord, member) stop_order FROM kn WHERE cluster_id IN (SELECT cluster_id FROM f)), s AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) n FROM r WHERE stop_order <= 10) SELECT 'path_' || cluster_id path_id, stop_order::int stop_order, member, 0.5::double * n duration_hours FROM s WHERE n >= 2",
    "next_stops": f"WITH st AS (SELECT path_id, ord, {sql_key('u')} member FROM (SELECT path_id, unnest(stop_uris) u, generate_subscripts(stop_uris, 1) ord FROM (SELECT DISTINCT path_id, stop_uris FROM history_paths))) SELECT path_id, ord::int stop_order, member, lead(member) OVER (PARTITION BY path_id ORDER BY ord, member) next_member FROM st WHERE member IS NOT NULL",
    "a17_simulated_clusters": f"WITH {ENTITIES} SELECT 'geographic' cluster_type, region AS label, count(*) site_count, 0.85::double confidence FROM entities WHERE region <> '' GROUP BY region HAVING count(*) >= 2 UNION ALL SELECT 'chronological', period_label, count(*), 0.80::double FROM entities WHERE period_label <> '' GROUP BY period_label HAVING count(*) >= 2",
    "a17_simulated_relations": f"WITH {ENTITIES}, r AS ({_SIM('', 'nearTo', 'region', 0.75)} UNION ALL {_SIM('', 'contemporaryWith', 'period_label', 0.72)}) SELECT * FROM r WHERE target IS NOT NULL",
}
