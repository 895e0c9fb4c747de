"""Triples of each kind of assertion with all its own properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.period import normalized_period
from ..functions.text import excerpt
from ..functions.uris import uri_key
from ..graph import mapping
from ..graph.ontology import DC, GEO, RDF, RDFS, WGS84
from ..operators import summaries
from ..sources.tables import table
from .base import ENTITIES, entities, sql_key
from .features import _STOPS, _Y10, path_stops, y10_features
from .graph import NS, _O, _S, _SLUG, _agent, _provenance, _row
from .scalar import _REF, _sql_normal


def _stored(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Stored clusters of one type, one row each."""
    rows = table(spark, d, "history_clusters").where(F.col("cluster_type") == kind)
    own = F.min(F.struct("label", "member_uris", "confidence", "created_at")).alias("r")
    return rows.groupBy(F.col("cluster_id").alias("assertion_id")).agg(own).select("assertion_id", "r.*")


def _members(clusters: DataFrame) -> DataFrame:
    rows = clusters.select(F.col("assertion_id").alias("cluster_id"), F.explode("member_uris").alias("u"))
    return rows.select("cluster_id", uri_key(F.col("u")).alias("member")).where("member is not null").distinct()


def _asserted(clusters: DataFrame, kind: str) -> DataFrame:
    base = clusters.withColumnsRenamed({"member_uris": "subject_uris"}).withColumn("cluster_type", F.lit(kind))
    return base.withColumns({"assertion_type": F.lit(f"{kind}_cluster"), "generated_by": _agent("cluster_type")})


def r2_geographic_triples(spark: SparkSession, d: str) -> DataFrame:
    """R2: stored geographic clusters with the region, the centroid and the number of their known members."""
    clusters = _stored(spark, d, "geographic")
    facts = summaries.geographic(_members(clusters), entities(spark, d))
    rows = _asserted(clusters, "geographic").join(facts.withColumnRenamed("cluster_id", "assertion_id"), "assertion_id", "left")
    rows = rows.withColumn("description", F.concat(F.lit("Cluster of "), F.col("known").cast("string"), F.lit(" known sites")))
    return mapping.triples(rows.withColumns({c: F.round(c, 4) for c in ("centroid_lat", "centroid_lon")}), NS)


def r3_chronological_triples(spark: SparkSession, d: str) -> DataFrame:
    """Stored chronological clusters with their label as period and the years of their known members."""
    clusters = _stored(spark, d, "chronological")
    dated = entities(spark, d).withColumn("p", normalized_period(F.col("period_label"))).select("id", "p.start_year", "p.end_year")
    facts = summaries.chronological(_members(clusters), dated)
    rows = _asserted(clusters, "chronological").join(facts.withColumnRenamed("cluster_id", "assertion_id"), "assertion_id", "left")
    return mapping.triples(rows.withColumn("period_label", F.col("label")), NS)


def _typological(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "typological_clusters").select("assertion_id", "label", "description", "subject_uris", "generated_by", F.col("confidence_score").alias("confidence"), "reasoning", "created_at", "typology", "shared_features")
    return rows.distinct()


def r4_typological_triples(spark: SparkSession, d: str) -> DataFrame:
    """Typological clusters with typology, shared features and reasoning."""
    return mapping.triples(_typological(spark, d).withColumn("assertion_type", F.lit("typological_cluster")), NS)


def r8_described_path_triples(spark: SparkSession, d: str) -> DataFrame:
    """Paths with difficulty, narrative, and stops of their own."""
    rows = table(spark, d, "history_paths").select("path_id", "theme", "path_type", "stop_uris", "confidence", "created_at").distinct()
    none = F.lit(None).cast("string")
    stops = F.transform("stop_uris", lambda u: F.struct(none.alias("stop_id"), u.alias("site_uri"), F.lit("A stop").alias("label"), F.concat(F.lit("On "), u).alias("narrative"), F.lit("on the way").alias("connection_reason")))
    rows = rows.select(F.col("path_id").alias("assertion_id"), F.lit("thematic_path").alias("assertion_type"), F.concat(F.lit("Path: "), "theme").alias("label"), "theme", "path_type", stops.alias("stops"), F.lit("path_generator").alias("generated_by"), "confidence", "created_at", F.when(F.size("stop_uris") > 5, "hard").otherwise("easy").alias("difficulty"), F.concat(F.lit("About "), "theme").alias("narrative"))
    return mapping.triples(rows, NS)


def r9_generic_triples(spark: SparkSession, d: str) -> DataFrame:
    """Assertions of no known type are about their subjects, with what they derive from."""
    rows = _typological(spark, d).withColumn("derived_from", F.array("assertion_id"))
    return mapping.triples(rows.withColumns({"assertion_id": F.concat(F.lit("note_"), "assertion_id"), "assertion_type": F.lit("observation"), "validation_notes": F.lit("unchecked")}), NS)


def r10_stop_triples(spark: SparkSession, d: str) -> DataFrame:
    """The stops of paths as assertions of their own."""
    rows = path_stops(spark, d).select(F.col("stop_id").alias("assertion_id"), F.lit("path_stop").alias("assertion_type"), "label", "stop_order", "path_id", F.col("member").alias("site_uri"), F.array("member").alias("subject_uris"), F.lit("path_generator").alias("generated_by"), F.lit(0.5).alias("confidence"), F.lit("next on the way").alias("justification"), excerpt(F.col("label"), 8).alias("narrative"))
    return mapping.triples(rows, NS)


def r11_feature_triples(spark: SparkSession, d: str) -> DataFrame:
    """Features of sites."""
    key = F.md5(F.concat_ws("|", "category", "feature", "entity"))
    rows = y10_features(spark, d).select(F.concat(F.lit("feature_"), key).alias("assertion_id"), F.lit("extracted_feature").alias("assertion_type"), F.col("feature").alias("label"), F.array("entity").alias("subject_uris"), F.lit("type_analyzer").alias("generated_by"), "confidence", F.col("category").alias("feature_category"), F.col("feature").alias("feature_label"), F.col("entity").alias("entity_uri"))
    return mapping.triples(rows, NS)


QUERIES = {
    "r2_geographic_triples": r2_geographic_triples, "r3_chronological_triples": r3_chronological_triples, "r4_typological_triples": r4_typological_triples,
    "r8_described_path_triples": r8_described_path_triples, "r9_generic_triples": r9_generic_triples, "r10_stop_triples": r10_stop_triples, "r11_feature_triples": r11_feature_triples,
}

_DATA = NS.data


def _one(kind: str, agent: str) -> str:
    """CTEs ``one`` (a row per stored cluster) and ``mem`` (its distinct members)."""
    return f"""one AS (SELECT cluster_id id, label, member_uris, confidence, created_at, '{agent}' agent FROM history_clusters WHERE cluster_type = '{kind}'
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY label NULLS FIRST, member_uris NULLS FIRST, confidence NULLS FIRST, created_at NULLS FIRST) = 1),
mem AS (SELECT DISTINCT id, member FROM (SELECT id, {sql_key('u')} member FROM (SELECT id, unnest(member_uris) u FROM one)) WHERE member IS NOT NULL)"""


def _named(source: str, label: str = "coalesce(label, '')", description: str = "nullif(description, '')") -> list[str]:
    return [_row(_S, RDFS + "label", label, "literal", "string", source), _row(_S, DC + "description", description, "literal", "string", source)]


def _text(p: str, o: str, source: str, datatype: str = "string", where: str = "") -> str:
    return _row(_S, _O + p, o, "literal", datatype, source, where)


_SITES = _row(_S, _O + "includesSite", _REF.format("u"), source="(SELECT id, unnest(subjects) u FROM c)")
_NODE = "'_:c_' || id"
_R2 = f"""WITH {ENTITIES}, {_one('geographic', 'geo_analyzer')},
reg AS (SELECT mem.id, coalesce(region, 'Unknown') region, count(*) n, min(load_order) f FROM mem JOIN entities e ON e.id = member GROUP BY 1, 2),
dom AS (SELECT id, region FROM reg QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) = 1),
mid AS (SELECT mem.id, round(avg(lat), 4) la, round(avg(lon), 4) lo, count(*) known FROM mem JOIN entities e ON e.id = member GROUP BY 1),
c AS (SELECT one.*, member_uris subjects, region, la, lo, 'Cluster of ' || known::varchar || ' known sites' description FROM one LEFT JOIN dom USING (id) LEFT JOIN mid USING (id)) """ + " UNION ".join([
    *_named("c"), _row(_S, RDF + "type", f"'{_O}GeographicCluster'", source="c"), _SITES, _text("regionName", "nullif(region, '')", "c"),
    _row(_S, GEO + "hasCentroid", _NODE, "bnode", source="c", where="la IS NOT NULL AND lo IS NOT NULL"), _row(_NODE, RDF + "type", f"'{GEO}Point'", source="c", where="la IS NOT NULL AND lo IS NOT NULL"),
    _row(_NODE, WGS84 + "lat", "la", "literal", "decimal", "c", "lo IS NOT NULL"), _row(_NODE, WGS84 + "long", "lo", "literal", "decimal", "c", "la IS NOT NULL"), *_provenance("c", "subjects"),
])
_R3 = f"""WITH {ENTITIES}, {_one('chronological', 'temporal_analyzer')},
yr AS (SELECT mem.id, min({_sql_normal('period_label', 1)}) s, max({_sql_normal('period_label', 2)}) e FROM mem JOIN entities x ON x.id = member GROUP BY 1),
c AS (SELECT one.*, member_uris subjects, s, e FROM one LEFT JOIN yr USING (id)) """ + " UNION ".join([
    _named("c")[0], _row(_S, RDF + "type", f"'{_O}ChronologicalCluster'", source="c"), _SITES, _text("periodLabel", "nullif(label, '')", "c"),
    _text("startYear", "s", "c", "integer"), _text("endYear", "e", "c", "integer"), _text("temporalExtent", "nullif(concat_ws(' to ', s::varchar, e::varchar), '')", "c"), *_provenance("c", "subjects"),
])
_TC = "c AS (SELECT DISTINCT assertion_id id, label, description, subject_uris subjects, generated_by agent, confidence_score confidence, reasoning, created_at, typology, shared_features FROM typological_clusters)"
_R4 = f"WITH {_TC} " + " UNION ".join([
    *_named("c"), _row(_S, RDF + "type", f"'{_O}TypologicalCluster'", source="c"), _SITES, _text("typologyLabel", "nullif(typology, '')", "c"),
    _text("definingFeature", "nullif(f, '')", "(SELECT id, unnest(shared_features) f FROM c)"), _text("reasoningTrace", "nullif(reasoning, '')", "c"), *_provenance("c", "subjects"),
])
_R9 = f"WITH {_TC.replace('assertion_id id', chr(39) + 'note_' + chr(39) + ' || assertion_id id, assertion_id source')} " + " UNION ".join([
    *_named("c"), _row(_S, RDF + "type", f"'{_O}InterpretiveAssertion'", source="c"), _row(_S, _O + "about", _REF.format("u"), source="(SELECT id, unnest(subjects) u FROM c)"),
    _text("reasoningTrace", "nullif(reasoning, '')", "c"), _text("validationNotes", "'unchecked'", "c"), _row(_S, _O + "derivedFrom", f"'{_DATA}' || source", source="c"), *_provenance("c", "subjects"),
])
_STOP = f"'{_DATA}' || id || '-stop-' || i::varchar"
_R8 = f"""WITH c AS (SELECT DISTINCT path_id id, theme, path_type, stop_uris, confidence, created_at, 'path_generator' agent FROM history_paths),
ps AS (SELECT id, unnest(stop_uris) u, generate_subscripts(stop_uris, 1) i, len(stop_uris) n FROM c) """ + " UNION ".join([
    _row(_S, RDF + "type", f"'{_O}ThematicPath'", source="c"),
    _row(_S, RDF + "type", "CASE coalesce(nullif(lower(path_type), ''), 'mixed') " + " ".join(f"WHEN '{k}' THEN '{_O}{v}'" for k, v in mapping._PATHS.items()) + " END", source="c"),
    _named("c", "coalesce('Path: ' || theme, '')")[0], _row(_SLUG, RDF + "type", "'http://www.w3.org/2004/02/skos/core#Concept'", source="c", where="theme <> ''"),
    _row(_SLUG, "http://www.w3.org/2004/02/skos/core#prefLabel", "theme", "literal", "string", "c", "theme <> ''"), _row(_S, _O + "hasTheme", _SLUG, source="c", where="theme <> ''"),
    _text("pathLength", "len(stop_uris)", "c", "integer", "len(stop_uris) > 0"), _text("difficulty", "CASE WHEN len(stop_uris) > 5 THEN 'hard' ELSE 'easy' END", "c"), _text("narrative", "'About ' || theme", "c"),
    _row(_S, _O + "hasStop", _STOP, source="ps"), _row(_STOP, RDF + "type", f"'{_O}PathStop'", source="ps"), _row(_STOP, RDFS + "label", "'A stop'", "literal", "string", "ps"),
    _row(_STOP, _O + "stopOrder", "i", "literal", "integer", "ps"), _row(_STOP, _O + "belongsToPath", _S, source="ps"), _row(_STOP, _O + "stopSite", _REF.format("u"), source="ps"),
    _row(_STOP, _O + "narrativeSnippet", "'On ' || u", "literal", "string", "ps"), _row(_STOP, _O + "connectionReason", "'on the way'", "literal", "string", "ps"),
    _row(_STOP, _O + "nextStop", f"'{_DATA}' || id || '-stop-' || (i + 1)::varchar", source="ps", where="i < n"), *_provenance("c", "CAST([] AS varchar[])"),
])
_R10 = f"""WITH s0 AS ({_STOPS}), c AS (SELECT stop_id id, label, stop_order, path_id, member, [member] subjects, 'path_generator' agent, 0.5::double confidence, NULL::timestamp created_at FROM s0) """ + " UNION ".join([
    _named("c")[0], _row(_S, RDF + "type", f"'{_O}PathStop'", source="c"), _row(_S, _O + "stopSite", _REF.format("member"), source="c"), _text("stopOrder", "stop_order", "c", "integer"),
    _row(_S, _O + "belongsToPath", f"'{_DATA}' || path_id", source="c"), _text("connectionReason", "'next on the way'", "c"),
    _text("narrativeSnippet", "nullif(CASE WHEN length(label) > 8 THEN substr(label, 1, 8) || '...' ELSE label END, '')", "c"), *_provenance("c", "subjects"),
])
_R11 = f"""WITH f0 AS ({_Y10}), c AS (SELECT 'feature_' || md5(category || '|' || feature || '|' || entity) id, feature, category, entity, [entity] subjects, 'type_analyzer' agent, confidence, NULL::timestamp created_at FROM f0) """ + " UNION ".join([
    _named("c", "coalesce(feature, '')")[0], _row(_S, RDF + "type", f"'{_O}ExtractedFeature'", source="c"),
    _row(_S, RDF + "type", f"CASE lower(category) WHEN 'architectural' THEN '{_O}ArchitecturalFeature' WHEN 'functional' THEN '{_O}FunctionalFeature' END", source="c"),
    _text("featureLabel", "nullif(feature, '')", "c"), _row(_S, _O + "featureOf", _REF.format("entity"), source="c"), _row(_REF.format("entity"), _O + "hasFeature", _S, source="c"), *_provenance("c", "subjects"),
])
SQL = {
    "r2_geographic_triples": _R2, "r3_chronological_triples": _R3, "r4_typological_triples": _R4, "r8_described_path_triples": _R8, "r9_generic_triples": _R9,
    "r10_stop_triples": _R10, "r11_feature_triples": _R11,
}
