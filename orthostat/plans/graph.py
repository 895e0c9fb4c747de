"""The knowledge graph of the stored assertions: triples, checks and serialisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import mapping, sinks, validate
from ..graph.ontology import CLASSES, CONSTRAINTS, DC, PROPERTIES, PROV, RDF, RDFS, SKOS, XSD, Namespaces, classes_of, path_iri
from ..session import cut
from ..sources.tables import table
from .scalar import SQL_TIER, _REF

NS = Namespaces()
_AGENT = {"geographic": "geo_analyzer", "chronological": "temporal_analyzer", "typological": "type_analyzer", "nearTo": "geo_analyzer", "contemporaryWith": "temporal_analyzer", "similarTo": "type_analyzer"}
_IRI = {"geo_analyzer": "GeoSpatialAgent", "temporal_analyzer": "ChronologicalAgent", "type_analyzer": "TypologicalAgent", "path_generator": "NarrativeAgent"}


def _agent(kind: str):
    return F.create_map(*(F.lit(x) for pair in _AGENT.items() for x in pair))[F.col(kind)]


def cluster_assertions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history_clusters").select("cluster_id", "cluster_type", "label", "member_uris", "confidence", "created_at").distinct()
    return rows.select(F.col("cluster_id").alias("assertion_id"), F.concat("cluster_type", F.lit("_cluster")).alias("assertion_type"), "label", F.col("member_uris").alias("subject_uris"), _agent("cluster_type").alias("generated_by"), "confidence", "created_at")


def relation_assertions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history_relations").select("relation_id", "relation_type", "source_uri", "target_uri", "confidence", "created_at", "value").distinct()
    return rows.select(F.col("relation_id").alias("assertion_id"), F.col("relation_type").alias("assertion_type"), "source_uri", "target_uri", F.array_compact(F.array("source_uri")).alias("subject_uris"), F.array_compact(F.array("target_uri")).alias("object_uris"), _agent("relation_type").alias("generated_by"), "confidence", "created_at", F.col("value").alias("relation_value"))


def path_assertions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "history_paths").select("path_id", "theme", "path_type", "stop_uris", "confidence", "created_at").distinct()
    null = F.lit(None).cast("string")
    stops = F.transform("stop_uris", lambda u: F.struct(null.alias("stop_id"), u.alias("site_uri"), null.alias("label"), null.alias("narrative"), null.alias("connection_reason")))
    return rows.select(F.col("path_id").alias("assertion_id"), F.lit("thematic_path").alias("assertion_type"), F.col("theme").alias("label"), "theme", "path_type", stops.alias("stops"), F.lit("path_generator").alias("generated_by"), "confidence", "created_at", (F.size("stop_uris") * 0.5).alias("duration_hours"))


def r2_cluster_triples(spark: SparkSession, d: str) -> DataFrame:
    return mapping.triples(cluster_assertions(spark, d), NS)


def r5_relation_triples(spark: SparkSession, d: str) -> DataFrame:
    return mapping.triples(relation_assertions(spark, d), NS)


def r8_path_triples(spark: SparkSession, d: str) -> DataFrame:
    return mapping.triples(path_assertions(spark, d), NS)


def all_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of all stored assertions, each once; written once since several checks read them."""
    parts = [mapping.complete(make(spark, d)) for make in (cluster_assertions, relation_assertions, path_assertions)]
    return cut(mapping.triples(parts[0].unionByName(parts[1]).unionByName(parts[2]), NS), "triples")


def v3_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return validate.vocabulary_warnings(all_triples(spark, d), NS)


def v6_shapes(spark: SparkSession, d: str) -> DataFrame:
    return validate.shape_violations(all_triples(spark, d), NS, is_set=True)


def v7_info(spark: SparkSession, d: str) -> DataFrame:
    return validate.info(all_triples(spark, d))


def v8_consistency(spark: SparkSession, d: str) -> DataFrame:
    return validate.consistency(all_triples(spark, d), NS)


def v9_review(spark: SparkSession, d: str) -> DataFrame:
    return validate.review_rows(all_triples(spark, d), NS).select("assertion", "confidence", "generated_by")


def k1_turtle(spark: SparkSession, d: str) -> DataFrame:
    return sinks.turtle(all_triples(spark, d))


def k2_jsonld(spark: SparkSession, d: str) -> DataFrame:
    return sinks.jsonld(all_triples(spark, d))


def k3_ntriples(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ntriples(all_triples(spark, d))


def k4_rdfxml(spark: SparkSession, d: str) -> DataFrame:
    return sinks.rdfxml(all_triples(spark, d))


def k6_predicates(spark: SparkSession, d: str) -> DataFrame:
    return sinks.statistics(all_triples(spark, d))[1]


QUERIES = {
    "r2_cluster_triples": r2_cluster_triples, "r5_relation_triples": r5_relation_triples, "r8_path_triples": r8_path_triples, "v3_vocabulary": v3_vocabulary,
    "v6_shapes": v6_shapes, "v7_info": v7_info, "v8_consistency": v8_consistency, "v9_review": v9_review,
    "k1_turtle": k1_turtle, "k2_jsonld": k2_jsonld, "k3_ntriples": k3_ntriples, "k4_rdfxml": k4_rdfxml, "k6_predicates": k6_predicates,
}

_TIME = "replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')"


def _row(s: str, p: str, o: str, kind: str = "iri", datatype: str = "NULL", source: str = "", where: str = "") -> str:
    dt = "NULL::varchar" if datatype == "NULL" else f"'{XSD}{datatype}'"
    checks = " AND ".join(x for x in (f"({o}) IS NOT NULL", f"({s}) IS NOT NULL", where) if x)
    return f"SELECT {s} s, '{p}' p, ({o})::varchar o, '{kind}' o_kind, {dt} datatype, NULL::varchar lang FROM {source} WHERE {checks}"


def _provenance(source: str, uris: str, where: str = "") -> list[str]:
    """Provenance of a CTE with id, agent, confidence, created_at and a list of grounds."""
    s, o = f"'{NS.data}' || id", NS.onto
    agent = "CASE agent " + " ".join(f"WHEN '{k}' THEN '{NS.resource}{v}'" for k, v in _IRI.items()) + " END"
    grounds = f"(SELECT id, unnest({uris}) u FROM {source}{' WHERE ' + where if where else ''})"
    return [
        *(_row(s, o + p, agent, source=source, where=where) for p in ("generatedBy", "validatedBy")),
        _row(s, o + "confidenceScore", "confidence", "literal", "decimal", source, where),
        *(_row(s, o + p, _TIME, "literal", "dateTime", source, where) for p in ("generatedAt", "validatedAt")),
        _row(s, o + "hasValidationStatus", f"'{o}' || {SQL_TIER.format('coalesce(confidence, 0.0)')}", source=source, where=where),
        *(_row(s, p, _REF.format("u"), source=grounds) for p in (o + "groundedOn", PROV + "used")),
    ]


def _case(names: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_S, _O = f"'{NS.data}' || id", NS.onto
_CA = f"ca AS (SELECT DISTINCT cluster_id id, cluster_type, label, member_uris, confidence, created_at, {_case({k: v for k, v in _AGENT.items() if k.endswith('ical') or k == 'geographic'}, 'cluster_type')} agent FROM history_clusters)"
_CT = " UNION ".join([
    _row(_S, RDF + "type", _case({k: f"{_O}{k.title()}Cluster" for k in ("geographic", "chronological", "typological")}, "cluster_type"), source="ca"),
    _row(_S, RDFS + "label", "coalesce(label, '')", "literal", "string", "ca"),
    _row(_S, _O + "includesSite", _REF.format("u"), source="(SELECT id, unnest(member_uris) u FROM ca)"),
    *_provenance("ca", "member_uris"),
])
_RA = f"ra AS (SELECT DISTINCT relation_id id, relation_type kind, {_REF.format('source_uri')} a, {_REF.format('target_uri')} b, source_uri, target_uri, confidence, created_at, value, {_case({k: v for k, v in _AGENT.items() if k.endswith('o') or k.endswith('With')}, 'relation_type')} agent FROM history_relations)"
_LINKED = "a IS NOT NULL AND b IS NOT NULL"
_RT = " UNION ".join([
    *(_row("a", _O + k, "b", source="ra", where=f"kind = '{k}'") for k in ("nearTo", "similarTo", "contemporaryWith")), _row("a", _O + "relatesTo", "b", source="ra"),
    *(_row("b", _O + k, "a", source="ra", where="kind = 'contemporaryWith'") for k in ("contemporaryWith", "relatesTo")),
    _row(_S, RDF + "type", _case({"nearTo": _O + "SpatialRelation", "similarTo": _O + "TypologicalRelation", "contemporaryWith": _O + "TemporalRelation"}, "kind"), source="ra", where=_LINKED),
    _row(_S, _O + "source", "a", source="ra", where=_LINKED), _row(_S, _O + "target", "b", source="ra", where=_LINKED),
    _row(_S, _O + "distanceKm", "value", "literal", "decimal", "ra", f"kind = 'nearTo' AND {_LINKED}"), _row(_S, _O + "similarityScore", "value", "literal", "decimal", "ra", f"kind = 'similarTo' AND {_LINKED}"),
    *_provenance("ra", "[source_uri, target_uri]", _LINKED),
])
_PA = f"pa AS (SELECT DISTINCT path_id id, theme, path_type, stop_uris, confidence, created_at, 'path_generator' agent FROM history_paths), ps AS (SELECT id, unnest(stop_uris) u, generate_subscripts(stop_uris, 1) i, len(stop_uris) n FROM pa)"
_STOP, _SLUG = f"'{NS.data}' || id || '-stop-' || i::varchar", f"'{NS.data}theme_' || translate(lower(theme), ' -', '__')"
_HOURS = "(len(stop_uris) * 0.5)"
_PT = " UNION ".join([
    _row(_S, RDF + "type", f"'{_O}ThematicPath'", source="pa"), _row(_S, RDF + "type", _case({k: _O + v for k, v in mapping._PATHS.items()}, "coalesce(nullif(lower(path_type), ''), 'mixed')"), source="pa"),
    _row(_S, RDFS + "label", "coalesce(theme, '')", "literal", "string", "pa"),
    _row(_SLUG, RDF + "type", f"'{SKOS}Concept'", source="pa", where="theme <> ''"), _row(_SLUG, SKOS + "prefLabel", "theme", "literal", "string", "pa", "theme <> ''"), _row(_S, _O + "hasTheme", _SLUG, source="pa", where="theme <> ''"),
    _row(_S, _O + "pathLength", "len(stop_uris)", "literal", "integer", "pa", "len(stop_uris) > 0"),
    _row(_S, _O + "estimatedDuration", f"'PT' || CASE WHEN trunc({_HOURS}) > 0 THEN trunc({_HOURS})::int::varchar || 'H' ELSE '' END || CASE WHEN {_HOURS} > trunc({_HOURS}) THEN '30M' ELSE '' END", "literal", "duration", "pa", "len(stop_uris) > 0"),
    _row(_S, _O + "hasStop", _STOP, source="ps"), _row(_STOP, RDF + "type", f"'{_O}PathStop'", source="ps"), _row(_STOP, RDFS + "label", "'Stop ' || i::varchar", "literal", "string", "ps"),
    _row(_STOP, _O + "stopOrder", "i", "literal", "integer", "ps"), _row(_STOP, _O + "belongsToPath", _S, source="ps"), _row(_STOP, _O + "stopSite", _REF.format("u"), source="ps"),
    _row(_STOP, _O + "nextStop", f"'{NS.data}' || id || '-stop-' || (i + 1)::varchar", source="ps", where="i < n"),
    *_provenance("pa", "CAST([] AS varchar[])"),
])
_ALL = f"{_CA}, {_RA}, {_PA}, tri AS ({_CT} UNION {_RT} UNION {_PT})"


def _sql_shapes() -> str:
    """Each constraint as a SELECT over its focus nodes."""
    parts = []
    for c in CONSTRAINTS:
        names = ", ".join(f"'{_O}{n}'" for n in CLASSES if c.target in classes_of(n))
        bad = {
            "minCount": f"count(o) < {c.least}" if c.least else "false", "maxCount": f"count(o) > {c.most}" if c.most else "false",
            "datatype": f"coalesce(bool_or(o IS NOT NULL AND datatype IS DISTINCT FROM '{XSD}{c.datatype}'), false)" if c.datatype else "false",
            "nodeKind": "coalesce(bool_or(o_kind <> 'iri'), false)" if c.kind else "false",
            "minInclusive": f"coalesce(bool_or(o IS NOT NULL AND NOT coalesce(try_cast(o AS double) >= {c.low}, false)), false)" if c.low is not None else "false",
            "maxInclusive": f"coalesce(bool_or(o IS NOT NULL AND NOT coalesce(try_cast(o AS double) <= {c.high}, false)), false)" if c.high is not None else "false",
        }
        rules = ", ".join(f"CASE WHEN {b} THEN '{r}' END" for r, b in bad.items() if b != "false")
        if rules:
            parts.append(f"SELECT node, '{c.target}' target, '{c.path}' AS path, unnest([{rules}]) AS rule FROM (SELECT DISTINCT s node FROM tri WHERE p = '{RDF}type' AND o IN ({names})) f LEFT JOIN (SELECT s, o, o_kind, datatype FROM tri WHERE p = '{path_iri(c.path, NS)}') v ON v.s = f.node GROUP BY node")
    return " UNION ALL ".join(parts)


def _lacking(classes: list[str], path: str, problem: str) -> str:
    names = ", ".join(f"'{_O}{c}'" for c in classes)
    return f"SELECT DISTINCT s node, '{problem}' problem FROM tri WHERE p = '{RDF}type' AND o IN ({names}) AND s NOT IN (SELECT s FROM tri WHERE p = '{_O}{path}')"


_RELS = ["SpatialRelation", "TypologicalRelation", "TemporalRelation"]
_ESC = "replace(replace(replace(replace(replace(o, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_OBJECT = f"CASE WHEN o_kind = 'literal' THEN '\"' || {_ESC} || '\"' || CASE WHEN datatype <> '{XSD}string' THEN '^^<' || datatype || '>' ELSE '' END ELSE '<' || o || '>' END"
_SUBJECT = "'<' || s || '>'"
_VERB = f"CASE WHEN p = '{RDF}type' THEN 'a' ELSE '<' || p || '>' END || ' ' || {_OBJECT}"
_JSON = "CASE WHEN o_kind = 'literal' THEN '{\"@value\":' || to_json(o)::varchar || ',\"@type\":' || to_json(datatype)::varchar || '}' ELSE '{\"@id\":' || to_json(o)::varchar || '}' END"


def _xml(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


def _blocks(item: str) -> str:
    """CTEs ending in ``block`` (s, b, items): sorted items of the blocks of a subject."""
    digest = f"('0x' || substr(md5(p || ' ' || o), 1, 8))::bigint % ceil(count(*) OVER (PARTITION BY s) / {sinks.BLOCK}.0)::bigint"
    return f"block AS (SELECT s, b, list_sort(list(i)) items FROM (SELECT s, {digest} b, {item} i FROM tri) GROUP BY s, b)"


_NAME = "regexp_extract(p, '^(.*[/#])([^/#]+)$', 2)"
_ELEMENT = f"""'<n:' || {_NAME} || ' xmlns:n="' || {_xml("regexp_extract(p, '^(.*[/#])([^/#]+)$', 1)")} || '"' || CASE WHEN o_kind = 'literal'
THEN CASE WHEN datatype <> '{XSD}string' THEN ' rdf:datatype="' || datatype || '"' ELSE '' END || '>' || {_xml('o')} || '</n:' || {_NAME} || '>' ELSE ' rdf:resource="' || {_xml('o')} || '"/>' END"""
SQL = {
    "r2_cluster_triples": f"WITH {_CA} {_CT}",
    "r5_relation_triples": f"WITH {_RA} {_RT}",
    "r8_path_triples": f"WITH {_PA} {_PT}",
    "v3_vocabulary": f"WITH {_ALL} SELECT 'unknown class' \"check\", o term, count(*) n FROM tri WHERE p = '{RDF}type' AND starts_with(o, '{_O}') AND o NOT IN ({', '.join(f'{chr(39)}{_O}{c}{chr(39)}' for c in CLASSES)}) GROUP BY 2 UNION ALL SELECT 'unknown property', p, count(*) FROM tri WHERE starts_with(p, '{_O}') AND p NOT IN ({', '.join(f'{chr(39)}{_O}{c}{chr(39)}' for c in PROPERTIES)}) GROUP BY 2 UNION ALL SELECT 'empty literal', p, count(*) FROM tri WHERE o_kind = 'literal' AND trim(o) = '' GROUP BY 2",
    "v6_shapes": f"WITH {_ALL} SELECT * FROM ({_sql_shapes()}) WHERE rule IS NOT NULL",
    "v7_info": f"WITH {_ALL} SELECT count(*) triples, count(DISTINCT s) subjects, count(*) = 0 empty FROM tri",
    "v8_consistency": f"WITH {_ALL} " + " UNION ALL ".join([_lacking(["ThematicPath"], "hasStop", "path without stop"), _lacking(["PathStop"], "stopSite", "stop without site"), _lacking(["GeographicCluster", "ChronologicalCluster", "TypologicalCluster"], "includesSite", "cluster without member"), *(_lacking(_RELS, e, f"relation without {e}") for e in ("source", "target"))]),
    "v9_review": f"WITH {_ALL} SELECT s assertion, try_cast(min(o) FILTER (p = '{_O}confidenceScore') AS double) confidence, min(o) FILTER (p = '{_O}generatedBy') generated_by FROM tri GROUP BY s HAVING min(o) FILTER (p = '{_O}hasValidationStatus') = '{_O}PendingReview'",
    "k3_ntriples": f"WITH {_ALL} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'literal' THEN '\"' || {_ESC} || '\"' || CASE WHEN datatype <> '{XSD}string' THEN '^^<' || datatype || '>' ELSE '' END ELSE '<' || o || '>' END || ' .' AS value FROM tri",
    "k1_turtle": f"WITH {_ALL}, {_blocks(_VERB)} SELECT {_SUBJECT} || ' ' || array_to_string(items, ' ;' || chr(10) || '    ') || ' .' || chr(10) AS value FROM block",
    "k2_jsonld": f"""WITH {_ALL}, {_blocks(f"{{'p': p, 'v': {_JSON}}}")},
by_p AS (SELECT s, b, p, array_to_string(list_transform(list_filter(items, lambda x: x.p = p), lambda x: x.v), ',') vs FROM (SELECT s, b, items, unnest(list_sort(list_distinct(list_transform(items, lambda x: x.p)))) p FROM block))
SELECT '{{"@id":' || to_json(s)::varchar || ',' || string_agg(to_json(p)::varchar || ':[' || vs || ']', ',' ORDER BY p) || '}}' AS value FROM by_p GROUP BY s, b""",
    "k4_rdfxml": f"WITH {_ALL}, {_blocks(_ELEMENT)} SELECT '<rdf:Description xmlns:rdf=\"{RDF}\" rdf:about=\"' || {_xml('s')} || '\">' || array_to_string(items, '') || '</rdf:Description>' AS value FROM block",
    "k6_predicates": f"WITH {_ALL} SELECT p, count(*) n FROM tri GROUP BY p ORDER BY n DESC, p LIMIT 20",
}
