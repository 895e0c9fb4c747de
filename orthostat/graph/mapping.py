"""Assertions to triples: one row becomes many, with set semantics.

Assertions are one wide table with ``assertion_id``, ``assertion_type`` and nullable columns of
the subtypes; columns that a table lacks count as null. Triples are (s, p, o, o_kind, datatype,
lang), where ``o_kind`` is iri, bnode or literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.confidence import tier
from ..functions.text import duration_of, reference_of, slug
from .ontology import AGENTS, DC, GEO, PROV, RDF, RDFS, SKOS, WGS84, XSD, Namespaces

#: Columns of assertions with their types.
COLUMNS = {
    "assertion_id": "string", "assertion_type": "string", "label": "string", "description": "string", "subject_uris": "array<string>",
    "object_uris": "array<string>", "generated_by": "string", "confidence": "double", "reasoning": "string", "created_at": "timestamp_ntz",
    "validation_notes": "string", "derived_from": "array<string>", "region": "string", "centroid_lat": "double", "centroid_lon": "double",
    "period_label": "string", "start_year": "int", "end_year": "int", "typology": "string", "shared_features": "array<string>",
    "source_uri": "string", "target_uri": "string", "relation_value": "double", "path_type": "string", "theme": "string",
    "stops": "array<struct<stop_id:string,site_uri:string,label:string,narrative:string,connection_reason:string>>", "duration_hours": "double",
    "difficulty": "string", "narrative": "string", "site_uri": "string", "stop_order": "int", "path_id": "string",
    "justification": "string", "feature_category": "string", "feature_label": "string", "entity_uri": "string",
}
_TRIPLE = "struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>"
_CLUSTERS = {"geographic_cluster": "GeographicCluster", "chronological_cluster": "ChronologicalCluster", "typological_cluster": "TypologicalCluster"}
_RELATIONS = {"nearTo": "SpatialRelation", "similarTo": "TypologicalRelation", "contemporaryWith": "TemporalRelation"}
_PATHS = {"geographic": "GeographicPath", "chronological": "ChronologicalPath", "typological": "TypologicalPath", "narrative": "NarrativePath", "mixed": "NarrativePath"}


def complete(assertions: DataFrame) -> DataFrame:
    """The assertions with all columns of COLUMNS, missing ones as null."""
    have = set(assertions.columns)
    return assertions.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def _triple(s: Column, p: str, o: Column, kind: str, datatype: str | None = None, when: Column | None = None) -> Column:
    """A triple, or null where its subject or object is missing or ``when`` doesn't hold."""
    made = F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    ok = s.isNotNull() & o.isNotNull()
    return F.when(ok if when is None else ok & when, made)


def iso_time(ts: Column) -> Column:
    """ISO form of a timestamp, without a fraction of zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def _said(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def triples(assertions: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """All triples of the assertions, each once.

    Assertions without id give nothing. Relations without both ends give nothing but their
    provenance is left out as well. Node ids of centroids derive from the assertion.
    """
    c, o = F.col, ns.onto
    own = complete(assertions).where("assertion_id is not null")
    s = F.concat(F.lit(ns.data), c("assertion_id"))
    ref = lambda uri: reference_of(uri, ns.catalogue, ns.data)
    kind = c("assertion_type")
    is_cluster, is_relation = kind.isin(list(_CLUSTERS)), kind.isin(list(_RELATIONS))
    is_path, is_stop, is_feature = kind == "thematic_path", kind == "path_stop", kind == "extracted_feature"
    generic = ~(is_cluster | is_relation | is_path | is_stop | is_feature)
    source = ref(F.coalesce(_said(c("source_uri")), F.get("subject_uris", F.lit(0))))
    target = ref(F.coalesce(_said(c("target_uri")), F.get("object_uris", F.lit(0))))
    linked = is_relation & source.isNotNull() & target.isNotNull()

    def type_(name: Column | str, when: Column) -> Column:
        name = F.concat(F.lit(o), name) if isinstance(name, Column) else F.lit(o + name)
        return _triple(s, RDF + "type", name, "iri", when=when)

    def text(p: str, value: Column, when: Column | None = None, datatype: str | None = XSD + "string") -> Column:
        return _triple(s, p, value, "literal", datatype, when)

    def by(names: dict[str, str], key: Column) -> Column:
        return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key]

    def each(array: Column, make) -> Column:
        return F.transform(F.coalesce(array, F.array()), make)

    label, none = F.coalesce("label", F.lit("")), F.array().cast(f"array<{_TRIPLE}>")
    node = F.concat(F.lit("_:c_"), c("assertion_id"))
    path_type = F.lower(F.coalesce(_said(c("path_type")), F.lit("mixed")))
    theme = F.concat(F.lit(ns.data + "theme_"), slug(c("theme")))
    has_theme = is_path & (c("theme") != "")
    entity = ref(c("entity_uri"))
    agent = by(AGENTS, c("generated_by"))
    subjects = F.array_distinct(F.array_compact(F.concat(F.coalesce("subject_uris", F.array().cast("array<string>")), F.coalesce("object_uris", F.array().cast("array<string>")))))
    proven = F.when(is_relation, linked).otherwise(F.lit(True))
    decimal, integer = XSD + "decimal", XSD + "integer"
    years = F.array_join(F.array_compact(F.array(c("start_year").cast("string"), c("end_year").cast("string"))), " to ")
    chrono = kind == "chronological_cluster"
    geo = kind == "geographic_cluster"
    named = [text(RDFS + "label", label), text(DC + "description", _said(c("description")), ~is_stop)]
    placed = geo & c("centroid_lat").isNotNull() & c("centroid_lon").isNotNull()
    cluster = [
        *named, type_(by(_CLUSTERS, kind), F.lit(True)), text(o + "regionName", _said(c("region")), geo),
        _triple(s, GEO + "hasCentroid", node, "bnode", when=placed), _triple(node, RDF + "type", F.lit(GEO + "Point"), "iri", when=placed),
        _triple(node, WGS84 + "lat", c("centroid_lat"), "literal", decimal, placed), _triple(node, WGS84 + "long", c("centroid_lon"), "literal", decimal, placed),
        text(o + "periodLabel", _said(c("period_label")), chrono), text(o + "startYear", c("start_year"), chrono, integer), text(o + "endYear", c("end_year"), chrono, integer),
        text(o + "temporalExtent", _said(years), chrono), text(o + "typologyLabel", _said(c("typology")), kind == "typological_cluster"),
    ]
    relation = [
        *(_triple(source, o + name, target, "iri", when=linked & (kind == name)) for name in _RELATIONS), _triple(source, o + "relatesTo", target, "iri", when=linked),
        *(_triple(target, o + name, source, "iri", when=linked & (kind == "contemporaryWith")) for name in ("contemporaryWith", "relatesTo")),
        type_(by(_RELATIONS, kind), linked), _triple(s, o + "source", source, "iri", when=linked), _triple(s, o + "target", target, "iri", when=linked),
        text(RDFS + "label", _said(c("label")), linked), text(DC + "description", _said(c("description")), linked),
        text(o + "distanceKm", c("relation_value"), linked & (kind == "nearTo"), decimal), text(o + "similarityScore", c("relation_value"), linked & (kind == "similarTo"), decimal),
    ]
    path = [
        *named, type_("ThematicPath", F.lit(True)), type_(by(_PATHS, path_type), F.lit(True)),
        _triple(theme, RDF + "type", F.lit(SKOS + "Concept"), "iri", when=has_theme), _triple(theme, SKOS + "prefLabel", c("theme"), "literal", XSD + "string", has_theme), _triple(s, o + "hasTheme", theme, "iri", when=has_theme),
        text(o + "pathLength", F.size("stops"), F.size("stops") > 0, integer), text(o + "estimatedDuration", duration_of(c("duration_hours")), c("duration_hours") > 0, XSD + "duration"),
        text(o + "difficulty", _said(c("difficulty"))), text(o + "narrative", _said(c("narrative"))),
    ]
    single_stop = [
        *named, type_("PathStop", F.lit(True)), _triple(s, o + "stopSite", ref(c("site_uri")), "iri"), text(o + "stopOrder", c("stop_order"), None, integer),
        _triple(s, o + "belongsToPath", F.concat(F.lit(ns.data), c("path_id")), "iri"), text(o + "connectionReason", _said(c("justification"))), text(o + "narrativeSnippet", _said(c("narrative"))),
    ]
    feature = [
        *named, type_("ExtractedFeature", F.lit(True)), type_(by({"architectural": "ArchitecturalFeature", "functional": "FunctionalFeature"}, F.lower("feature_category")), F.lit(True)),
        text(o + "featureLabel", _said(c("feature_label"))), _triple(s, o + "featureOf", entity, "iri"), _triple(entity, o + "hasFeature", s, "iri"),
    ]
    provenance = [
        _triple(s, o + "generatedBy", F.concat(F.lit(ns.resource), agent), "iri", when=proven), text(o + "generatedBy", _said(c("generated_by")), proven & agent.isNull()),
        _triple(s, o + "validatedBy", F.concat(F.lit(ns.resource), agent), "iri", when=proven),
        text(o + "confidenceScore", c("confidence"), proven, decimal), text(o + "reasoningTrace", _said(c("reasoning")), proven),
        text(o + "generatedAt", iso_time(c("created_at")), proven, XSD + "dateTime"), text(o + "validatedAt", iso_time(c("created_at")), proven, XSD + "dateTime"),
        _triple(s, o + "hasValidationStatus", F.concat(F.lit(o), tier(F.coalesce("confidence", F.lit(0.0)))), "iri", when=proven), text(o + "validationNotes", _said(c("validation_notes")), proven),
    ]
    # only the branch of a row's own type is evaluated
    single = F.when(is_cluster, F.array(*cluster)).when(is_relation, F.array(*relation)).when(is_path, F.array(*path)).when(is_stop, F.array(*single_stop)).when(is_feature, F.array(*feature)).otherwise(F.array(*named, type_("InterpretiveAssertion", F.lit(True))))
    stop = lambda i: F.concat(F.lit(ns.data), F.coalesce(F.get("stops", i)["stop_id"], F.concat(c("assertion_id"), F.lit("-stop-"), (i + 1).cast("string"))))

    def of_stop(x: Column, i: Column) -> Column:
        me = stop(i)
        return F.array(
            _triple(s, o + "hasStop", me, "iri"), _triple(me, RDF + "type", F.lit(o + "PathStop"), "iri"),
            _triple(me, RDFS + "label", F.coalesce(x["label"], F.concat(F.lit("Stop "), (i + 1).cast("string"))), "literal", XSD + "string"),
            _triple(me, o + "stopOrder", i + 1, "literal", integer), _triple(me, o + "belongsToPath", s, "iri"), _triple(me, o + "stopSite", ref(x["site_uri"]), "iri"),
            _triple(me, o + "narrativeSnippet", _said(x["narrative"]), "literal", XSD + "string"), _triple(me, o + "connectionReason", _said(x["connection_reason"]), "literal", XSD + "string"),
            _triple(me, o + "nextStop", stop(i + 1), "iri", when=i + 1 < F.size("stops")),
        )

    many = [
        F.when(is_cluster, each(c("subject_uris"), lambda u: _triple(s, o + "includesSite", ref(u), "iri"))).otherwise(none),
        F.when(generic, each(c("subject_uris"), lambda u: _triple(s, o + "about", ref(u), "iri"))).otherwise(none),
        F.when(kind == "typological_cluster", each(c("shared_features"), lambda f: _triple(s, o + "definingFeature", _said(f), "literal", XSD + "string"))).otherwise(none),
        F.when(is_path, F.flatten(F.transform(F.coalesce("stops", F.array().cast(COLUMNS["stops"])), of_stop))).otherwise(none),
        F.when(proven, F.flatten(each(subjects, lambda u: F.array(_triple(s, o + "groundedOn", ref(u), "iri"), _triple(s, PROV + "used", ref(u), "iri"))))).otherwise(none),
        F.when(proven, each(c("derived_from"), lambda d: _triple(s, o + "derivedFrom", F.concat(F.lit(ns.data), d), "iri"))).otherwise(none),
    ]
    rows = own.select(F.explode(F.concat(single, F.array(*provenance), *many)).alias("t")).where("t is not null")
    return rows.select("t.*").distinct()
