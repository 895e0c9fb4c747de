"""Namespaces, classes, properties and shape constraints of the graph."""

from __future__ import annotations

from dataclasses import dataclass

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DC = "http://purl.org/dc/elements/1.1/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
GEO = "http://www.opengis.net/ont/geosparql#"
WGS84 = "http://www.w3.org/2003/01/geo/wgs84_pos#"


@dataclass(frozen=True)
class Namespaces:
    """The namespaces of a graph; set them to those of your own data."""

    onto: str = "https://example.org/ontology/"
    data: str = "https://example.org/data/"
    resource: str = "https://example.org/resource/"
    catalogue: str = "https://example.org/catalogue/"

    def prefixes(self) -> dict[str, str]:
        return {"o": self.onto, "d": self.data, "r": self.resource, "c": self.catalogue, "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "dc": DC, "skos": SKOS, "prov": PROV, "geo": GEO, "wgs84": WGS84}


# The classes of the ontology.
CLASSES = [
    "InterpretiveAssertion", "GeographicCluster", "ChronologicalCluster", "TypologicalCluster", "ThematicPath", "GeographicPath",
    "ChronologicalPath", "TypologicalPath", "NarrativePath", "PathStop", "SpatialRelation", "TypologicalRelation", "TemporalRelation",
    "ExtractedFeature", "ArchitecturalFeature", "FunctionalFeature",
]
# Superclasses; stops are no assertions.
SUPERCLASS = {
    "GeographicPath": "ThematicPath", "ChronologicalPath": "ThematicPath", "TypologicalPath": "ThematicPath", "NarrativePath": "ThematicPath",
    "ArchitecturalFeature": "ExtractedFeature", "FunctionalFeature": "ExtractedFeature",
    **{c: "InterpretiveAssertion" for c in ("GeographicCluster", "ChronologicalCluster", "TypologicalCluster", "ThematicPath", "SpatialRelation", "TypologicalRelation", "TemporalRelation", "ExtractedFeature")},
}
# The properties of the ontology.
PROPERTIES = [
    "includesSite", "nearTo", "similarTo", "contemporaryWith", "relatesTo", "groundedOn", "derivedFrom", "hasTheme", "hasStop", "stopSite",
    "nextStop", "stopOrder", "belongsToPath", "pathLength", "narrativeSnippet", "connectionReason", "estimatedDuration", "difficulty",
    "generatedBy", "generatedAt", "validatedBy", "validatedAt", "hasValidationStatus", "confidenceScore", "reasoningTrace", "validationNotes",
    "distanceKm", "regionName", "periodLabel", "temporalExtent", "startYear", "endYear", "typologyLabel", "definingFeature", "similarityScore",
    "hasFeature", "featureOf", "featureLabel", "source", "target", "about", "narrative",
]
# Other properties that the graph uses.
EXTERNAL = [RDF + "type", RDFS + "label", DC + "description", SKOS + "prefLabel", PROV + "used", GEO + "hasCentroid", WGS84 + "lat", WGS84 + "long"]
# The agents behind the names of generators.
AGENTS = {
    "orchestrator": "OrchestratorAgent", "geo_analyzer": "GeoSpatialAgent", "geospatial": "GeoSpatialAgent", "temporal_analyzer": "ChronologicalAgent",
    "chronological": "ChronologicalAgent", "type_analyzer": "TypologicalAgent", "typological": "TypologicalAgent",
    "path_generator": "NarrativeAgent", "narrative": "NarrativeAgent", "validator": "ValidationAgent",
}


@dataclass(frozen=True)
class Constraint:
    """One property constraint of a shape; None means unconstrained."""

    target: str
    path: str
    least: int | None = None
    most: int | None = None
    datatype: str | None = None
    kind: str | None = None
    low: float | None = None
    high: float | None = None


def _ends(target: str) -> list[Constraint]:
    return [Constraint(target, end, 1, 1, kind="iri") for end in ("source", "target")]


# The shape constraints.
CONSTRAINTS = [
    Constraint("InterpretiveAssertion", "confidenceScore", 1, 1, "decimal", low=0.0, high=1.0),
    Constraint("InterpretiveAssertion", "generatedAt", 1, 1, "dateTime"),
    Constraint("InterpretiveAssertion", "hasValidationStatus", 1, 1, kind="iri"),
    Constraint("InterpretiveAssertion", "label", 1),
    Constraint("InterpretiveAssertion", "generatedBy", 1, kind="iri"),
    Constraint("InterpretiveAssertion", "groundedOn", kind="iri"),
    Constraint("GeographicCluster", "includesSite", 2, kind="iri"),
    Constraint("GeographicCluster", "regionName", None, 1, "string"),
    Constraint("ChronologicalCluster", "includesSite", 2, kind="iri"),
    Constraint("ChronologicalCluster", "periodLabel", 1, datatype="string"),
    Constraint("ChronologicalCluster", "startYear", None, 1, "integer"),
    Constraint("ChronologicalCluster", "endYear", None, 1, "integer"),
    Constraint("TypologicalCluster", "includesSite", 2, kind="iri"),
    Constraint("TypologicalCluster", "typologyLabel", 1, datatype="string"),
    *_ends("SpatialRelation"),
    Constraint("SpatialRelation", "distanceKm", None, 1, "decimal", low=0.0),
    *_ends("TypologicalRelation"),
    Constraint("TypologicalRelation", "similarityScore", None, 1, "decimal", low=0.0, high=1.0),
    *_ends("TemporalRelation"),
    Constraint("ThematicPath", "hasStop", 2, kind="iri"),
    Constraint("ThematicPath", "pathLength", None, 1, "integer", low=2),
    Constraint("ThematicPath", "estimatedDuration", None, 1, "duration"),
    Constraint("ThematicPath", "difficulty", None, 1, "string"),
    Constraint("ThematicPath", "hasTheme", kind="iri"),
    Constraint("PathStop", "stopOrder", 1, 1, "integer", low=1),
    Constraint("PathStop", "belongsToPath", 1, 1, kind="iri"),
    Constraint("PathStop", "stopSite", kind="iri"),
    Constraint("ExtractedFeature", "featureLabel", 1, 1, "string"),
    Constraint("ExtractedFeature", "featureOf", 1, kind="iri"),
]


def path_iri(name: str, ns: Namespaces) -> str:
    return RDFS + "label" if name == "label" else ns.onto + name


def classes_of(name: str) -> list[str]:
    """A class and all its superclasses."""
    out = [name]
    while out[-1] in SUPERCLASS:
        out.append(SUPERCLASS[out[-1]])
    return out
