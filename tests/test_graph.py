import datetime
import json
import xml.etree.ElementTree as ET

import pytest

from orthostat.graph import mapping, sinks, validate
from orthostat.sources.rdf import read_ntriples
from orthostat.graph.ontology import CONSTRAINTS, RDF, RDFS, XSD, Namespaces

NS = Namespaces("http://o/", "http://d/", "http://r/", "http://c/")
T = "s string, p string, o string, o_kind string, datatype string, lang string"
AT = datetime.datetime(2024, 1, 2, 3, 4, 5)
ASSERTIONS = [
    {"assertion_id": "g1", "assertion_type": "geographic_cluster", "label": 'A "b"\n', "subject_uris": ["http://x/arco/1", "x2", None, "http://x/arco/1"], "generated_by": "geo_analyzer", "confidence": 0.65, "centroid_lat": 0.0, "centroid_lon": 9.5, "created_at": AT},
    {"assertion_id": "r1", "assertion_type": "contemporaryWith", "source_uri": "a", "target_uri": "b", "generated_by": "me", "confidence": 0.9, "created_at": AT},
    {"assertion_id": "r2", "assertion_type": "nearTo", "source_uri": "a", "target_uri": "", "generated_by": "validator", "confidence": 0.9, "created_at": AT},
    {"assertion_id": "p1", "assertion_type": "thematic_path", "label": "P", "theme": "Old-New Way", "path_type": None, "stops": [(None, "a", None, "n", None), ("s9", "b", "L", None, "why")], "duration_hours": 2.5, "generated_by": "narrative", "confidence": 0.5, "created_at": AT, "derived_from": ["g1"]},
    {"assertion_id": "f1", "assertion_type": "extracted_feature", "label": "F", "feature_label": "slab", "feature_category": "Architectural", "entity_uri": "a", "confidence": None, "created_at": None},
    {"assertion_id": "z1", "assertion_type": "other", "label": None, "subject_uris": ["a"], "confidence": 0.7},
    {"assertion_id": None, "assertion_type": "other"},
]


@pytest.fixture(scope="module")
def triples(spark):
    ddl = ", ".join(f"{c} {t}" for c, t in mapping.COLUMNS.items()) + ", s string, p string"  # clashing extra columns
    rows = [tuple(a.get(c) for c in mapping.COLUMNS) + ("x", "y") for a in ASSERTIONS + ASSERTIONS[:1]]
    return mapping.triples(spark.createDataFrame(rows, ddl), NS).cache()


def of(triples, s):
    return sorted((r["p"].split("/")[-1].split("#")[-1], r["o"]) for r in triples.where(triples.s == s).collect())


def test_cluster(triples):
    got = of(triples, "http://d/g1")
    assert [o for p, o in got if p == "includesSite"] == ["http://c/1", "http://d/x2"]
    assert ("hasValidationStatus", "http://o/PendingReview") in got and ("generatedBy", "http://r/GeoSpatialAgent") in got and ("generatedAt", "2024-01-02T03:04:05") in got
    assert ("lat", "0.0") in of(triples, "_:c_g1") and len([1 for p, _ in got if p == "used"]) == 2


def test_relations(triples):
    assert of(triples, "http://d/a") == [("contemporaryWith", "http://d/b"), ("hasFeature", "http://d/f1"), ("relatesTo", "http://d/b")]
    assert of(triples, "http://d/b") == [("contemporaryWith", "http://d/a"), ("relatesTo", "http://d/a")]
    assert of(triples, "http://d/r2") == [] and ("generatedBy", "me") in of(triples, "http://d/r1")


def test_path(triples):
    got = of(triples, "http://d/p1")
    assert {("type", "http://o/NarrativePath"), ("type", "http://o/ThematicPath"), ("hasTheme", "http://d/theme_old_new_way"), ("estimatedDuration", "PT2H30M"), ("pathLength", "2"), ("derivedFrom", "http://d/g1")} <= set(got)
    assert ("nextStop", "http://d/s9") in of(triples, "http://d/p1-stop-1") and "nextStop" not in [p for p, _ in of(triples, "http://d/s9")]
    assert ("stopOrder", "2") in of(triples, "http://d/s9") and ("label", "Stop 1") in of(triples, "http://d/p1-stop-1")


def test_feature_and_other(triples):
    assert {("type", "http://o/ArchitecturalFeature"), ("type", "http://o/ExtractedFeature"), ("hasValidationStatus", "http://o/Rejected"), ("featureOf", "http://d/a")} <= set(of(triples, "http://d/f1"))
    assert {("type", "http://o/InterpretiveAssertion"), ("about", "http://d/a"), ("label", "")} <= set(of(triples, "http://d/z1"))


def test_checks(triples):
    warnings = {(r["check"], r["term"]): r["n"] for r in validate.vocabulary_warnings(triples, NS).collect()}
    assert warnings == {("empty literal", RDFS + "label"): 1}
    assert validate.consistency(triples, NS).count() == 0
    assert [r["assertion"] for r in validate.review_rows(triples, NS).collect()] == ["http://d/g1"]
    assert validate.info(triples.limit(0)).first()["empty"]


def node(cls, **values):
    rows = [("http://d/n", RDF + "type", "http://o/" + cls, "iri", None, None)]
    for p, items in values.items():
        for o, kind, dt in items if isinstance(items, list) else [items]:
            rows.append(("http://d/n", RDFS + "label" if p == "label" else "http://o/" + p, o, kind, XSD + dt if dt else None, None))
    return rows


def fitting(c):
    """A value that a constraint accepts."""
    if c.kind == "iri" or not c.datatype:
        return ("http://d/v", "iri", None)
    return ({"decimal": "0.5", "integer": "3", "dateTime": "2024-01-01T00:00:00", "string": "x", "duration": "PT1H"}[c.datatype], "literal", c.datatype)


@pytest.mark.parametrize("c", CONSTRAINTS, ids=lambda c: f"{c.target}.{c.path}")
def test_each_constraint(spark, c):
    value, kind, dt = fitting(c)
    other = lambda k: (f"http://d/v{k}", kind, dt) if kind == "iri" else ({"decimal": f"0.{k}", "integer": f"{k}", "string": f"x{k}"}.get(dt, f"{value}{k}"), kind, dt)
    cases = []
    if c.least:
        cases.append(("minCount", [other(k) for k in range(3, 2 + c.least)]))
    if c.most:
        cases.append(("maxCount", [other(k) for k in range(3, 4 + c.most)]))
    if c.datatype:
        cases.append(("datatype", [(value, kind, "boolean")]))
    if c.kind:
        cases.append(("nodeKind", [("text", "literal", "string")] + [other(k) for k in range(3, 2 + (c.least or 0))]))
    if c.low is not None:
        cases.append(("minInclusive", [(str(int(c.low) - 1), "literal", c.datatype)]))
    if c.high is not None:
        cases.append(("maxInclusive", [(str(int(c.high) + 1), "literal", c.datatype)]))
    for rule, values in cases:
        rows = node(c.target, **{c.path: values})
        found = validate.shape_violations(spark.createDataFrame(rows, T), NS, [c]).collect()
        assert [r["rule"] for r in found] == [rule]
    good = node(c.target, **{c.path: [other(k) for k in range(3, 3 + max(1, c.least or 0))]})
    assert validate.shape_violations(spark.createDataFrame(good, T), NS, [c]).count() == 0


def test_subclasses_are_checked(spark):
    rows = node("GeographicPath", hasStop=[("http://d/1", "iri", None)])
    found = validate.shape_violations(spark.createDataFrame(rows, T), NS).collect()
    assert ("ThematicPath", "hasStop", "minCount") in {(r["target"], r["path"], r["rule"]) for r in found} and "InterpretiveAssertion" in {r["target"] for r in found}


def test_serialisations(spark, triples, tmp_path, monkeypatch):
    lines = {r["value"] for r in sinks.ntriples(triples).collect()}
    assert len(lines) == triples.count()
    assert f'<http://d/g1> <{RDFS}label> "A \\"b\\"\\n" .' in lines and f'_:c_g1 <{RDF}type> <http://www.opengis.net/ont/geosparql#Point> .' in lines
    assert f'<http://d/g1> <http://o/confidenceScore> "0.65"^^<{XSD}decimal> .' in lines
    nodes = [json.loads(r["value"]) for r in sinks.jsonld(triples).collect()]
    assert sum(len(v) for n in nodes for k, v in n.items() if k != "@id") == triples.count()
    assert {"@value": 'A "b"\n', "@type": XSD + "string"} in next(n for n in nodes if n["@id"] == "http://d/g1")[RDFS + "label"]
    assert json.loads(sinks.jsonld(triples, context=True, ns=NS).first()["value"])["@context"]["o"] == "http://o/"
    assert sum(len(ET.fromstring(r["value"])) for r in sinks.rdfxml(triples).collect()) == triples.count()
    monkeypatch.setattr(sinks, "BLOCK", 3)
    text = "".join(r["value"] for r in sinks.turtle(triples).collect())
    assert text.count("<http://d/g1> ") > 3  # a subject of many triples in several blocks
    sinks.write(triples, str(tmp_path / "out"), "NT")
    again = read_ntriples(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in triples.collect()}
    with pytest.raises(ValueError):
        sinks.serialize(triples, "docx")
    totals, top = sinks.statistics(triples, 3)
    assert totals.first()["triples"] == triples.count() and top.count() == 3
