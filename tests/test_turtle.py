import pytest

from orthostat.graph import sinks
from orthostat.graph.ontology import RDF, XSD
from orthostat.sources.turtle import constraints, parse_turtle, read_turtle

SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . # shapes
PREFIX o: <http://x/onto#>
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
o:ClusterShape a sh:NodeShape ; sh:targetClass o:Cluster ;
  sh:property [ sh:path o:label ; sh:minCount 1 ; sh:datatype xsd:string ] , [ sh:path o:score ; sh:minInclusive 0.0 ; sh:maxInclusive 1.0 ; sh:maxCount 1 ; ] ;
  sh:in ( "a" o:b 3 ) .
"""


def test_terms():
    text = """@base <http://x/> . @prefix : <#> . @prefix p: <y/> .
<s> :a "say \\"hi\\" \\u00e9"@en-GB, 'x', \"\"\"two
lines "in" one\"\"\" ; p:n.1 -4, 2.50, 1e3, true, "7"^^p:t . _:n a p:T ; p:of <s> . [] p:q [ p:r () ] ."""
    rows = parse_turtle(text)
    by = {(s, p): [] for s, p, *_ in rows}
    for s, p, *o in rows:
        by[s, p].append(tuple(o))
    assert by["http://x/s", "http://x/#a"] == [('say "hi" \u00e9', "literal", None, "en-GB"), ("x", "literal", XSD + "string", None), ('two\nlines "in" one', "literal", XSD + "string", None)]
    assert [o[0] for o in by["http://x/s", "http://x/y/n.1"]] == ["-4", "2.50", "1e3", "true", "7"]
    assert [o[2] for o in by["http://x/s", "http://x/y/n.1"]] == [XSD + "integer", XSD + "decimal", XSD + "double", XSD + "boolean", "http://x/y/t"]
    assert by["_:n", RDF + "type"] == [("http://x/y/T", "iri", None, None)] and ("_:b2", "http://x/y/r") in by


@pytest.mark.parametrize("text", ["<a> <b> .", "<a> <b> <c>", "x:y <b> <c> .", "<a> <b> <c> ; <d> \\ ."])
def test_what_is_not_turtle_is_an_error(text):
    with pytest.raises((ValueError, KeyError)):
        parse_turtle(text)


def test_empty():
    assert parse_turtle("") == [] and parse_turtle(" # nothing\n") == []


def test_shapes(spark, tmp_path):
    (tmp_path / "shapes.ttl").write_text(SHAPES)
    triples = read_turtle(spark, str(tmp_path / "shapes.ttl"))
    got = {r["path"]: r for r in constraints(triples).collect()}
    assert got["http://x/onto#label"]["minCount"] == "1" and got["http://x/onto#label"]["datatype"] == XSD + "string"
    assert (got["http://x/onto#score"]["minInclusive"], got["http://x/onto#score"]["maxCount"], got["http://x/onto#score"]["target"]) == ("0.0", "1", "http://x/onto#Cluster")
    assert triples.where(triples.p == RDF + "first").count() == 3


def test_round_trip_of_written_graphs(spark, tmp_path):
    rows = [("http://x/a", RDF + "type", "http://x/T", "iri", None, None), ("http://x/a", "http://x/p", 'q "t" \\ \n\té', "literal", XSD + "string", None), ("http://x/a", "http://x/p", "1.5", "literal", XSD + "decimal", None), ("http://x/b", "http://x/q", "ciao", "literal", None, "it")]
    rows += [("http://x/hub", "http://x/q", f"http://x/n{k}", "iri", None, None) for k in range(2500)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string")
    sinks.write(df, str(tmp_path / "ttl"), "turtle")
    assert sorted(map(str, read_turtle(spark, str(tmp_path / "ttl")).collect())) == sorted(map(str, df.collect()))
