"""Serialisations of triples and their writers.

Subjects with very many triples are written as several blocks, which all formats allow, so
that no subject is ever collected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ontology import RDF, XSD, Namespaces

#: Triples of one block of a subject.
BLOCK = 1000
#: Names of formats.
FORMATS = {"turtle": "turtle", "ttl": "turtle", "n3": "turtle", "nt": "ntriples", "ntriples": "ntriples", "n-triples": "ntriples", "jsonld": "jsonld", "json-ld": "jsonld", "xml": "xml", "rdf": "xml", "rdfxml": "xml"}


def escaped(text: Column) -> Column:
    """A literal's text with the escapes of N-Triples and Turtle."""
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def term(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """An object in N-Triples form; strings need no datatype."""
    literal = F.concat(F.lit('"'), escaped(value), F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(""))
    return F.when(kind == "literal", literal).when(kind == "bnode", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def _subject(s: Column) -> Column:
    return F.when(s.startswith("_:"), s).otherwise(F.concat(F.lit("<"), s, F.lit(">")))


def _object() -> Column:
    return term(F.col("o"), F.col("o_kind"), F.col("datatype"), F.col("lang"))


def ntriples(triples: DataFrame) -> DataFrame:
    """K3: (value): one line per triple."""
    return triples.select(F.concat(_subject(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), _object(), F.lit(" .")).alias("value"))


def _blocks(triples: DataFrame, item: Column) -> DataFrame:
    """(s, items): the sorted items of each block of a subject."""
    sizes = triples.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(" ", "p", "o")), 1, 8), 16, 10).cast("long")
    rows = triples.join(sizes, "s").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(digest, F.col("blocks"))).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("s", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))


def turtle(triples: DataFrame) -> DataFrame:
    """K1: (value): one block per subject, sorted by predicate and object."""
    verb = F.when(F.col("p") == RDF + "type", "a").otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">")))
    rows = _blocks(triples, F.concat(verb, F.lit(" "), _object()))
    return rows.select(F.concat(_subject(F.col("s")), F.lit(" "), F.array_join("items", " ;\n    "), F.lit(" .\n")).alias("value"))


def jsonld(triples: DataFrame, context: bool = False, ns: Namespaces = Namespaces()) -> DataFrame:
    """K2: (value): one node object per line; with ``context`` each carries the prefixes."""
    value = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("datatype").alias("@type"), F.col("lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    rows = _blocks(triples, F.struct("p", value.alias("v")))
    by = F.array_distinct(F.transform("items", lambda x: x["p"]))
    each = F.transform(by, lambda p: F.concat(F.to_json(F.array(p)).substr(F.lit(2), F.length(F.to_json(F.array(p))) - 2), F.lit(":["), F.array_join(F.transform(F.filter("items", lambda x: x["p"] == p), lambda x: x["v"]), ","), F.lit("]")))
    head = F.lit("{")
    if context:
        import json

        head = F.lit('{"@context":' + json.dumps(ns.prefixes(), separators=(",", ":")) + ",")
    id_ = F.to_json(F.struct(F.col("s").alias("@id")))
    return rows.select(F.concat(head, id_.substr(F.lit(2), F.length(id_) - 2), F.lit(","), F.array_join(each, ","), F.lit("}")).alias("value"))


def rdfxml(triples: DataFrame) -> DataFrame:
    """K4: (value): one rdf:Description per subject, to be framed by an rdf:RDF element."""

    def xml(text: Column) -> Column:
        for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    cut_ = F.regexp_extract("p", r"^(.*[/#])([^/#]+)$", 1)
    name = F.regexp_extract("p", r"^(.*[/#])([^/#]+)$", 2)
    ref = F.when(F.col("o_kind") == "bnode", F.concat(F.lit(' rdf:nodeID="'), F.substring("o", 3, 1000), F.lit('"/>'))).otherwise(F.concat(F.lit(' rdf:resource="'), xml(F.col("o")), F.lit('"/>')))
    typed = F.when(F.col("datatype").isNotNull() & (F.col("datatype") != XSD + "string"), F.concat(F.lit(' rdf:datatype="'), F.col("datatype"), F.lit('"'))).otherwise("")
    body = F.when(F.col("o_kind") == "literal", F.concat(typed, F.lit(">"), xml(F.col("o")), F.lit("</n:"), name, F.lit(">"))).otherwise(ref)
    rows = _blocks(triples, F.concat(F.lit("<n:"), name, F.lit(' xmlns:n="'), xml(cut_), F.lit('"'), body))
    about = F.when(F.col("s").startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.substring("s", 3, 1000))).otherwise(F.concat(F.lit('rdf:about="'), xml(F.col("s"))))
    return rows.select(F.concat(F.lit(f'<rdf:Description xmlns:rdf="{RDF}" '), about, F.lit('">'), F.array_join("items", ""), F.lit("</rdf:Description>")).alias("value"))


def serialize(triples: DataFrame, format_: str, **options) -> DataFrame:
    """K5: lines in a named format; an unknown name is an error."""
    kind = FORMATS.get(format_.lower())
    if kind is None:
        raise ValueError(f"unknown format: {format_}")
    return {"turtle": turtle, "ntriples": ntriples, "jsonld": jsonld, "xml": rdfxml}[kind](triples, **options)


def write(triples: DataFrame, path: str, format_: str, **options) -> None:
    """K5: write the lines as text files under a path, one per partition."""
    serialize(triples, format_, **options).write.mode("overwrite").text(path)


def statistics(triples: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """K6: (totals, the ``top`` most frequent predicates)."""
    totals = triples.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"), F.countDistinct(F.when(F.col("o_kind") == "iri", F.col("o"))).alias("objects"))
    return totals, triples.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p").limit(top)
