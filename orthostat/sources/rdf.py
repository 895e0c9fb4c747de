"""A reader of N-Triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'
_LITERAL = r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$'
_STRING = "http://www.w3.org/2001/XMLSchema#string"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples (s, p, o, o_kind, datatype, lang) of N-Triples files; other lines are skipped.

    Literals without datatype and language are strings. The escapes of tab, line feed, return,
    quote and backslash are undone.
    """
    rows = spark.read.text(path).where(F.col("value").rlike(_LINE))
    s, p, o = (F.regexp_extract("value", _LINE, k) for k in (1, 2, 3))
    bare = lambda x: F.when(x.startswith("<"), F.substring(x, 2, 1_000_000)).otherwise(x)
    node = lambda x: F.regexp_replace(bare(x), ">$", "")
    body, datatype, lang = (F.regexp_extract(o, _LITERAL, k) for k in (1, 2, 3))
    text = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
    for code, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    text = F.replace(text, F.lit("\u0000"), F.lit("\\"))
    literal = o.startswith('"')
    kind = F.when(literal, "literal").when(o.startswith("_:"), "bnode").otherwise("iri")
    return rows.select(node(s).alias("s"), p.alias("p"), F.when(literal, text).otherwise(node(o)).alias("o"), kind.alias("o_kind"), F.when(literal, F.when(datatype != "", datatype).when(lang == "", F.lit(_STRING))).alias("datatype"), F.when(literal & (lang != ""), lang).alias("lang"))
