"""A reader of Turtle: ontologies, shapes, and graphs written by this library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph.ontology import RDF, XSD

_TOKEN = re.compile(
    r"""(?P<blank>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\s]*>)|(?P<long>\"\"\"(?:\\.|"{0,2}[^"\\])*\"\"\"|\'\'\'(?:\\.|'{0,2}[^'\\])*\'\'\')
    |(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<node>_:[\w.-]*\w)
    |(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?=[\s;,.\])\#]|$))|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
_COLUMNS = ["s", "p", "o", "o_kind", "datatype", "lang"]


def _unescape(text: str) -> str:
    def plain(m: re.Match) -> str:
        code = m.group(1)
        return chr(int(code[1:], 16)) if code[0] in "uU" else _ESCAPES.get(code, code)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", plain, text, flags=re.S)


class _Reader:
    """One document; nodes without a name get names that start with ``mark``."""

    def __init__(self, text: str, mark: str):
        self.tokens = list(self._split(text))
        self.at, self.mark, self.count = 0, mark, 0
        self.base, self.prefixes, self.rows = "", {}, []

    def _split(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"not Turtle at {at}: {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "blank":
                yield m.lastgroup, m.group()
        yield "end", ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if wanted is not None and text != wanted:
            raise ValueError(f"{wanted!r} expected, not {text!r}")
        self.at += 1
        return kind, text

    def sees(self, *marks: str) -> bool:
        return self.tokens[self.at][1] in marks

    def read(self) -> list[tuple]:
        while self.tokens[self.at][0] != "end":
            kind, text = self.tokens[self.at]
            if text.lower() in ("@prefix", "@base", "prefix", "base") and kind in ("lang", "word"):
                self.directive()
                continue
            alone = self.sees("[")
            subject = self.term()[0]
            if not (alone and self.sees(".")):
                self.properties(subject)
            self.take(".")
        return self.rows

    def directive(self) -> None:
        word = self.take()[1]
        name = self.take()[1][:-1] if word.lower().endswith("prefix") else None
        iri = self.whole(self.take()[1][1:-1])
        if name is None:
            self.base = iri
        else:
            self.prefixes[name] = iri
        if word[0] == "@":
            self.take(".")

    def whole(self, iri: str) -> str:
        """An IRI against the base; a lone # stays."""
        return self.base.split("#")[0] + iri if iri.startswith("#") else urljoin(self.base, iri)

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.mark}b{self.count}"

    def properties(self, subject: str) -> None:
        while not self.sees(".", "]"):
            verb = self.term()[0]
            while True:
                self.rows.append((subject, verb, *self.term()))
                if not self.sees(","):
                    break
                self.take()
            while self.sees(";"):
                self.take()

    def term(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, datatype, language)."""
        kind, text = self.take()
        if kind == "iri":
            return self.whole(_unescape(text[1:-1])), "iri", None, None
        if kind == "name":
            prefix, local = text.split(":", 1)
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "node":
            return f"_:{self.mark}{text[2:]}", "bnode", None, None
        if kind == "word":
            if text == "a":
                return RDF + "type", "iri", None, None
            if text in ("true", "false"):
                return text, "literal", XSD + "boolean", None
        if kind == "number":
            whole = re.fullmatch(r"[+-]?\d+", text)
            return text, "literal", XSD + ("integer" if whole else "double" if "e" in text.lower() else "decimal"), None
        if kind in ("text", "long"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.tokens[self.at][0] == "lang":
                return value, "literal", None, self.take()[1][1:]
            if self.tokens[self.at][0] == "type":
                self.take()
                return value, "literal", self.term()[0], None
            return value, "literal", XSD + "string", None
        if text == "[":
            node = self.fresh()
            self.properties(node)
            self.take("]")
            return node, "bnode", None, None
        if text == "(":
            items = []
            while not self.sees(")"):
                items.append(self.term())
            self.take()
            following: tuple = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = self.fresh()
                self.rows += [(node, RDF + "first", *item), (node, RDF + "rest", *following)]
                following = (node, "bnode", None, None)
            return following
        raise ValueError(f"unexpected {text!r}")


def parse_turtle(text: str, mark: str = "") -> list[tuple]:
    """(s, p, o, o_kind, datatype, lang) of a Turtle document; what isn't Turtle is a ValueError."""
    return _Reader(text, mark).read()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples (s, p, o, o_kind, datatype, lang) of Turtle files, each read by one task.

    Literals without datatype and language are strings. Nodes without a name are named by their
    file, so that nodes of several files stay apart. Files are documents such as ontologies and
    shapes; graphs at scale are read line by line, as N-Triples.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                yield pd.DataFrame(parse_turtle(content.decode("utf-8-sig"), f"f{name[:8]}"), columns=_COLUMNS)

    files = spark.read.format("binaryFile").load(path).select(F.md5("path").alias("name"), "content")
    return files.mapInPandas(parse, ", ".join(f"{c} string" for c in _COLUMNS)).distinct()


def constraints(triples: DataFrame) -> DataFrame:
    """(target, path, minCount, maxCount, datatype, nodeKind, minInclusive, maxInclusive) of SHACL property shapes."""
    sh = "http://www.w3.org/ns/shacl#"
    names = ["path", "minCount", "maxCount", "datatype", "nodeKind", "minInclusive", "maxInclusive"]
    own = triples.where(F.col("p").isin([sh + n for n in names])).groupBy("s").pivot("p", [sh + n for n in names]).agg(F.min("o"))
    own = own.toDF("shape", *names)
    holds = triples.where(F.col("p") == sh + "property").select(F.col("s").alias("holder"), F.col("o").alias("shape"))
    targets = triples.where(F.col("p") == sh + "targetClass").select(F.col("s").alias("holder"), F.col("o").alias("target"))
    return targets.join(holds, "holder").join(own, "shape").select("target", *names)
