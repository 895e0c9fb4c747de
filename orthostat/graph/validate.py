"""Graph checks: vocabulary, literals, consistency and shape constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ontology import CLASSES, CONSTRAINTS, EXTERNAL, GEO, PROPERTIES, PROV, RDF, RDFS, WGS84, XSD, Constraint, Namespaces, classes_of, path_iri


def vocabulary_warnings(triples: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """V3-V5: (check, term, n): unknown classes and properties of checked namespaces, and empty literals."""
    own = F.col("o").startswith(ns.onto)
    types = triples.where((F.col("p") == RDF + "type") & own & ~F.col("o").isin([ns.onto + c for c in CLASSES]))
    checked = F.lit(False)
    for space in (ns.onto, PROV, GEO, WGS84):
        checked = checked | F.col("p").startswith(space)
    properties = triples.where(checked & ~F.col("p").isin([ns.onto + p for p in PROPERTIES] + EXTERNAL))
    empty = triples.where((F.col("o_kind") == "literal") & (F.trim("o") == ""))
    out = None
    for name, rows, term in (("unknown class", types, "o"), ("unknown property", properties, "p"), ("empty literal", empty, "p")):
        part = rows.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "term", "n")
        out = part if out is None else out.unionByName(part)
    return out


def consistency(triples: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """V8: (node, problem): paths without stop, stops without site, clusters without member, relations without an end."""
    o = ns.onto
    rules = [(["ThematicPath"], "hasStop", "path without stop"), (["PathStop"], "stopSite", "stop without site")]
    rules += [(["GeographicCluster", "ChronologicalCluster", "TypologicalCluster"], "includesSite", "cluster without member")]
    rules += [(["SpatialRelation", "TypologicalRelation", "TemporalRelation"], end, f"relation without {end}") for end in ("source", "target")]
    typed = triples.where(F.col("p") == RDF + "type")
    out = None
    for classes, path, problem in rules:
        nodes = typed.where(F.col("o").isin([o + c for c in classes])).select(F.col("s").alias("node")).distinct()
        having = triples.where(F.col("p") == o + path).select(F.col("s").alias("node"))
        part = nodes.join(having, "node", "left_anti").withColumn("problem", F.lit(problem))
        out = part if out is None else out.unionByName(part)
    return out


def shape_violations(triples: DataFrame, ns: Namespaces = Namespaces(), constraints: list[Constraint] = CONSTRAINTS, is_set: bool = False) -> DataFrame:
    """V6: (node, target, path, rule) of the nodes that break a constraint.

    A node is checked by the shapes of its classes and of their superclasses. Values are
    counted once each; ``is_set`` says that no triple is repeated. Rules: minCount, maxCount,
    datatype, nodeKind, minInclusive, maxInclusive. Facts of each node and predicate are reduced
    before they are shuffled, and a node's facts then come together once for all constraints.
    """
    spark = triples.sparkSession
    up = F.create_map(*(x for c in CLASSES for x in (F.lit(ns.onto + c), F.array(*map(F.lit, sorted(classes_of(c)))))))
    table = spark.createDataFrame(
        [(c.target, c.path, path_iri(c.path, ns), c.least, c.most, XSD + c.datatype if c.datatype else None, c.kind, *(None if x is None else float(x) for x in (c.low, c.high))) for c in constraints],
        "target string, path string, p string, least int, most int, datatype string, kind string, low double, high double",
    )
    wanted = sorted({path_iri(c.path, ns) for c in constraints})
    known = F.when((F.col("p") == RDF + "type") & F.col("o").isin([ns.onto + c for c in CLASSES]), F.col("o"))
    there, number = F.col("o").isNotNull(), F.col("o").try_cast("double")
    n = F.count("o") if is_set else F.count_distinct(F.when(there, F.struct("o", "o_kind", "datatype")))
    facts = (
        triples.where(F.col("p").isin(wanted) | known.isNotNull())
        .groupBy(F.col("s").alias("node"), "p")
        .agg(
            n.alias("n"),
            F.collect_set(known).alias("types"),
            F.collect_set(F.when(there, F.coalesce("datatype", F.lit("")))).alias("datatypes"),
            F.max(there & (F.col("o_kind") != "iri")).alias("other_kind"),
            F.min(number).alias("least"),
            F.max(number).alias("most"),
            F.max(there & number.isNull()).alias("no_number"),
        )
    )
    entry = F.struct("p", F.struct("n", "datatypes", "other_kind", "least", "most", "no_number").alias("f"))
    nodes = facts.groupBy("node").agg(F.map_from_entries(F.collect_list(entry)).alias("facts"), F.flatten(F.collect_list("types")).alias("types"))
    targets = F.array_distinct(F.flatten(F.transform("types", lambda t: up[t])))
    asked = nodes.select("node", "facts", F.explode(targets).alias("target")).join(F.broadcast(table), "target")  # as many rows as constraints
    rows = asked.withColumn("x", F.col("facts")[F.col("p")])
    count, many = F.coalesce("x.n", F.lit(0)), F.coalesce("x.n", F.lit(0)) > 0
    bad = {
        "minCount": count < F.col("rows_least"), "maxCount": count > F.col("rows_most"),
        "datatype": F.col("datatype").isNotNull() & F.exists("x.datatypes", lambda d: d != F.col("datatype")),
        "nodeKind": (F.col("kind") == "iri") & F.col("x.other_kind"),
        "minInclusive": F.col("low").isNotNull() & many & (F.col("x.no_number") | (F.col("x.least") < F.col("low"))),
        "maxInclusive": F.col("high").isNotNull() & many & (F.col("x.no_number") | (F.col("x.most") > F.col("high"))),
    }
    rows = rows.withColumnsRenamed({"least": "rows_least", "most": "rows_most"})
    rules = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in bad.items())))
    return rows.select("node", "target", "path", F.explode(rules).alias("rule"))


def info(triples: DataFrame) -> DataFrame:
    """V1, V7: (triples, subjects, empty)."""
    return triples.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects")).withColumn("empty", F.col("triples") == 0)


def review_rows(triples: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """V9: pending assertions with their optional properties, by one pivot over predicates."""
    o = ns.onto
    names = {"label": RDFS + "label", "status": o + "hasValidationStatus", "confidence": o + "confidenceScore", "reasoning": o + "reasoningTrace", "generated_by": o + "generatedBy", "type": RDF + "type"}
    own = triples.where(F.col("p").isin(list(names.values()))).groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in names.items()))
    return own.where(F.col("status") == o + "PendingReview").select(F.col("s").alias("assertion"), "type", "label", F.col("confidence").cast("double").alias("confidence"), "reasoning", "generated_by")
