"""The whole run: entities and proposals to validated, novel assertions, triples and checks.

One lazy lineage; actions happen only in the sinks. Proposals are optional tables: where there
are none, the deterministic fallbacks make the clusters.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import confidence
from .functions.period import normalized_period
from .functions.text import features_in
from .graph import mapping, sinks, validate
from .graph.ontology import Namespaces
from .operators import fallback, features, novelty, similarity, summaries, validation
from .params import Params
from .session import cut, shared_dir
from .sources.records import append_history, read_history


class ProposalSource(Protocol):
    """Whatever proposes clusters, relations, features and paths for some sites.

    All but clusters and relations may be None.
    """

    def clusters(self, sites: DataFrame) -> DataFrame:
        """(cluster_id, cluster_type, label, member, stated)."""

    def relations(self, sites: DataFrame) -> DataFrame:
        """(relation_id, relation_type, source, target, stated)."""

    def features(self, sites: DataFrame) -> DataFrame | None:
        """(entity, category, label) of extracted features."""

    def vectors(self, sites: DataFrame) -> DataFrame | None:
        """(id, vector) of the sites' texts; a similarTo proposal without both vectors is invalid."""

    def label_vectors(self, sites: DataFrame) -> DataFrame | None:
        """(category, label, vector) of normalised feature labels; similar ones are merged."""

    def paths(self, sites: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(path_id, path_type, theme, label, stated) and the stops (path_id, ord, member)."""


@dataclass
class TableProposals:
    """Proposals that lie in tables."""

    cluster_rows: DataFrame
    relation_rows: DataFrame
    feature_rows: DataFrame | None = None
    vector_rows: DataFrame | None = None
    label_vector_rows: DataFrame | None = None
    path_rows: tuple[DataFrame, DataFrame] | None = None

    def clusters(self, sites: DataFrame) -> DataFrame:
        return self.cluster_rows

    def relations(self, sites: DataFrame) -> DataFrame:
        return self.relation_rows

    def features(self, sites: DataFrame) -> DataFrame | None:
        return self.feature_rows

    def vectors(self, sites: DataFrame) -> DataFrame | None:
        return self.vector_rows

    def label_vectors(self, sites: DataFrame) -> DataFrame | None:
        return self.label_vector_rows

    def paths(self, sites: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        return self.path_rows


def assertion_id(prefix: str, kind, members) -> F.Column:
    """A deterministic id: a prefix and a digest of type and sorted members."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", kind, F.array_join(F.array_sort(members), ","))), 1, 8))


CLUSTER_TYPES = ("geographic", "chronological", "typological")
RELATION_TYPES = ("nearTo", "contemporaryWith", "similarTo")
_AGENTS = {"geographic": "geo_analyzer", "chronological": "temporal_analyzer"}


def _refuse_others(proposals: DataFrame, column: str, types: tuple[str, ...]) -> None:
    """No proposal is dropped for its type: an unknown or missing one is an error."""
    odd = proposals.where(~F.coalesce(F.col(column).isin(*types), F.lit(False))).select(column).first()
    if odd is not None:
        raise ValueError(f"unknown {column}: {odd[0]}")


def _with_facts(rows: DataFrame, kind: str, sites: DataFrame) -> DataFrame:
    """Cluster assertions with what their known members say: region and centroid, or years."""
    members = rows.select(F.col("assertion_id").alias("cluster_id"), F.explode("subject_uris").alias("member"))
    if kind == "geographic":
        facts = summaries.geographic(members, sites).drop("known")
    else:
        dated = sites.withColumn("p", normalized_period(F.col("period_label"))).select("id", "p.start_year", "p.end_year")
        facts = summaries.chronological(members, dated)
    return rows.join(facts.withColumnRenamed("cluster_id", "assertion_id"), "assertion_id", "left")


def accepted_clusters(sites: DataFrame, proposals: DataFrame, params: Params) -> DataFrame:
    """Assertions of the geographic and chronological cluster proposals that validation accepts."""
    checks = {
        "geographic": lambda p: validation.geographic_clusters(p, sites, params.max_radius_km),
        "chronological": lambda p: validation.chronological_clusters(p, sites),
    }
    out = None
    for kind, check in checks.items():
        own = proposals.where(F.col("cluster_type") == kind)
        valid = check(own.select("cluster_id", "member")).where("is_valid").select("cluster_id", "score", "proposed")
        lists = own.groupBy("cluster_id", "label", "stated").agg(F.sort_array(F.collect_set("member")).alias("subject_uris"))
        score = F.round(confidence.cluster(F.col("stated"), F.col("score"), F.col("proposed")), 2)
        id_ = assertion_id(f"{kind[:3]}_cluster_", F.lit(kind), F.col("subject_uris")).alias("assertion_id")
        rows = lists.join(valid, "cluster_id").select(id_, F.lit(f"{kind}_cluster").alias("assertion_type"), "label", "subject_uris", F.lit(_AGENTS[kind]).alias("generated_by"), score.alias("confidence"))
        rows = _with_facts(rows.dropDuplicates(["assertion_id"]), kind, sites)
        if kind == "chronological":
            rows = rows.withColumn("period_label", F.col("label"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def fallback_clusters(sites: DataFrame, params: Params) -> DataFrame:
    """Assertions of the fallbacks: greedy spatial clusters, named by their region, and clusters of one period."""
    located = sites.where("lat is not null and lon is not null")
    spatial = fallback.greedy_clusters(located, params.max_radius_km / 2).groupBy("cluster").agg(F.sort_array(F.collect_set("id")).alias("subject_uris"))
    dated = sites.withColumn("p", normalized_period(F.col("period_label"))).where("p is not null")
    periods = dated.groupBy(F.col("p.period").alias("period_label")).agg(F.sort_array(F.collect_set("id")).alias("subject_uris")).where(F.size("subject_uris") >= 2)
    out = None
    for kind, found in (("geographic", spatial), ("chronological", periods)):
        id_ = assertion_id("fallback_", F.lit(kind), F.col("subject_uris")).alias("assertion_id")
        kept = ["period_label"] if kind == "chronological" else []
        rows = found.select(id_, F.lit(f"{kind}_cluster").alias("assertion_type"), "subject_uris", F.lit(_AGENTS[kind]).alias("generated_by"), F.lit(0.5).alias("confidence"), *kept)
        rows = _with_facts(cut(rows, f"{kind}-clusters"), kind, sites)
        size = F.size("subject_uris").cast("string")
        if kind == "geographic":
            rows = rows.withColumns({"label": F.concat(F.lit("Geographic Cluster - "), F.coalesce("region", F.lit("Unknown"))), "description": F.concat(F.lit("Algorithmic cluster of "), size, F.lit(" sites"))})
        else:
            rows = rows.withColumns({"label": F.concat(F.lit("Chronological Cluster - "), "period_label"), "description": F.concat(size, F.lit(" sites of one period"))})
        rows = rows.withColumn("reasoning", F.lit("Algorithmic fallback clustering"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def accepted_relations(sites: DataFrame, proposals: DataFrame, params: Params) -> DataFrame:
    """Assertions of the near and contemporary relation proposals that validation accepts."""
    near = validation.near_relations(proposals.where("relation_type = 'nearTo'"), sites, params.near_km).where("is_valid")
    near = near.select("*", F.round("distance_km", 4).alias("relation_value"))
    same = validation.contemporary_relations(proposals.where("relation_type = 'contemporaryWith'"), sites).where("is_valid").withColumn("strength", F.lit(None).cast("double")).withColumn("relation_value", F.lit(None).cast("double"))
    rows = near.select("relation_type", "source", "target", "stated", "score", "strength", "relation_value").unionByName(same.select("relation_type", "source", "target", "stated", "score", "strength", "relation_value"))
    score = F.round(confidence.relation(F.col("stated"), F.col("score"), F.col("strength")), 2)
    pair = F.array("source", "target")
    agent = F.when(F.col("relation_type") == "nearTo", "geo_analyzer").otherwise("temporal_analyzer")
    return rows.select(assertion_id("rel_", F.col("relation_type"), pair).alias("assertion_id"), F.col("relation_type").alias("assertion_type"), F.col("source").alias("source_uri"), F.col("target").alias("target_uri"), F.array("source").alias("subject_uris"), F.array("target").alias("object_uris"), agent.alias("generated_by"), score.alias("confidence"), "relation_value")


def site_features(sites: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(entity, feature): extracted features but for material ones, else the words of the site's texts."""
    both = F.concat_ws(" ", F.lit(""), *(c for c in ("description", "historical_info") if c in sites.columns))
    words = sites.select(F.col("id").alias("entity"), F.explode(features_in(both)).alias("feature")).distinct()
    if extracted is None:
        return words
    listed = extracted.where(F.col("category").isin("architectural", "functional", "contextual")).select("entity", F.col("label").alias("feature")).where("feature is not null").distinct()
    return listed.unionByName(words.join(extracted.select("entity").distinct(), "entity", "left_anti"))


def accepted_types(proposals: DataFrame, found: DataFrame, params: Params) -> DataFrame:
    """Assertions of the typological cluster proposals that validation accepts, by the features ``found``."""
    own = proposals.where("cluster_type = 'typological'")
    members = own.select("cluster_id", "member")
    valid = validation.typological_clusters(members, found, params.min_shared, params.majority).where("is_valid").select("cluster_id", "score")
    shared = validation.shared_features(members, found, params.majority).groupBy("cluster_id").agg(F.sort_array(F.collect_set("feature")).alias("shared_features"))
    lists = own.groupBy("cluster_id", "label", "stated").agg(F.count("*").alias("proposed"), F.sort_array(F.collect_set("member")).alias("subject_uris"))
    score = F.round(confidence.cluster(F.col("stated"), F.col("score"), F.col("proposed")), 2)
    rows = lists.join(valid, "cluster_id").join(shared, "cluster_id", "left")
    return rows.select(assertion_id("typ_cluster_", F.lit("typological"), F.col("subject_uris")).alias("assertion_id"), F.lit("typological_cluster").alias("assertion_type"), "label", "subject_uris", F.lit("type_analyzer").alias("generated_by"), score.alias("confidence"), F.col("label").alias("typology"), "shared_features")


def _names(sites: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of the sites; the name is null where sites have none."""
    return sites.select(F.col("id").alias(key), (F.col("name") if "name" in sites.columns else F.lit(None).cast("string")).alias(name))


def _similar(rows: DataFrame, sites: DataFrame, score: F.Column, value: F.Column) -> DataFrame:
    """similarTo assertions of rows (source, target)."""
    a, b = F.col("source"), F.col("target")
    kind = F.lit("similarTo")
    rows = rows.join(_names(sites, "source", "name_a"), "source", "left").join(_names(sites, "target", "name_b"), "target", "left")
    label = F.concat(F.coalesce("name_a", a), F.lit(" similar to "), F.coalesce("name_b", b))
    return rows.select(assertion_id("rel_", kind, F.array(a, b)).alias("assertion_id"), kind.alias("assertion_type"), label.alias("label"), a.alias("source_uri"), b.alias("target_uri"), F.array(a).alias("subject_uris"), F.array(b).alias("object_uris"), F.lit("type_analyzer").alias("generated_by"), score.alias("confidence"), value.alias("relation_value"))


def accepted_similar(sites: DataFrame, proposals: DataFrame, vectors: DataFrame | None, params: Params) -> DataFrame:
    """Assertions of the similarTo proposals whose blend of stated score and cosine is high enough."""
    if vectors is None:
        vectors = proposals.sparkSession.createDataFrame([], "id string, vector array<double>")
    rows = validation.similar_relations(proposals.where("relation_type = 'similarTo'"), vectors, "stated", params.similarity_score).where("is_valid")
    return _similar(rows, sites, F.round("score", 2), F.col("cosine"))


def feature_assertions(sites: DataFrame, extracted: DataFrame, label_vectors: DataFrame | None, params: Params) -> DataFrame:
    """Assertions of the extracted features that two sites or more have; similar labels are merged."""
    rows, canonical = extracted.select("category", "label", "entity"), None
    if label_vectors is not None:
        total = features.materialized_features(rows, 0, least=1)
        counts = total.select("category", F.col("feature").alias("label"), "n").distinct()
        canonical = similarity.merge_labels(counts, similarity.vector_pairs(label_vectors, params.label_cosine))
    made = features.materialized_features(rows, sites.count(), canonical)
    digest = F.substring(F.md5(F.concat_ws("|", "category", "feature", "entity")), 1, 8)
    return made.select(F.concat(F.lit("feature_"), digest).alias("assertion_id"), F.lit("extracted_feature").alias("assertion_type"), F.concat("feature", F.lit(" ("), "category", F.lit(")")).alias("label"), F.array("entity").alias("subject_uris"), F.lit("type_analyzer").alias("generated_by"), "confidence", F.col("category").alias("feature_category"), F.col("feature").alias("feature_label"), F.col("entity").alias("entity_uri"))


def fallback_types(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions of the fallbacks Y8 and Y9: clusters of one functional category, and similar feature sets."""
    found = cut(site_features(sites), "features")
    rows = fallback.category_clusters(found, sites).groupBy("category", "confidence").agg(F.array_sort(F.collect_list(F.struct("k", "entity")))["entity"].alias("subject_uris"))
    label = F.concat(F.initcap(F.regexp_replace("category", "^cat:", "")), F.lit(" Sites"))
    clusters = rows.select(assertion_id("fallback_", F.col("category"), F.col("subject_uris")).alias("assertion_id"), F.lit("typological_cluster").alias("assertion_type"), label.alias("label"), "subject_uris", F.lit("type_analyzer").alias("generated_by"), "confidence")
    pairs = similarity.first_feature_pairs(found, sites).withColumnsRenamed({"a": "source", "b": "target"})
    return clusters, _similar(pairs, sites, F.lit(0.5), F.col("similarity"))


_PATH_COLUMNS = ["assertion_id", "assertion_type", "label", "subject_uris", "generated_by", "confidence", "path_type", "theme", "duration_hours"]


def _paths(rows: DataFrame) -> DataFrame:
    digest = F.substring(F.md5(F.concat_ws("|", F.coalesce("theme", F.lit("")), "path_type", F.array_join("subject_uris", ","))), 1, 8)
    return rows.withColumns({"assertion_id": F.concat(F.lit("path_"), digest), "assertion_type": F.lit("thematic_path"), "generated_by": F.lit("path_generator")}).select(*_PATH_COLUMNS).dropDuplicates(["assertion_id"])


def accepted_paths(sites: DataFrame, paths: DataFrame, stops: DataFrame, params: Params) -> DataFrame:
    """Assertions of all path proposals: paths are scored, not filtered (Q9), after long ones are cut."""
    lists = stops.where("member is not null").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "member")))["member"].alias("listed"))
    kept = features.kept_stops(F.coalesce("listed", F.array().cast("array<string>")), params.max_stops)
    own = paths.distinct().withColumn("path_type", F.lower(F.coalesce("path_type", F.lit("mixed")))).join(lists, "path_id", "left").withColumn("subject_uris", kept)
    rows = own.select("path_id", F.posexplode("subject_uris").alias("ord", "member"))
    checked = validation.thematic_paths(rows, sites, own.select("path_id", "path_type"), params.max_path_km).select("path_id", "score", F.col("stops").alias("n"))
    score = F.round(confidence.path(F.col("stated"), F.col("score"), F.col("n"), F.lit(None).cast("double")), 2)
    return _paths(own.join(checked, "path_id").withColumn("confidence", score).withColumn("duration_hours", F.lit(None).cast("double")))


def fallback_paths(clusters: DataFrame, params: Params) -> DataFrame:
    """P5: assertions of a path through each of the first three clusters: geographic, then chronological, then typological ones."""
    rank = F.when(F.col("assertion_type") == "geographic_cluster", 0).when(F.col("assertion_type") == "chronological_cluster", 1).otherwise(2)
    members = clusters.select(F.col("assertion_id").alias("cluster_id"), F.posexplode("subject_uris").alias("ord", "member"))
    rows = fallback.cluster_paths(members, clusters.select(F.col("assertion_id").alias("cluster_id"), rank.alias("rank")), most_stops=params.max_stops)
    lists = rows.groupBy("path_id", "duration_hours").agg(F.array_sort(F.collect_list(F.struct("stop_order", "member")))["member"].alias("subject_uris"))
    names = clusters.select(F.concat(F.lit("path_"), "assertion_id").alias("path_id"), F.concat(F.lit("Visit: "), "label").alias("label"))
    return _paths(lists.join(names, "path_id").withColumns({"theme": F.lit("mixed"), "path_type": F.lit("mixed"), "confidence": F.lit(0.5)}))


def with_stops(paths: DataFrame, sites: DataFrame, params: Params) -> DataFrame:
    """The paths with their stops, and the stops as assertions of their own."""
    stops = features.path_stops(paths.select(F.col("assertion_id").alias("path_id"), F.col("subject_uris").alias("stops")), _names(sites, "id", "name"), params.max_stops)
    stops = stops.withColumn("label", F.concat(F.lit("Stop "), F.col("stop_order").cast("string"), F.lit(": "), "label"))
    none = F.lit(None).cast("string")
    stop = F.struct("stop_order", "stop_id", F.col("member").alias("site_uri"), "label", none.alias("narrative"), none.alias("connection_reason"))
    lists = stops.groupBy(F.col("path_id").alias("assertion_id")).agg(F.transform(F.array_sort(F.collect_list(stop)), lambda x: x.dropFields("stop_order")).alias("stops"))
    scores = paths.select(F.col("assertion_id").alias("path_id"), "confidence", "generated_by")
    single = stops.join(scores, "path_id").select(F.col("stop_id").alias("assertion_id"), F.lit("path_stop").alias("assertion_type"), "label", F.array("member").alias("subject_uris"), "generated_by", "confidence", F.col("member").alias("site_uri"), "stop_order", "path_id")
    return mapping.complete(paths.join(lists, "assertion_id", "left")).unionByName(mapping.complete(single))


@dataclass
class Result:
    """What a run made; all lazily, but for the tables that several steps read."""

    assertions: DataFrame
    triples: DataFrame
    violations: DataFrame
    warnings: DataFrame
    review: DataFrame
    #: (generated_by, assertion_type, proposed) before known assertions were dropped
    proposed: DataFrame | None = None


def run(spark: SparkSession, sites: DataFrame, source: ProposalSource | None = None, history: tuple[DataFrame, ...] | None = None, params: Params | None = None, ns: Namespaces = Namespaces(), with_paths: bool = True) -> Result:
    """Sites (id, load_order, lat, lon, period_label, perhaps name, description, historical_info) to a checked graph.

    ``history`` has the known clusters (item, kind, tokens, confidence), relations (item,
    kind, a, b, confidence) and perhaps paths (item, theme, tokens, confidence); known assertions
    are dropped, a path with its stops. Features are never dropped.
    """
    params = params or Params.load()
    shared_dir(spark)
    extracted = paths = None
    if source is None:
        types, relations = fallback_types(sites)
        clusters = fallback_clusters(sites, params).unionByName(types, allowMissingColumns=True)
    else:
        proposed, pairs, extracted = source.clusters(sites), source.relations(sites), source.features(sites)
        _refuse_others(proposed, "cluster_type", CLUSTER_TYPES)
        _refuse_others(pairs, "relation_type", RELATION_TYPES)
        clusters = accepted_clusters(sites, proposed, params).unionByName(accepted_types(proposed, site_features(sites, extracted), params), allowMissingColumns=True)
        relations = accepted_relations(sites, pairs, params).unionByName(accepted_similar(sites, pairs, source.vectors(sites), params), allowMissingColumns=True)
        if with_paths and (found := source.paths(sites)) is not None:
            paths = accepted_paths(sites, *found, params)
    counted = []
    if history:
        clusters, relations = cut(clusters, "clusters"), cut(relations, "relations")
        counted = [clusters, relations]
        kind = F.regexp_replace("assertion_type", "_cluster$", "")
        items = clusters.select(F.col("assertion_id").alias("item"), kind.alias("kind"), F.col("subject_uris").alias("tokens"))
        fresh = novelty.cluster_novelty(items, history[0], params.cluster_overlap, report_best=False).where("novel").select(F.col("item").alias("assertion_id"))
        clusters = clusters.join(fresh, "assertion_id", "left_semi")
        pairs = relations.select(F.col("assertion_id").alias("item"), F.col("assertion_type").alias("kind"), *novelty.pair_key(F.col("source_uri"), F.col("target_uri")))
        fresh = novelty.relation_novelty(pairs, history[1]).where("novel").select(F.col("item").alias("assertion_id"))
        relations = relations.join(fresh, "assertion_id", "left_semi")
    if source is None and with_paths:
        clusters = cut(clusters, "clusters")
        paths = fallback_paths(clusters, params)
    if paths is not None and history:
        paths = cut(paths, "paths")
        counted.append(paths)
    if paths is not None and history and len(history) > 2:
        items = paths.select(F.col("assertion_id").alias("item"), "theme", F.array_distinct("subject_uris").alias("tokens"))
        fresh = novelty.path_novelty(items, history[2], params.path_overlap, report_best=False).where("novel").select(F.col("item").alias("assertion_id"))
        paths = paths.join(fresh, "assertion_id", "left_semi")
    assertions = mapping.complete(clusters).unionByName(mapping.complete(relations))
    if extracted is not None:
        assertions = assertions.unionByName(mapping.complete(feature_assertions(sites, extracted, source.label_vectors(sites), params)))
    if paths is not None:
        assertions = assertions.unionByName(with_stops(paths, sites, params))
    assertions = cut(assertions.withColumn("created_at", F.coalesce("created_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))), "assertions")
    triples = cut(mapping.triples(assertions, ns), "triples")
    proposed_rows = None
    for rows in counted:
        part = rows.groupBy("generated_by", "assertion_type").agg(F.count("*").alias("proposed"))
        proposed_rows = part if proposed_rows is None else proposed_rows.unionByName(part)
    checks = validate.shape_violations(triples, ns, is_set=True), validate.vocabulary_warnings(triples, ns), validate.review_rows(triples, ns)
    return Result(assertions, triples, *checks, proposed_rows)


def known_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored clusters, relations and paths in the form that :func:`run` takes; what is missing is empty."""
    clusters, relations, paths = read_history(spark, path)
    return (
        clusters.select(F.col("cluster_id").alias("item"), F.col("cluster_type").alias("kind"), F.col("member_uris").alias("tokens"), "confidence"),
        relations.select(F.col("relation_id").alias("item"), F.col("relation_type").alias("kind"), *novelty.pair_key(F.col("source_uri"), F.col("target_uri")), "confidence"),
        paths.select(F.col("path_id").alias("item"), "theme", F.array_distinct("stop_uris").alias("tokens"), "confidence"),
    )


def remember(result: Result, path: str, run_id: str) -> None:
    """K7: append the accepted clusters, relations and paths of a run to the history under ``path``."""
    rows = result.assertions
    when, run_, none = F.col("created_at"), F.lit(run_id).alias("run_id"), F.lit(None).cast("string").alias("metadata")
    kind = F.regexp_replace("assertion_type", "_cluster$", "").alias("cluster_type")
    is_cluster, is_relation = F.col("assertion_type").endswith("_cluster"), F.col("assertion_type").isin(*RELATION_TYPES)
    parts = {
        "clusters": rows.where(is_cluster).select(F.col("assertion_id").alias("cluster_id"), kind, "label", F.col("subject_uris").alias("member_uris"), "confidence", run_, when, none),
        "relations": rows.where(is_relation).select(F.col("assertion_id").alias("relation_id"), F.col("assertion_type").alias("relation_type"), "source_uri", "target_uri", "confidence", run_, when, F.col("relation_value").alias("value"), none),
        "paths": rows.where("assertion_type = 'thematic_path'").select(F.col("assertion_id").alias("path_id"), "theme", "path_type", F.col("subject_uris").alias("stop_uris"), "confidence", run_, when, none),
    }
    for name, part in parts.items():
        append_history(part, path, name)


def novelty_counters(result: Result) -> dict:
    """A2, M7: proposed, novel and filtered assertions by agent; empty where no history was given."""
    if result.proposed is None:
        return {}
    novel = result.assertions.groupBy("generated_by", "assertion_type").agg(F.count("*").alias("novel"))
    both = result.proposed.join(novel, ["generated_by", "assertion_type"], "left").groupBy("generated_by").agg(F.sum("proposed").alias("p"), F.sum(F.coalesce("novel", F.lit(0))).alias("n"))
    return {r["generated_by"]: {"proposed": r["p"], "novel": r["n"], "filtered": r["p"] - r["n"]} for r in both.collect()}  # a row per agent


def finish(result: Result, directory: str, format_: str = "ntriples", run_id: str | None = None, validated: bool = True, history: str | None = None) -> dict:
    """Write the graph and the review queue; returns and writes the run's metadata.

    Without ``validated`` the checks aren't run. Accepted assertions go to the ``history`` last.
    """
    run_id = run_id or time.strftime("run_%Y%m%d_%H%M%S")
    began = time.time()
    base = f"{directory}/{run_id}"
    sinks.write(result.triples, f"{base}/graph", format_)
    result.review.orderBy("confidence", "assertion").write.mode("overwrite").json(f"{base}/review_queue")
    counts = {r["assertion_type"]: r["count"] for r in result.assertions.groupBy("assertion_type").count().collect()}
    errors = {r["rule"]: r["count"] for r in result.violations.groupBy("rule").count().collect()} if validated else {}
    meta = {"run_id": run_id, "novelty_filtering": novelty_counters(result), "assertions_by_type": counts, "assertions_count": sum(counts.values()), "triples_count": result.triples.count(), "violations": errors, "duration_seconds": round(time.time() - began, 2)}
    spark = result.triples.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/metadata")
    if history:
        remember(result, history, run_id)
    return meta
