"""Filters, novelty and reports over the history and batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import confidence
from ..functions.uris import uri_key, uri_set
from ..operators import novelty, ratelimit, reports
from ..sources.tables import table
from .base import ENTITIES, entities, sql_key, sql_valid
from .scalar import SQL_LEVEL, SQL_TIER

#: Paths created from this day on are taken as the batch, older ones as the history.
SPLIT = "2024-05-01"


def sql_set(uris: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({uris}, []), lambda x: {sql_key('x')}), lambda x: x IS NOT NULL)))"


def _sets(spark: SparkSession, d: str, source: str) -> DataFrame:
    """(item, kind, label, tokens, confidence), repeated rows once."""
    rows = table(spark, d, source)
    return rows.select(F.col("cluster_id").alias("item"), F.col("cluster_type").alias("kind"), "label", uri_set(F.col("member_uris")).alias("tokens"), "confidence").distinct()


def _sql_sets(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT cluster_id item, cluster_type kind, label, {sql_set('member_uris')} tokens, confidence FROM {source})"


def _pairs(spark: SparkSession, d: str, source: str) -> DataFrame:
    rows = table(spark, d, source)
    return rows.select(F.col("relation_id").alias("item"), F.col("relation_type").alias("kind"), *novelty.pair_key(uri_key(F.col("source_uri")), uri_key(F.col("target_uri"))), "confidence").distinct()


def _sql_pairs(name: str, source: str) -> str:
    a, b = sql_key("source_uri"), sql_key("target_uri")
    return f"{name} AS (SELECT DISTINCT relation_id item, relation_type kind, least({a}, {b}) a, greatest({a}, {b}) b, confidence FROM {source})"


def f2_dated_sites(spark: SparkSession, d: str) -> DataFrame:
    """sites eligible for dating, and whether their history hints at a period."""
    rows = entities(spark, d)
    hint = F.lower(F.coalesce("historical_info", F.lit(""))).rlike("bronzo|neolitico|millennio|bronze|neolithic")
    return rows.where((F.coalesce("period_label", F.lit("")) != "") | (F.coalesce("historical_info", F.lit("")) != "")).select("id", hint.alias("hint"))


def f3_described_sites(spark: SparkSession, d: str) -> DataFrame:
    some = [F.coalesce(c, F.lit("")) != "" for c in ("description", "historical_info", "category_uri")]
    return entities(spark, d).where(some[0] | some[1] | some[2]).select("id")


def f4_excluded_sites(spark: SparkSession, d: str) -> DataFrame:
    """sites that an analysis leaves out, with the reason, in one pass."""
    from ..functions.geo import valid_coordinates

    rows = entities(spark, d)
    dated = (F.coalesce("period_label", F.lit("")) != "") | (F.coalesce("historical_info", F.lit("")) != "")
    reasons = F.array_compact(F.array(F.when(~valid_coordinates(F.col("lat"), F.col("lon")), "no coordinates"), F.when(~dated, "no period")))
    return rows.select("id", F.explode(reasons).alias("reason"))


def f5_confident_clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "history_clusters").where(F.coalesce("confidence", F.lit(0.0)) >= 0.9).select("cluster_id", "confidence", "run_id").distinct()


def f6_lookups(spark: SparkSession, d: str) -> DataFrame:
    """clusters with, and relations with, the site that most relations start from."""
    hub = table(spark, d, "history_relations").groupBy(uri_key(F.col("source_uri")).alias("site")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "site").limit(1).select("site")
    clusters = _sets(spark, d, "history_clusters").select("item", F.explode("tokens").alias("site"))
    ends = _pairs(spark, d, "history_relations").select("item", F.explode(F.array_distinct(F.array("a", "b"))).alias("site"))
    return clusters.unionByName(ends).join(F.broadcast(hub), "site", "left_semi").select("item").distinct()


def f7_existing_relations(spark: SparkSession, d: str) -> DataFrame:
    seen = _pairs(spark, d, "history_relations").select("kind", "a", "b").distinct()
    return _pairs(spark, d, "batch_relations").join(seen, ["kind", "a", "b"], "left_semi").select("item").distinct()


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _sets(spark, d, "batch_clusters").select("item", "kind", "tokens").distinct(), _sets(spark, d, "history_clusters")


def m4_cluster_novelty(spark: SparkSession, d: str) -> DataFrame:
    return novelty.cluster_novelty(*_clusters(spark, d)).withColumn("similarity", F.round("similarity", 6))


_M4 = f"""{_sql_sets('h', 'history_clusters')}, {_sql_sets('b0', 'batch_clusters')}, b AS (SELECT DISTINCT item, kind, tokens FROM b0),
hs AS (SELECT kind, tokens, min(item) AS match FROM h WHERE confidence >= 0.70 AND len(tokens) > 0 GROUP BY 1, 2),
pr AS (SELECT item, match, na, nb, count(*) n FROM (SELECT item, kind, len(tokens) na, unnest(tokens) t FROM b) x JOIN (SELECT match, kind, len(tokens) nb, unnest(tokens) t FROM hs) y USING (kind, t) GROUP BY 1, 2, 3, 4),
best AS (SELECT item, n::double / (na + nb - n) similarity, match FROM pr QUALIFY row_number() OVER (PARTITION BY item ORDER BY n::double / (na + nb - n) DESC, match) = 1)
SELECT item, round(coalesce(similarity, 0.0), 6) similarity, match, len(tokens) > 0 AND coalesce(similarity, 0.0) < 0.8 novel FROM b LEFT JOIN best USING (item)"""


def m5_relation_novelty(spark: SparkSession, d: str) -> DataFrame:
    items = _pairs(spark, d, "batch_relations").select("item", "kind", "a", "b").distinct()
    return novelty.relation_novelty(items, _pairs(spark, d, "history_relations"))


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    late = F.coalesce(F.col("created_at") >= F.lit(SPLIT).cast("timestamp_ntz"), F.lit(False)).alias("late")
    rows = table(spark, d, "history_paths").select(F.col("path_id").alias("item"), "theme", uri_set(F.col("stop_uris")).alias("tokens"), "confidence", late).distinct()
    return rows.where("late").select("item", "theme", "tokens").distinct(), rows.where("not late").drop("late")


def m6_path_novelty(spark: SparkSession, d: str) -> DataFrame:
    return novelty.path_novelty(*_paths(spark, d)).withColumn("similarity", F.round("similarity", 6))


def m4_novel_clusters(spark: SparkSession, d: str) -> DataFrame:
    """M4's decision alone, with sets that meet on their rarest members."""
    return novelty.cluster_novelty(*_clusters(spark, d), report_best=False).select("item", "novel").distinct()


def m6_novel_paths(spark: SparkSession, d: str) -> DataFrame:
    """M6's decision alone, with sets that meet on their rarest members."""
    return novelty.path_novelty(*_paths(spark, d), report_best=False).select("item", "novel").distinct()


_M6 = f"""p AS (SELECT DISTINCT path_id item, theme, {sql_set('stop_uris')} tokens, confidence, coalesce(created_at >= TIMESTAMP '{SPLIT}', false) late FROM history_paths),
it AS (SELECT DISTINCT item, theme, tokens FROM p WHERE late),
pr AS (SELECT item, match, na, nb, ta, tb, count(*) n FROM (SELECT item, lower(theme) ta, len(tokens) na, unnest(tokens) t FROM it) x JOIN (SELECT item AS match, lower(theme) tb, len(tokens) nb, unnest(tokens) t FROM p WHERE NOT late AND confidence >= 0.70) y USING (t) GROUP BY 1, 2, 3, 4, 5, 6),
sc AS (SELECT item, match, CASE WHEN ta = tb THEN least(1.0, n::double / (na + nb - n) * 1.2) ELSE n::double / (na + nb - n) END similarity FROM pr),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY item ORDER BY similarity DESC, match) = 1)
SELECT item, round(coalesce(similarity, 0.0), 6) similarity, match, len(tokens) > 0 AND coalesce(similarity, 0.0) < 0.7 novel FROM it LEFT JOIN best USING (item)"""


def m9_novelty_counters(spark: SparkSession, d: str) -> DataFrame:
    """A2, M7, M9: proposed, novel and filtered items by agent, and in all."""
    kinds = _sets(spark, d, "batch_clusters").select("item", "kind").distinct()
    clusters = m4_cluster_novelty(spark, d).join(kinds, "item").select(F.col("kind").alias("agent"), "novel")
    relations = m5_relation_novelty(spark, d).select(F.lit("relations").alias("agent"), "novel")
    return reports.novelty_totals(clusters.unionByName(relations))


def _sql_cte(text: str) -> str:
    """The CTEs of a query and its last SELECT as one more, named ``last``."""
    head, tail = text.rsplit("\nSELECT ", 1)
    return f"{head}, last AS (SELECT {tail})"


def m8_novelty_statistics(spark: SparkSession, d: str) -> DataFrame:
    """M8: how many clusters, undirected relations and paths of the history count."""
    parts = (("clusters", _sets(spark, d, "history_clusters").select("item", "confidence")), ("relations", _pairs(spark, d, "history_relations").select(F.concat_ws("|", "kind", "a", "b").alias("item"), "confidence")), ("paths", table(spark, d, "history_paths").select(F.col("path_id").alias("item"), "confidence")))
    out = None
    for name, rows in parts:
        one = novelty.known(rows).agg(F.countDistinct("item").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def m10_history_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.history_summary(table(spark, d, "history_clusters"), table(spark, d, "history_relations"), table(spark, d, "history_paths"))


def m11_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _sets(spark, d, "history_clusters").select("item", "kind", "label", "tokens").distinct()
    return reports.context_lines(rows)


def _assertions(spark: SparkSession, d: str) -> DataFrame:
    """(item, kind, confidence, run_id) of all stored clusters, relations and paths, repeated rows once."""
    parts = [table(spark, d, t).select(F.col(i).alias("item"), F.col(k).alias("kind"), "confidence", "run_id").distinct() for t, i, k in (("history_clusters", "cluster_id", "cluster_type"), ("history_relations", "relation_id", "relation_type"), ("history_paths", "path_id", "path_type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ASSERTIONS = "ass AS (SELECT DISTINCT cluster_id item, cluster_type kind, confidence, run_id FROM history_clusters UNION ALL SELECT DISTINCT relation_id, relation_type, confidence, run_id FROM history_relations UNION ALL SELECT DISTINCT path_id, path_type, confidence, run_id FROM history_paths)"


def a1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _assertions(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def a3_tiers(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_tier(_assertions(spark, d))


def a4_stability(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "history_clusters").select("run_id", F.lit("cluster").alias("kind"), F.concat_ws("|", "cluster_type", F.array_join(uri_set(F.col("member_uris")), ",")).alias("item"))
    relations = table(spark, d, "history_relations").select("run_id", F.lit("relation").alias("kind"), F.concat_ws("|", "relation_type", uri_key(F.col("source_uri")), uri_key(F.col("target_uri"))).alias("item"))
    return reports.stability(clusters.unionByName(relations))


_A4 = f"""own AS (SELECT DISTINCT run_id, kind, item FROM (SELECT run_id, 'cluster' kind, cluster_type || '|' || array_to_string({sql_set('member_uris')}, ',') item FROM history_clusters UNION ALL SELECT run_id, 'relation', relation_type || '|' || {sql_key('source_uri')} || '|' || {sql_key('target_uri')} FROM history_relations)),
fi AS (SELECT run_id, kind, count(*) new_items FROM (SELECT kind, item, min(run_id) run_id FROM own GROUP BY 1, 2) GROUP BY 1, 2),
r AS (SELECT run_id, kind, count(*) distinct_items, coalesce(any_value(new_items), 0) new_items FROM own LEFT JOIN fi USING (run_id, kind) GROUP BY 1, 2)
SELECT run_id, kind, distinct_items, new_items, CAST(sum(new_items) OVER (PARTITION BY kind ORDER BY run_id) AS bigint) cumulative, round(new_items::double / greatest(distinct_items, 1), 3) novelty FROM r"""


def a5_saturation(spark: SparkSession, d: str) -> DataFrame:
    return reports.saturation(_assertions(spark, d).groupBy("run_id").agg(F.count("*").alias("n")))


def a6_confidence_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reports.confidence_statistics(_assertions(spark, d).select(F.col("kind").alias("key"), "confidence"))


def _corpora(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "history_clusters").select("cluster_id", F.col("cluster_type").alias("kind"), "confidence").distinct().select(F.lit("history").alias("corpus"), "kind", "confidence")
    b = table(spark, d, "batch_clusters").select("cluster_id", F.col("cluster_type").alias("kind"), "confidence").distinct().select(F.lit("batch").alias("corpus"), "kind", "confidence")
    return a.unionByName(b)


_CORPORA = "cor AS (SELECT 'history' corpus, kind, confidence FROM (SELECT DISTINCT cluster_id, cluster_type kind, confidence FROM history_clusters) UNION ALL SELECT 'batch', kind, confidence FROM (SELECT DISTINCT cluster_id, cluster_type kind, confidence FROM batch_clusters))"


def a7_corpora(spark: SparkSession, d: str) -> DataFrame:
    return reports.compare_corpora(_corpora(spark, d))


def a8_means(spark: SparkSession, d: str) -> DataFrame:
    return reports.mean_by_kind(_corpora(spark, d), ["history", "batch"])


def a9_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(_corpora(spark, d))


def a10_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_by_kind(_assertions(spark, d))


def a11_completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).withColumn("located", F.col("lat").isNotNull())
    source = F.when(F.col("geometry_uri").isNull(), "no geometry").when(F.col("located"), "geometry").otherwise("unresolved")
    return rows.groupBy("located", source.alias("source")).agg(F.count("*").alias("n"))


def a12_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sites that clusters or relations name, as a share of all sites, and kinds of assertions."""
    sites = entities(spark, d).select("id")
    named = _sets(spark, d, "history_clusters").select(F.explode("tokens").alias("id")).unionByName(_pairs(spark, d, "history_relations").select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    covered = sites.join(named, "id", "left_semi").agg(F.count("*").alias("covered"))
    kinds = _assertions(spark, d).agg(F.countDistinct("kind").alias("kinds"))
    one = sites.agg(F.count("*").alias("sites")).withColumn("one", F.lit(1))
    rows = one.join(covered.withColumn("one", F.lit(1)), "one").join(kinds.withColumn("one", F.lit(1)), "one")
    return rows.select("sites", "covered", F.round(F.col("covered") / F.col("sites"), 6).alias("ratio"), "kinds")


def a15_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Stated against computed score of relations that carry both."""
    rows = table(spark, d, "history_relations").where("relation_type != 'nearTo' and value is not null and confidence is not null")
    return rows.select("relation_id", F.col("confidence").alias("stated"), F.col("value").alias("computed"), F.round(F.abs(F.col("confidence") - F.col("value")), 6).alias("apart")).distinct()


def c9_report(spark: SparkSession, d: str) -> DataFrame:
    out = reports.confidence_report(_assertions(spark, d))
    return out.withColumn("mean", F.round("mean", 6))


def c10_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by falling confidence, null as 0, ties by id; a range-partitioned sort."""
    rows = table(spark, d, "history_clusters").select("cluster_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).distinct()
    return rows.orderBy(F.col("confidence").desc(), "cluster_id")


def v10_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Assertions that wait for review, least confident first."""
    rows = _assertions(spark, d).where(confidence.tier(F.col("confidence")) == "PendingReview").select("item", "kind", "confidence").distinct()
    return rows.orderBy("confidence", "item")


def l1_waits(spark: SparkSession, d: str) -> DataFrame:
    return ratelimit.waits(table(spark, d, "events").select("event_id", "ts"), per_minute=2, per_day=400)


QUERIES = {
    "f2_dated_sites": f2_dated_sites, "f3_described_sites": f3_described_sites, "f4_excluded_sites": f4_excluded_sites, "f5_confident_clusters": f5_confident_clusters,
    "f6_lookups": f6_lookups, "f7_existing_relations": f7_existing_relations, "m4_cluster_novelty": m4_cluster_novelty, "m4_novel_clusters": m4_novel_clusters, "m5_relation_novelty": m5_relation_novelty,
    "m6_path_novelty": m6_path_novelty, "m6_novel_paths": m6_novel_paths, "m8_novelty_statistics": m8_novelty_statistics, "m9_novelty_counters": m9_novelty_counters, "m10_history_summary": m10_history_summary, "m11_context": m11_context,
    "a1_counts": a1_counts, "a3_tiers": a3_tiers, "a4_stability": a4_stability, "a5_saturation": a5_saturation, "a6_confidence_statistics": a6_confidence_statistics,
    "a7_corpora": a7_corpora, "a8_means": a8_means, "a9_histogram": a9_histogram, "a10_summary": a10_summary, "a11_completeness": a11_completeness, "a12_coverage": a12_coverage,
    "a15_calibration": a15_calibration, "c9_report": c9_report, "c10_sorted": c10_sorted, "v10_review_queue": v10_review_queue, "l1_waits": l1_waits,
}
_TIER = SQL_TIER.format("confidence")
SQL = {
    "f2_dated_sites": f"WITH {ENTITIES} SELECT id, regexp_matches(lower(coalesce(historical_info, '')), 'bronzo|neolitico|millennio|bronze|neolithic') hint FROM entities WHERE coalesce(period_label, '') <> '' OR coalesce(historical_info, '') <> ''",
    "f3_described_sites": f"WITH {ENTITIES} SELECT id FROM entities WHERE coalesce(description, '') <> '' OR coalesce(historical_info, '') <> '' OR coalesce(category_uri, '') <> ''",
    "f4_excluded_sites": f"WITH {ENTITIES} SELECT id, 'no coordinates' reason FROM entities WHERE NOT {sql_valid('lat', 'lon')} UNION ALL SELECT id, 'no period' FROM entities WHERE coalesce(period_label, '') = '' AND coalesce(historical_info, '') = ''",
    "f5_confident_clusters": "SELECT DISTINCT cluster_id, confidence, run_id FROM history_clusters WHERE coalesce(confidence, 0.0) >= 0.9",
    "f6_lookups": f"WITH {_sql_sets('c', 'history_clusters')}, {_sql_pairs('p', 'history_relations')}, hub AS (SELECT {sql_key('source_uri')} site FROM history_relations GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT DISTINCT item FROM (SELECT item, unnest(tokens) site FROM c UNION ALL SELECT item, a FROM p UNION ALL SELECT item, b FROM p) WHERE site IN (SELECT site FROM hub)",
    "f7_existing_relations": f"WITH {_sql_pairs('h', 'history_relations')}, {_sql_pairs('b', 'batch_relations')} SELECT DISTINCT item FROM b AS x WHERE EXISTS (SELECT 1 FROM h WHERE h.kind = x.kind AND h.a = x.a AND h.b = x.b)",
    "m4_cluster_novelty": f"WITH {_M4}",
    "m4_novel_clusters": f"WITH {_sql_cte(_M4)} SELECT DISTINCT item, novel FROM last",
    "m6_novel_paths": f"WITH {_sql_cte(_M6)} SELECT DISTINCT item, novel FROM last",
    "m5_relation_novelty": f"WITH {_sql_pairs('h', 'history_relations')}, {_sql_pairs('b0', 'batch_relations')}, x AS (SELECT DISTINCT item, kind, a, b FROM b0) SELECT item, NOT EXISTS (SELECT 1 FROM h WHERE confidence >= 0.70 AND h.kind = x.kind AND h.a = x.a AND h.b = x.b) novel FROM x",
    "m6_path_novelty": f"WITH {_M6}",
    "m8_novelty_statistics": f"WITH {_sql_pairs('p', 'history_relations')} SELECT 'clusters' part, count(DISTINCT cluster_id) n FROM history_clusters WHERE confidence >= 0.70 UNION ALL SELECT 'relations', count(DISTINCT kind || '|' || a || '|' || b) FROM p WHERE confidence >= 0.70 UNION ALL SELECT 'paths', count(DISTINCT path_id) FROM history_paths WHERE confidence >= 0.70",
    "m9_novelty_counters": f"WITH {_sql_cte(_M4)}, {_sql_pairs('hr', 'history_relations')}, {_sql_pairs('br0', 'batch_relations')}, br AS (SELECT DISTINCT item, kind, a, b FROM br0), un AS (SELECT kind agent, novel FROM last JOIN (SELECT DISTINCT item, kind FROM b) USING (item) UNION ALL SELECT 'relations', NOT EXISTS (SELECT 1 FROM hr WHERE confidence >= 0.70 AND hr.kind = br.kind AND hr.a = br.a AND hr.b = br.b) FROM br) SELECT agent, count(*) proposed, count(*) FILTER (novel) novel, count(*) - count(*) FILTER (novel) filtered, round(count(*) FILTER (novel) / count(*)::double, 6) rate FROM un GROUP BY ROLLUP (agent)",
    "m10_history_summary": "SELECT 'cluster' part, cluster_type AS name, count(*) n FROM history_clusters GROUP BY 2 UNION ALL SELECT 'relation', relation_type, count(*) FROM history_relations GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'theme', theme, count(*) FROM history_paths WHERE theme IS NOT NULL GROUP BY 2 ORDER BY theme LIMIT 10)",
    "m11_context": f"WITH {_sql_sets('c0', 'history_clusters')}, c AS (SELECT DISTINCT item, kind, label, tokens FROM c0), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY item) k, count(*) OVER (PARTITION BY kind) total FROM c) SELECT kind, k::int k, '- ' || coalesce(label, '') || ': ' || array_to_string(tokens[1:3], ', ') || CASE WHEN len(tokens) > 3 THEN ' +' || (len(tokens) - 3)::varchar || ' more' ELSE '' END line, greatest(total - 10, 0) more FROM r WHERE k <= 10",
    "a1_counts": f"WITH {_ASSERTIONS} SELECT kind, count(*) n FROM ass GROUP BY 1",
    "a3_tiers": f"WITH {_ASSERTIONS}, t AS (SELECT kind, {_TIER} tier FROM ass) SELECT kind, tier, count(*) n FROM t GROUP BY GROUPING SETS ((tier), (kind, tier))",
    "a4_stability": f"WITH {_A4}",
    "a5_saturation": f"WITH {_ASSERTIONS}, r AS (SELECT run_id, count(*) assertions FROM ass GROUP BY 1) SELECT row_number() OVER (ORDER BY run_id)::int AS position, run_id, assertions, CAST(sum(assertions) OVER (ORDER BY run_id) AS bigint) cumulative FROM r",
    "a6_confidence_statistics": f"WITH {_ASSERTIONS} SELECT kind AS key, count(*) n, round(avg(confidence), 6) mean, round(list_sort(list(confidence))[CAST(floor(count(*) / 2) AS int) + 1], 6) median, round(min(confidence), 6) least, round(max(confidence), 6) greatest, round(stddev_pop(confidence), 6) sd FROM ass WHERE confidence IS NOT NULL GROUP BY 1",
    "a7_corpora": f"WITH {_CORPORA}, t AS (SELECT *, {_TIER} tier FROM cor WHERE confidence IS NOT NULL) SELECT corpus, count(*) n, round(avg(confidence), 6) mean, round(stddev_pop(confidence), 6) sd, min(confidence) least, max(confidence) greatest, round(count(*) FILTER (tier = 'Validated') / count(*)::double, 6) validated, round(count(*) FILTER (tier = 'PendingReview') / count(*)::double, 6) pending, round(count(*) FILTER (tier = 'Rejected') / count(*)::double, 6) rejected FROM t GROUP BY 1",
    "a8_means": f"WITH {_CORPORA} SELECT kind, coalesce(round(avg(confidence) FILTER (corpus = 'history'), 6), 0.0) history, coalesce(round(avg(confidence) FILTER (corpus = 'batch'), 6), 0.0) batch FROM cor GROUP BY 1",
    "a9_histogram": f"WITH {_CORPORA} SELECT corpus, CAST(greatest(floor((confidence - 0.45) / 0.05 + 1e-9), -1) AS bigint) bin, count(*) n FROM cor WHERE confidence IS NOT NULL GROUP BY 1, 2",
    "a10_summary": f"WITH {_ASSERTIONS} SELECT kind, count(*) n, round(avg(confidence), 6) mean, round(count(*) FILTER (confidence >= 0.70) / count(*)::double, 6) validated_share FROM ass GROUP BY ROLLUP (kind)",
    "a11_completeness": f"WITH {ENTITIES} SELECT lat IS NOT NULL located, CASE WHEN geometry_uri IS NULL THEN 'no geometry' WHEN lat IS NOT NULL THEN 'geometry' ELSE 'unresolved' END source, count(*) n FROM entities GROUP BY 1, 2",
    "a12_coverage": f"WITH {ENTITIES}, {_ASSERTIONS}, {_sql_sets('c', 'history_clusters')}, {_sql_pairs('p', 'history_relations')}, nm AS (SELECT unnest(tokens) id FROM c UNION SELECT a FROM p UNION SELECT b FROM p) SELECT count(*) sites, count(*) FILTER (id IN (SELECT id FROM nm WHERE id IS NOT NULL)) covered, round(count(*) FILTER (id IN (SELECT id FROM nm WHERE id IS NOT NULL)) / count(*)::double, 6) ratio, (SELECT count(DISTINCT kind) FROM ass) kinds FROM entities",
    "a15_calibration": "SELECT DISTINCT relation_id, confidence stated, value computed, round(abs(confidence - value), 6) apart FROM history_relations WHERE relation_type <> 'nearTo' AND value IS NOT NULL AND confidence IS NOT NULL",
    "c9_report": f"WITH {_ASSERTIONS}, l AS (SELECT coalesce(confidence, 0.0) c, {SQL_LEVEL.format('coalesce(confidence, 0.0)')} lv FROM ass) SELECT count(*) n, round(coalesce(avg(c), 0.0), 6) mean, coalesce(min(c), 0.0) least, coalesce(max(c), 0.0) greatest, count(*) FILTER (lv = 'high') high, count(*) FILTER (lv = 'medium') medium, count(*) FILTER (lv = 'low') low, count(*) FILTER (lv = 'very_low') very_low FROM l",
    "c10_sorted": "SELECT DISTINCT cluster_id, coalesce(confidence, 0.0) confidence FROM history_clusters ORDER BY 2 DESC, 1",
    "v10_review_queue": f"WITH {_ASSERTIONS} SELECT DISTINCT item, kind, confidence FROM ass WHERE {_TIER} = 'PendingReview'",
    "l1_waits": "SELECT event_id, (count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))::bigint in_minute, (count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))::bigint in_day, round(greatest(0.0, 60 - coalesce(epoch(ts) - epoch(lag(ts, 2) OVER (ORDER BY ts, event_id)), 1e9)), 3) wait_seconds, (count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)) > 400 over_quota FROM events",
}
