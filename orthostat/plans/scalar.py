"""Scalar functions over whole tables: parsing, periods, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import confidence, geo, period, text, uris
from ..functions.sets import jaccard
from ..operators.spatial import point_of_wkt
from ..sources.tables import table
from .base import sql_haversine, sql_key, sql_name, sql_period, sql_region, sql_valid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CATALOGUE, DATA = "https://example.org/catalogue/", "https://example.org/data/"


def _scalar(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], where: str = "true") -> None:
    """Register a query that computes columns of one table row by row."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, source).where(where).select(*key.split(", "), *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = query
    SQL[name] = f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {source} WHERE {where}"


c = F.col
_scalar("n1_site_name", "sites", "record_id", lambda: {"name": text.site_name(c("label"))}, {"name": sql_name("label")})
_scalar("n2_period_in_label", "sites", "record_id", lambda: {"period": text.period_in_label(c("label"))}, {"period": sql_period("label")})
_PLACE = "regexp_extract(coverage, '^([^(]+)\\s*\\(([^)]+)\\)', {})"
_MUNICIPALITY = f"CASE WHEN coverage = '' OR coverage IS NULL THEN NULL WHEN {_PLACE.format(1)} <> '' THEN trim({_PLACE.format(1)}) ELSE trim(coverage) END"
_scalar("n3_location", "sites", "record_id", lambda: {"municipality": text.municipality(c("coverage")), "province": text.province(c("coverage"))}, {"municipality": _MUNICIPALITY, "province": f"CASE WHEN {_PLACE.format(2)} <> '' THEN trim({_PLACE.format(2)}) END"})
_LAST = "replace(regexp_extract(regexp_replace({0}, '/+$', ''), '[^/]*$'), '-', ' ')"
_scalar("n4_category", "sites", "record_id", lambda: {"category": text.category_of(c("category_uri"))}, {"category": f"CASE WHEN category_uri <> '' THEN {_LAST.format('category_uri')} END"})
_scalar("n5_context", "sites", "record_id", lambda: {"context": text.context_of(c("context_type_uri"))}, {"context": f"CASE WHEN context_type_uri <> '' THEN replace({_LAST.format('context_type_uri')}, 'contesto ', '') END"})


def _wkt(k: int) -> Column:
    return point_of_wkt(c("wkt"))[k]


_POINT = "(?i)^\\s*(?:SRID\\s*=\\s*[0-9]+\\s*;)?\\s*POINT\\s*(?:ZM|Z|M)?\\s*\\(\\s*([-+]?[0-9.]+)\\s+([-+]?[0-9.]+)(?:\\s+[-+0-9.eE]+)*\\s*\\)\\s*$"
_scalar("n6_wkt_point", "geometries", "geometry_uri", lambda: {"lat": _wkt(0), "lon": _wkt(1)}, {"lat": f"try_cast(nullif(regexp_extract(wkt, '{_POINT}', 2), '') AS double)", "lon": f"try_cast(nullif(regexp_extract(wkt, '{_POINT}', 1), '') AS double)"})
_ADDRESS = "concat_ws(', ', 'ITALIA', region_id, coverage)"


def _address() -> Column:
    return F.concat_ws(", ", F.lit("ITALIA"), c("region_id"), c("coverage"))


_scalar(
    "n7_address_parts", "sites", "record_id", lambda: {"address_region": text.address_region(_address()), "address_province": text.address_province(_address())},
    {"address_region": f"CASE WHEN trim(string_split({_ADDRESS}, ',')[2]) <> 'ITALIA' THEN trim(string_split({_ADDRESS}, ',')[2]) END", "address_province": f"CASE WHEN length(trim(string_split({_ADDRESS}, ',')[3])) <= 3 THEN trim(string_split({_ADDRESS}, ',')[3]) END"},
)
_scalar("n8_region_name", "sites", "record_id", lambda: {"region": text.region_name(c("region_id"))}, {"region": sql_region("region_id")})
_scalar("n9_display_name", "sites", "record_id", lambda: {"display_name": text.display_name(text.site_name(c("label")), c("label"))}, {"display_name": f"coalesce(nullif(trim({sql_name('label')}), ''), trim(string_split(label, ',')[1]))"})


def _sql_normal(label: str, part: int) -> str:
    """The SQL of one part (0 name, 1 start, 2 end) of a normalised period."""
    low = f"trim(lower({label}))"
    value = lambda name, years: (f"'{name.title()}'", str(years[0]), str(years[1]))[part]
    cases = " ".join(f"WHEN contains({low}, '{w}') THEN {value(w, y)}" for w, y in period.PERIODS.items())
    return f"CASE {cases} WHEN regexp_matches({low}, 'millenni(o|um)') AND regexp_matches({low}, '[0-9]|[ivx]') THEN {('''\'Millennium-based\'''', '-5000', '-2000')[part]} END"


_scalar(
    "n10_normalized_period", "sites", "record_id",
    lambda: {k: period.normalized_period(text.period_in_label(c("label")))[k] for k in ("period", "start_year", "end_year")},
    {k: _sql_normal(f"({sql_period('label')})", i) for i, k in enumerate(("period", "start_year", "end_year"))},
)
_REF = "CASE WHEN contains({0}, 'dati.beniculturali.it') OR contains(lower({0}), 'arco') THEN '" + CATALOGUE + "' || regexp_extract(regexp_replace({0}, '/+$', ''), '[^/]*$') WHEN {0} LIKE 'http://%' OR {0} LIKE 'https://%' THEN {0} WHEN {0} <> '' THEN '" + DATA + "' || {0} END"
_scalar("n12_reference", "history_relations", "relation_id, run_id", lambda: {"source": text.reference_of(c("source_uri"), CATALOGUE, DATA), "target": text.reference_of(c("target_uri"), CATALOGUE, DATA)}, {"source": _REF.format("source_uri"), "target": _REF.format("target_uri")})
_H = "(n_chars / 300.0)"
_scalar(
    "n13_duration", "documents", "doc_id", lambda: {"duration": text.duration_of(c("n_chars") / 300.0)},
    {"duration": f"CASE WHEN trunc({_H}) = 0 AND round_even(({_H} - trunc({_H})) * 60, 0) = 0 THEN 'PT0H' ELSE 'PT' || CASE WHEN trunc({_H}) > 0 THEN CAST(CAST(trunc({_H}) AS bigint) AS varchar) || 'H' ELSE '' END || CASE WHEN round_even(({_H} - trunc({_H})) * 60, 0) > 0 THEN CAST(CAST(round_even(({_H} - trunc({_H})) * 60, 0) AS bigint) AS varchar) || 'M' ELSE '' END END"},
)
_scalar("n14_theme_slug", "history_paths", "path_id, run_id", lambda: {"slug": text.slug(c("theme"))}, {"slug": "translate(lower(theme), ' -', '__')"})
_FEATURE = "trim(regexp_replace(regexp_replace(lower(trim(label)), '[_-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_scalar("n15_feature_label", "typological_clusters", "assertion_id", lambda: {"feature": text.feature_label(c("label"))}, {"feature": f"CASE {_FEATURE} WHEN 'periurban' THEN 'peri urban' WHEN 'piedritti' THEN 'piedritto' ELSE {_FEATURE} END"})
_scalar("n16_excerpts", "documents", "doc_id", lambda: {f"cut_{n}": text.excerpt(c("text"), n) for n in (100, 200)}, {f"cut_{n}": f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END" for n in (100, 200)})
_SAYS = "CASE event_id % 3 WHEN 0 THEN '''retryDelay'': ''' || CAST(event_id % 50 AS varchar) || 's''' WHEN 1 THEN '''retryDelay'': ''' || CAST(event_id % 900 AS varchar) || '.5ms''' ELSE 'Please retry in ' || CAST(event_id % 40 AS varchar) || '.25s.' END"


def _message() -> Column:
    n = lambda m: (c("event_id") % m).cast("string")
    return F.when(c("event_id") % 3 == 0, F.concat(F.lit("'retryDelay': '"), n(50), F.lit("s'"))).when(c("event_id") % 3 == 1, F.concat(F.lit("'retryDelay': '"), n(900), F.lit(".5ms'"))).otherwise(F.concat(F.lit("Please retry in "), n(40), F.lit(".25s.")))


_scalar(
    "n17_retry_delay", "events", "event_id", lambda: {"seconds": F.round(text.retry_delay(_message()), 6)},
    {"seconds": f"round(CASE WHEN regexp_extract({_SAYS}, '''retryDelay'':\\s*''([\\d.]+)(s|ms)''', 2) = 'ms' THEN CAST(regexp_extract({_SAYS}, '''retryDelay'':\\s*''([\\d.]+)(s|ms)''', 1) AS double) / 1000 WHEN regexp_extract({_SAYS}, '''retryDelay'':\\s*''([\\d.]+)(s|ms)''', 2) = 's' THEN CAST(regexp_extract({_SAYS}, '''retryDelay'':\\s*''([\\d.]+)(s|ms)''', 1) AS double) ELSE try_cast(nullif(regexp_extract({_SAYS}, 'Please retry in ([\\d.]+)s', 1), '') AS double) END, 6)"},
)
_scalar(
    "n18_json_in_reply", "events", "event_id", lambda: {"found": text.json_in(F.concat(F.lit("Reply: "), c("props"), F.lit(" end")))},
    {"found": "CASE WHEN regexp_extract('Reply: ' || props || ' end', '(?s)\\{.*\\}') <> '' THEN regexp_extract('Reply: ' || props || ' end', '(?s)\\{.*\\}') WHEN regexp_extract('Reply: ' || props || ' end', '(?s)\\[.*\\]') <> '' THEN regexp_extract('Reply: ' || props || ' end', '(?s)\\[.*\\]') END"},
)


def _fenced() -> Column:
    return F.concat(F.lit("```json"), c("props"), F.lit("``` done"))


_scalar("n20_unfenced_reply", "events", "event_id", lambda: {"body": text.unfenced(_fenced()), "agent": F.get_json_object(text.unfenced(_fenced()), "$.page")}, {"body": "string_split(string_split('```json' || props || '``` done', '```json')[2], '```')[1]", "agent": "json_extract_string(props, '$.page')"})
_scalar("n23_cache_key", "history_clusters", "cluster_id, run_id", lambda: {"cache_key": text.cache_key(c("member_uris"))}, {"cache_key": "md5(array_to_string(list_sort(list_distinct(list_filter(member_uris, lambda x: x IS NOT NULL))), ''))"})
_scalar("uri_keys", "history_relations", "relation_id, run_id", lambda: {"a": uris.uri_key(c("source_uri")), "b": uris.uri_key(c("target_uri"))}, {"a": sql_key("source_uri"), "b": sql_key("target_uri")})
_scalar("f1_valid_coordinates", "geometries", "geometry_uri", lambda: {"valid": geo.valid_coordinates(c("latitude"), c("longitude"))}, {"valid": sql_valid("latitude", "longitude")})
_scalar("g1_haversine", "geometries", "geometry_uri", lambda: {"km": F.round(geo.haversine_km(c("latitude"), c("longitude"), F.lit(41.9), F.lit(12.5)), 6)}, {"km": f"round({sql_haversine('latitude', 'longitude', '41.9', '12.5')}, 6)"}, where="latitude between -90 and 90 and longitude between -180 and 180")
_WORDS = "list_concat(list_filter([" + ", ".join(f"'{w}'" for w in text.ARCHITECTURE_WORDS) + "], lambda w: contains(lower(text), w)), list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(ws)}') THEN 'cat:{k}' END" for k, ws in text.FUNCTION_WORDS.items()) + "], lambda w: w IS NOT NULL))"
_scalar("y4_features_in_text", "documents", "doc_id", lambda: {"features": F.array_join(text.features_in(c("text")), "|")}, {"features": f"array_to_string({_WORDS}, '|')"})
_A, _B = ("list_distinct(list_filter(%s, lambda x: x IS NOT NULL))" % n for n in ("shared_features", "architectural_features"))
_scalar("y1_jaccard", "typological_clusters", "assertion_id", lambda: {"similarity": F.round(jaccard(c("shared_features"), c("architectural_features")), 6)}, {"similarity": f"round(CASE WHEN coalesce(len({_A}), 0) = 0 OR coalesce(len({_B}), 0) = 0 THEN 0.0 ELSE len(list_intersect({_A}, {_B}))::double / len(list_distinct(list_concat({_A}, {_B}))) END, 6)"})


# --- confidence: the stated score is a row's confidence, the computed one comes from its value ---
def sql_clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def sql_hybrid(a: str, b: str) -> str:
    a, b = sql_clamp(a), sql_clamp(b)
    return f"(CASE WHEN abs({a} - {b}) > 0.4 THEN greatest(0.0, 0.7 * {a} + 0.3 * {b} - 0.3 * (abs({a} - {b}) - 0.4)) ELSE 0.7 * {a} + 0.3 * {b} END)"


def sql_cluster(a: str, b: str, n: str) -> str:
    h = sql_hybrid(a, b)
    return f"(CASE WHEN {n} < 2 THEN greatest(0.0, {h} - 0.2 * (2 - {n}) / 2) WHEN {n} >= 5 THEN least(1.0, {h} + 0.1 * least(1.0, ({n} - 5) / 5.0)) ELSE {h} END)"


def sql_relation(a: str, b: str, strength: str) -> str:
    h = sql_hybrid(a, b)
    return f"(CASE WHEN {strength} IS NOT NULL THEN 0.8 * {h} + 0.2 * {sql_clamp(strength)} ELSE {h} END)"


def sql_path(a: str, b: str, n: str, narrative: str) -> str:
    h = f"(CASE WHEN {n} >= 5 THEN {sql_hybrid(a, b)} * greatest(0.8, 1 - 0.05 * ({n} - 5)) ELSE {sql_hybrid(a, b)} END)"
    return f"(CASE WHEN {narrative} IS NOT NULL THEN 0.85 * {h} + 0.15 * {narrative} ELSE {h} END)"


SQL_TIER = "CASE WHEN {0} >= 0.70 THEN 'Validated' WHEN {0} >= 0.60 THEN 'PendingReview' ELSE 'Rejected' END"
SQL_LEVEL = "CASE WHEN {0} >= 0.8 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' WHEN {0} >= 0.3 THEN 'low' ELSE 'very_low' END"
_V, _N = "(l_discount * 10)", "l_linenumber"
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_scalar("c1_hybrid", "lineitem", _LINE, lambda: {"score": F.round(confidence.hybrid(c("l_tax") * 12.5, c("l_discount") * 10), 6), "plain": F.round(confidence.hybrid(c("l_tax") * 12.5, c("l_discount") * 10, penalty=False), 6)}, {"score": f"round({sql_hybrid('(l_tax * 12.5)', _V)}, 6)", "plain": f"round(0.7 * {sql_clamp('(l_tax * 12.5)')} + 0.3 * {sql_clamp(_V)}, 6)"})
_scalar("c2_cluster", "lineitem", _LINE, lambda: {"score": F.round(confidence.cluster(c("l_tax") * 12.5, c("l_discount") * 10, c("l_linenumber")), 6)}, {"score": f"round({sql_cluster('(l_tax * 12.5)', _V, _N)}, 6)"})
_scalar("c3_relation", "history_relations", "relation_id, run_id", lambda: {"score": F.round(confidence.relation(c("confidence"), F.lit(0.8), c("value")), 6)}, {"score": f"round({sql_relation('confidence', '0.8', 'value')}, 6)"})
_scalar("c4_path", "lineitem", _LINE, lambda: {"score": F.round(confidence.path(c("l_tax") * 12.5, c("l_discount") * 10, c("l_linenumber"), F.when(c("l_linenumber") % 2 == 0, c("l_tax") * 10)), 6)}, {"score": f"round({sql_path('(l_tax * 12.5)', _V, _N, '(CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 10 END)')}, 6)"})
_scalar("c5_feature", "part", "p_partkey", lambda: {"score": F.round(confidence.feature(c("p_size"), F.lit(50), F.when(c("p_partkey") % 2 == 0, "architectural").otherwise("functional")), 6)}, {"score": "round(greatest(0.30, least(0.95, 0.70 + least(0.15, 0.30 * (p_size / 50.0)) + CASE WHEN p_partkey % 2 = 0 THEN 0.05 ELSE 0.0 END)), 6)"})
_scalar("c7_level", "history_clusters", "cluster_id, run_id", lambda: {"level": confidence.level(c("confidence"))}, {"level": SQL_LEVEL.format("confidence")})
_scalar("c8_tier", "history_clusters", "cluster_id, run_id", lambda: {"tier": confidence.tier(c("confidence"))}, {"tier": SQL_TIER.format("confidence")})
