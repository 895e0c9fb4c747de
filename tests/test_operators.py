import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthostat.operators import enrich, fallback, novelty, ordering, ratelimit, reports, similarity, validation
from orthostat.operators.components import connected_components
from orthostat.plans import reports as plans_reports

SITES = [("s1", 1, 40.0, 10.0, "Neolitico"), ("s2", 2, 40.03, 10.0, "neolitico"), ("s3", 3, 40.06, 10.0, "Early Bronze Age"), ("s4", 4, 0.0, 0.0, None), ("s5", 5, None, None, "Late bronze age"), ("s6", 6, 45.0, 10.0, "")]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "id string, load_order long, lat double, lon double, period_label string")


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(140)] + [("hub", f"h{i}") for i in range(60)] + [(None, "x"), ("y", "y")] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b", one_task_edges=one_task).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b", one_task_edges=one_task).count() == 0


def test_geographic_clusters(spark, sites):
    rows = [("a", "s1"), ("a", "s2"), ("b", "s1"), ("b", "s6"), ("c", "s1"), ("c", "s4"), ("d", "nowhere"), ("d", "s1"), ("d", "s1")]
    got = {r["cluster_id"]: r for r in validation.geographic_clusters(spark.createDataFrame(rows, "cluster_id string, member string"), sites).collect()}
    assert got["a"]["is_valid"] and got["a"]["score"] == 1.0 and got["a"]["radius_km"] == pytest.approx(1.668, abs=0.01)
    assert got["b"]["reason"] == "radius exceeds maximum" and got["c"]["reason"] == "too few members" and got["c"]["unlocated"] == 1
    assert got["d"]["is_valid"] and got["d"]["missing"] == 1 and got["d"]["radius_km"] == pytest.approx(0, abs=1e-6)


def test_ramp(spark):
    f = lambda km, most: spark.range(1).select(validation.ramp(F.lit(km), most)).first()[0]
    assert f(4.99, 10.0) == 1.0 and f(5.0, 10.0) == 1.0 and f(10.0, 10.0) == 0.5


def test_relations(spark, sites):
    rel = spark.createDataFrame([("r1", "s1", "s2"), ("r2", "s1", "s6"), ("r3", "s1", "s4"), ("r4", "x", "s1"), ("r5", "s5", "s1"), ("r6", "s3", "s5")], "relation_id string, source string, target string")
    near = {r["relation_id"]: r for r in validation.near_relations(rel, sites).collect()}
    assert near["r1"]["is_valid"] and near["r1"]["strength"] == pytest.approx(1 - 3.336 / 30, abs=1e-3)
    assert [near[k]["reason"] for k in ("r2", "r3", "r4", "r5")] == ["too far apart", "target without coordinates", "source not found", "source without coordinates"]
    same = {r["relation_id"]: r for r in validation.contemporary_relations(rel, sites).collect()}
    assert same["r1"]["score"] == 1.0 and same["r6"]["score"] == 0.8 and same["r6"]["matched_period"] == "bronze age"
    assert same["r3"]["score"] == 0.0 and same["r5"]["score"] == 0.3 and not same["r5"]["is_valid"]


def test_chronological_and_typological(spark, sites):
    prop = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1"), ("b", "s3"), ("c", "s6"), ("c", "s1")], "cluster_id string, member string")
    got = {r["cluster_id"]: (r["score"], r["is_valid"]) for r in validation.chronological_clusters(prop, sites).collect()}
    assert got == {"a": (1.0, True), "b": (0.7, True), "c": (0.0, False)}
    features = spark.createDataFrame([("s1", "f"), ("s1", "g"), ("s2", "f"), ("s3", "h")], "entity string, feature string")
    got = {r["cluster_id"]: r for r in validation.typological_clusters(prop, features).collect()}
    assert got["a"]["score"] == pytest.approx(0.2 + 0.2) and got["b"]["score"] == 0.3 and got["c"]["score"] == 0.0


def test_paths(spark, sites):
    stops = [("g", 0, "s1"), ("g", 1, "s2"), ("g", 2, "s3"), ("far", 0, "s1"), ("far", 1, "s6"), ("one", 0, "s1"), ("mixed", 0, "s1"), ("mixed", 1, "s5"), ("lost", 0, "s1"), ("lost", 1, "zz"), ("gap", 0, "s1"), ("gap", 1, "s5")]
    kinds = [("g", "Geographic"), ("far", "geographic"), ("one", "mixed"), ("mixed", "mixed"), ("lost", "mixed"), ("gap", "geographic"), ("none", "mixed")]
    got = {r["path_id"]: r for r in validation.thematic_paths(spark.createDataFrame(stops, "path_id string, ord int, member string"), sites, spark.createDataFrame(kinds, "path_id string, path_type string")).collect()}
    assert got["g"]["score"] == pytest.approx((1 + 1 - 0.5 * 6.672 / 200) / 2, abs=1e-4)
    assert got["far"]["reason"] == "too long" and got["one"]["reason"] == "too few stops" and got["lost"]["reason"] == "too few known stops" and got["gap"]["reason"] == "coordinates missing" and got["none"]["reason"] == "too few stops"
    assert got["mixed"]["score"] == 0.79


def test_similar_relations(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0])], "id string, vector array<double>")
    rel = spark.createDataFrame([("a", "b", 0.6), ("a", "c", 0.9), ("a", "z", 1.0)], "source string, target string, stated double")
    got = {r["target"]: (round(r["score"], 4), r["is_valid"]) for r in validation.similar_relations(rel, v, "stated").collect()}
    assert got == {"b": (0.72, True), "c": (0.63, False), "z": (0.0, False)}


def test_novelty(spark):
    schema = "item string, kind string, tokens array<string>, confidence double"
    history = spark.createDataFrame([("h1", "geo", [f"t{i}" for i in range(10)], 0.7), ("h2", "geo", ["a"], 0.69)], schema)
    items = spark.createDataFrame([("b1", "geo", [f"t{i}" for i in range(8)]), ("b2", "geo", [f"t{i}" for i in range(7)]), ("b3", "geo", []), ("b4", "geo", ["a"]), ("b5", "typo", ["t1"])], "item string, kind string, tokens array<string>")
    got = {r["item"]: (r["novel"], r["similarity"], r["match"]) for r in novelty.cluster_novelty(items, history).collect()}
    assert got == {"b1": (False, 0.8, "h1"), "b2": (True, 0.7, "h1"), "b3": (False, 0.0, None), "b4": (True, 0.0, None), "b5": (True, 0.0, None)}
    # the same batch twice gives nothing new
    known = history.unionByName(items.withColumn("confidence", F.lit(0.9)))
    assert not any(r["novel"] for r in novelty.cluster_novelty(items, known).collect())
    rel = spark.createDataFrame([("x", "near", "a", "b", 0.9)], "item string, kind string, a string, b string, confidence double")
    new = spark.createDataFrame([("y", "near", "a", "b"), ("z", "same", "a", "b")], "item string, kind string, a string, b string")
    assert {r["item"]: r["novel"] for r in novelty.relation_novelty(new, rel).collect()} == {"y": False, "z": True}
    paths = spark.createDataFrame([("p", "Stones", ["a", "b", "c"], 0.9)], "item string, theme string, tokens array<string>, confidence double")
    mine = spark.createDataFrame([("q", "stones", ["a", "b", "d"]), ("r", "other", ["a", "b", "d"]), ("s", "stones", ["a", "b"])], "item string, theme string, tokens array<string>")
    got = {r["item"]: (round(r["similarity"], 4), r["novel"]) for r in novelty.path_novelty(mine, paths).collect()}
    assert got == {"q": (0.6, True), "r": (0.5, True), "s": (0.8, False)}


def test_greedy_clusters_follow_load_order(spark, sites):
    rows = [("a", 1, 40.0), ("b", 4, 40.03), ("c", 2, 40.06), ("d", 3, 40.09), ("e", 5, 50.0)]
    df = spark.createDataFrame([(i, o, x, 10.0) for i, o, x in rows], "id string, load_order long, lat double, lon double")
    got = {(r["cluster"], r["id"]) for r in fallback.greedy_clusters(df, 4.0).collect()}
    # c is scanned before b, which alone would lead to it
    assert got == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")}
    assert fallback.greedy_clusters(df.limit(0), 4.0).count() == 0


def test_closure_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), (None, "z")], "c string, p string")
    got = {(r["class"], r["ancestor"]) for r in enrich.subclass_closure(e, "c", "p").collect()}
    assert {("a", "d"), ("a", "a"), ("x", "x"), ("x", "y"), ("b", "d")} <= got and ("d", "a") not in got and len(got) == 14


def test_merged_labels(spark):
    counts = spark.createDataFrame([("k", "a", 1), ("k", "b", 5), ("k", "c", 5), ("k", "d", 9)], "category string, label string, n int")
    pairs = spark.createDataFrame([("k", "a", "b", 0.9), ("k", "b", "c", 0.9)], "category string, a string, b string, cosine double")
    assert {r["label"]: r["canonical"] for r in similarity.merge_labels(counts, pairs).collect()} == {"a": "b", "b": "b", "c": "b", "d": "d"}


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.9), ("a", 0.7), ("a", 0.6), ("b", None)], "key string, confidence double")
    r = reports.confidence_statistics(df).collect()
    assert len(r) == 1 and r[0]["median"] == 0.7 and r[0]["n"] == 4
    empty = reports.confidence_report(df.limit(0)).first()
    assert empty["n"] == 0 and empty["mean"] == 0.0 and empty["high"] == 0
    items = spark.createDataFrame([("r1", "k", "x"), ("r1", "k", "x"), ("r2", "k", "x"), ("r2", "k", "y"), ("r3", "k", "y")], "run_id string, kind string, item string")
    assert [(r["run_id"], r["new_items"], r["cumulative"], r["novelty"]) for r in reports.stability(items).orderBy("run_id").collect()] == [("r1", 1, 1, 1.0), ("r2", 1, 2, 0.5), ("r3", 0, 2, 0.0)]


def test_flattened_caches(spark):
    rows = spark.sql("select 1 cache_id, map('k', named_struct('lat', 1.0D, 'lon', 2.0D)) points union all select 2, map('k', named_struct('lat', 3.0D, 'lon', 4.0D))")
    assert [(r["key"], r["lat"]) for r in enrich.flatten_caches(rows).collect()] == [("k", 3.0)]


def test_feature_pairs_by_class(spark):
    rows = [("e1", "x"), ("e1", "y"), ("e2", "x"), ("e2", "y"), ("e3", "x"), ("e3", "y"), ("e3", "z"), ("e4", "q"), ("e5", "q"), ("e5", "r")]
    features = spark.createDataFrame(rows, "entity string, feature string")
    got = {("".join(r["a"]), "".join(r["b"])): (r["n_a"], r["n_b"], round(r["similarity"], 3)) for r in similarity.feature_pairs(similarity.feature_classes(features)).collect()}
    assert got == {("xy", "xy"): (2, 2, 1.0), ("xy", "xyz"): (2, 1, 0.667)}
    order = spark.createDataFrame([("e1", 3), ("e2", 1), ("e3", 2), ("e5", 4)], "id string, load_order int")
    assert [(r["a"], r["b"]) for r in similarity.first_feature_pairs(features, order).collect()] == [("e2", "e3"), ("e2", "e1"), ("e3", "e1")]
    assert [(r["a"], r["b"]) for r in similarity.first_feature_pairs(features, order, most=1).collect()] == [("e2", "e3")]


@pytest.mark.parametrize("block", [3, 1000])
def test_vector_pairs_in_blocks(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(str(k % 2), f"v{k:02d}", (rng.standard_normal(4) * (k != 5)).tolist()) for k in range(24)]
    got = [(r["category"], r["a"], r["b"]) for r in similarity.vector_pairs(spark.createDataFrame(rows, "category string, label string, vector array<double>"), 0.4).collect()]
    want = set()
    for c, a, x in rows:
        for e, b, y in rows:
            if c == e and a < b and (n := np.linalg.norm(x) * np.linalg.norm(y)) > 0 and np.dot(x, y) / n >= 0.4:
                want.add((c, a, b))
    assert len(got) == len(set(got)) and set(got) == want
    empty = spark.createDataFrame([], "category string, label string, vector array<double>")
    assert similarity.vector_pairs(empty, 0.4).count() == 0


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_next_of_a_group_over_its_parts(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice("ab") if k % 2 else "hot", k, f"v{k}") for k in range(60) if rng.random() < 0.6] + [(None, 5, "n1"), (None, 40, "n2")]
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        want |= {(g, a[2]): b[2] if b else None for a, b in zip(own, [*own[1:], None])}
    got = ordering.with_next(spark.createDataFrame(rows, "g string, o long, v string"), ["g"], "o", "v", span).collect()
    assert {(r["g"], r["v"]): r["next"] for r in got} == want


def test_novelty_without_the_best_decides_the_same_with_a_hub(spark):
    rng = random.Random(2)
    draw = lambda p: [[f"{p}{k}", rng.choice("xy"), sorted({"hub", *(f"t{rng.randrange(25)}" for _ in range(rng.randrange(1, 6)))}), rng.choice([0.6, 0.9])] for k in range(120)]
    old, new = draw("h"), draw("n") + [["n_empty", "x", [], 0.9]]
    schema = "item string, kind string, tokens array<string>, confidence double"
    history, items = spark.createDataFrame(old, schema), spark.createDataFrame([r[:3] for r in new], "item string, kind string, tokens array<string>")
    for t in (0.8, 0.5):
        plain, quick = ({r["item"]: r["novel"] for r in novelty.cluster_novelty(items, history, t, report_best=best).collect()} for best in (True, False))
        assert plain == quick and len(set(plain.values())) == 2
        paths = history.withColumnRenamed("kind", "theme"), items.withColumnRenamed("kind", "theme")
        plain, quick = ({r["item"]: r["novel"] for r in novelty.path_novelty(paths[1], paths[0], t, report_best=best).collect()} for best in (True, False))
        assert plain == quick


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_vector_pairs_over_pivots_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [("c" if k % 3 else "d", f"l{k:03}", (centres[k % 6] + spread * rng.standard_normal(8)).tolist()) for k in range(240)] + [("c", "zero", [0.0] * 8), ("c", "none", None), (None, "x", [1.0] * 8)]
    rows += [("c", f"same{k}", [1.0] * 8) for k in range(40)]  # a crowded pivot
    got = similarity.vector_pairs(spark.createDataFrame(rows, "category string, label string, vector array<double>"), 0.9, block=10).collect()
    own = [(c, n, np.array(v) / np.linalg.norm(v)) for c, n, v in rows if c and v and any(v)]
    want = {(c, min(n, m), max(n, m)) for i, (c, n, x) in enumerate(own) for d, m, y in own[i + 1 :] if c == d and x @ y >= 0.9}
    assert sorted((r["category"], r["a"], r["b"]) for r in got) == sorted(want)


def test_greedy_clusters_with_many_sites_at_places(spark):
    """The definition, site by site in load order, against chains over places."""
    rng = random.Random(9)
    spots = [(40 + rng.randrange(12) / 50, 9 + rng.randrange(12) / 50) for _ in range(25)]
    sites = [(f"s{k}", k * 7 % 211, *rng.choice(spots)) for k in range(200)]
    far = lambda a, b: 2 * 6371.0 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    left, want = sorted(sites, key=lambda s: s[1]), set()
    while left:
        own, rest = [left[0]], []
        for s in left[1:]:
            (own if any(far(s[2:], m[2:]) <= 3.0 for m in own) else rest).append(s)
        if len(own) > 1:
            want |= {(own[0][0], s[0]) for s in own}
        left = rest
    got = fallback.greedy_clusters(spark.createDataFrame(sites, "id string, load_order long, lat double, lon double"), 3.0)
    assert {(r["cluster"], r["id"]) for r in got.collect()} == want


@pytest.mark.parametrize("common_sets", [0, 5, 1000])
def test_best_paths_with_hubs_equal_brute_force(spark, common_sets):
    rng = random.Random(5)

    def path(i):
        stops = {f"s{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 3]))} | {h for h in ("hub", "inn") if rng.random() < 0.6}
        return i, rng.choice([None, "Stones", "stones", "tombs", "wells"]), sorted(stops)

    seen = [path(f"k{rng.randrange(90):02d}") for _ in range(120)]
    mine = [path(f"p{rng.randrange(50):02d}") for _ in range(60)]
    best = {}
    for i, theme, a in mine:
        found = [(0.0, None)] if i not in best else [best[i]]
        for k, other, b in seen:
            if n := len(set(a) & set(b)):
                s = n / (len(a) + len(b) - n)
                found.append((min(1.0, s * 1.2) if theme and other and theme.lower() == other.lower() else s, k))
        best[i] = min(found, key=lambda f: (-f[0], f[1] or "z"))
    history = spark.createDataFrame([(*r, 0.9) for r in seen], "item string, theme string, tokens array<string>, confidence double")
    items = spark.createDataFrame(mine, "item string, theme string, tokens array<string>")
    got = {(r["item"], round(r["similarity"], 9), r["match"]) for r in novelty.path_novelty(items, history, common_sets=common_sets).collect()}
    assert got == {(i, round(s, 9), k) for i, (s, k) in best.items()}


def test_a_path_stored_twice_counts_once(spark, tmp_path):
    rows = "('old', 'a', array('x/1', 'x/2'), 0.9D, timestamp_ntz'2024-03-01 00:00:00'), ('old', 'a', array('x/2', 'x/1'), 0.9D, timestamp_ntz'2024-04-01 00:00:00'), ('new', 'b', array('x/1', 'x/2'), 0.9D, timestamp_ntz'2024-06-01 00:00:00')"
    spark.sql(f"select * from values {rows} as t(path_id, theme, stop_uris, confidence, created_at)").write.parquet(str(tmp_path / "history_paths.parquet"))
    got = plans_reports.m6_path_novelty(spark, str(tmp_path)).collect()
    assert [(r["item"], r["similarity"], r["match"], r["novel"]) for r in got] == [("new", 1.0, "old", False)]


def test_waits_equal_brute_force(spark):
    rng = random.Random(11)
    minute, hour, day = 60_000_000, 3_600_000_000, 86_400_000_000
    start = 1_704_067_200_000_000
    times = [start + rng.randrange(3) * day + rng.randrange(26) * hour + rng.choice([0, hour - minute, rng.randrange(hour)]) for _ in range(80)]
    # just 60 s and 24 h later, to the microsecond, at the same time, and before 1970
    times += [t + d for t in rng.sample(times, 60) for d in (0, minute, minute + 1, day, day + 1)] + [-5, -5 - minute, -4 - day]
    rows = [(f"e{k:03d}", t) for k, t in enumerate(rng.sample(times, len(times)))]
    requests = spark.createDataFrame([*rows, ("none", None)], "event_id string, u long").selectExpr("event_id", "timestamp_micros(u) ts")
    got = {r["event_id"]: tuple(r)[1:] for r in ratelimit.waits(requests, per_minute=2, per_day=40).collect()}
    want, order = {}, sorted((t, i) for i, t in rows)
    for k, (t, i) in enumerate(order):
        near, whole = (sum(t - d <= o <= t for o, _ in order) for d in (minute, day))
        wait = max(0.0, 60 - (t - order[k - 2][0]) / 1e6) if k >= 2 else 0.0
        want[i] = (near, whole, round(wait, 3), whole > 40)
    assert got == want


def test_waits_have_no_frame_for_each_request(spark):
    requests = spark.sql("select id event_id, timestamp_seconds(1704067200 + id) ts from range(10)")
    text = ratelimit.waits(requests, 2, 5)._jdf.queryExecution().analyzed().toString()
    # a frame that slides over requests is summed anew for each; only hours may have one
    assert text.count("windowspecdefinition") == 1 and "windowspecdefinition(day" in text and "sum(n" in text
