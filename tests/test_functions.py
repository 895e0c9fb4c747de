import pytest
from pyspark.sql import functions as F

from orthostat.functions import confidence, json_repair, period, text, uris
from orthostat.functions.sets import jaccard
from orthostat.functions.vector import cosine
from orthostat.operators import ratelimit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


LABELS = {
    "dolmen, Dolmen dell’Accettula (PERIODIZZAZIONI/ PROTOSTORIA/ Età del Bronzo)": ("Dolmen dell’Accettula", "Età del Bronzo"),
    "Dolmen di Arzoledda (dolmen) - Luras (OT)  (V-III millennio BC cal)": ("Dolmen di Arzoledda", "V-III millennio BC cal"),
    "dolmen - Corato (BA)  (Età del Bronzo)": ("dolmen", "Età del Bronzo"),
    "Dolmen località Cupeia (dolmen, area ad uso funerario) - Perinaldo (IM)  (Eta' antica)": ("Dolmen località Cupeia", None),
    "Dolmen Is Cadonis (dolmen (?)) - Iglesias (CI)  (millennio IV a.C. (?))": ("Dolmen Is Cadonis", None),
    "(solo), qui": ("(solo)", None), "": ("", None), None: (None, None),
}


def test_labels(spark):
    rows = spark.createDataFrame([(k,) for k in LABELS], "label string")
    got = {r["label"]: (r["n"], r["p"]) for r in rows.select("label", text.site_name(F.col("label")).alias("n"), text.period_in_label(F.col("label")).alias("p")).collect()}
    assert got == LABELS


@pytest.mark.parametrize("hours, want", [(2.5, "PT2H30M"), (0.0, "PT0H"), (0.25, "PT15M"), (3.0, "PT3H"), (1.9999, "PT1H60M")])
def test_duration(spark, hours, want):
    assert value(spark, text.duration_of(F.lit(hours))) == want


@pytest.mark.parametrize("uri, want", [("http://x/y/Ab1/ ", "ab1"), ("  AB", "ab"), ("x/", "x"), ("/", None), ("", None), (None, None)])
def test_uri_key(spark, uri, want):
    assert value(spark, uris.uri_key(F.lit(uri).cast("string"))) == want


def test_uri_set(spark):
    assert value(spark, uris.uri_set(F.array(*(F.lit(u).cast("string") for u in ("x/b", None, "y/B/", "x/a", ""))))) == ["a", "b"]
    assert value(spark, uris.uri_set(F.lit(None).cast("array<string>"))) == []


def test_reference(spark):
    ref = lambda u: value(spark, text.reference_of(F.lit(u).cast("string"), "c/", "d/"))
    assert [ref(u) for u in ("http://w/arco/7/", "https://e/x", "local", "", None)] == ["c/7", "https://e/x", "d/local", None, None]


PERIODS = {"Età del Bronzo antico": "Bronzo Antico", "età del bronzo": "Età Del Bronzo", "eneolitico finale": "Eneolitico", "Neolitico": "Neolitico", "V-III millennio BC cal": "Millennium-based", "millennio": "Millennium-based", "oggi": None, None: None}


def test_periods(spark):
    got = {k: value(spark, period.normalized_period(F.lit(k).cast("string"))["period"]) for k in PERIODS}
    assert got == PERIODS


@pytest.mark.parametrize("args, want", [((-100, 0, -100, 0), 1.0), ((0, 100, 600, 700), 0.0), ((0, 300, 200, 500), 0.6), ((None, 1, 1, 1), 0.0), ((0, -200, 0, 100), 0.5)])
def test_overlap(spark, args, want):
    assert value(spark, period.overlap_score(*(F.lit(a).cast("int") for a in args))) == pytest.approx(want)


def test_confidence(spark):
    f = lambda c: value(spark, F.round(c, 6))
    one = lambda x: F.lit(float(x))
    assert f(confidence.hybrid(one(0.9), one(0.5))) == 0.78
    assert f(confidence.hybrid(one(0.9), one(0.4))) == pytest.approx(0.75 - 0.3 * 0.1)
    assert f(confidence.cluster(one(0.8), one(0.8), F.lit(1))) == pytest.approx(0.7)
    assert f(confidence.cluster(one(0.8), one(0.8), F.lit(10))) == pytest.approx(0.9)
    assert f(confidence.relation(one(0.8), one(0.8), F.lit(None).cast("double"))) == 0.8
    assert f(confidence.path(one(0.8), one(0.8), F.lit(10), one(1.0))) == pytest.approx(0.85 * 0.64 + 0.15)
    assert f(confidence.feature(F.lit(1), F.lit(2), F.lit("architectural"))) == pytest.approx(0.9)
    assert [value(spark, confidence.tier(one(x))) for x in (0.7, 0.6999, 0.6, 0.5)] == ["Validated", "PendingReview", "PendingReview", "Rejected"]
    assert confidence.Weights(1.4, 0.6).normalized() == confidence.Weights(0.7, 0.3)


def test_sets_and_vectors(spark):
    arr = lambda *x: F.array(*(F.lit(v).cast("string") for v in x))
    assert value(spark, jaccard(arr("a", "b", None), arr("b", "c"))) == pytest.approx(1 / 3)
    assert value(spark, jaccard(arr(), arr("b"))) == 0.0
    vec = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert value(spark, cosine(vec(1, 0), vec(0, 0))) == 0.0 and value(spark, cosine(vec(1, 0), vec(-1, 0))) == 0.0
    assert value(spark, cosine(vec(1, 2), vec(2, 4))) == pytest.approx(1.0)


@pytest.mark.parametrize("cut, want", [('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": [{"b": 1}, {"c"', '{"a": [{"b": 1}]}'), ('{"a": 1, "b', '{"a": 1}'), ('[1, 2,', "[1, 2]"), ('{"a": "[{"}', '{"a": "[{"}'), (None, None), ("", "")])
def test_json_repair(cut, want):
    assert json_repair.repair_json(cut) == want


def test_json_repair_in_a_query(spark):
    df = spark.createDataFrame([('{"a": [1',), (None,)], "t string").select(json_repair.repaired("t").alias("r"))
    assert {r["r"] for r in df.collect()} == {'{"a": [1]}', None}


def test_retry_and_rules(spark):
    assert value(spark, text.retry_delay(F.lit("'retryDelay': '927.5ms'"))) == pytest.approx(0.9275)
    assert value(spark, ratelimit.backoff(2.0, F.lit(10), F.lit(1.0))) == 90.0
    assert ratelimit.next_agent({"geographic"}) == "temporal" and ratelimit.next_agent(set(ratelimit.AGENTS)) is None
    assert ratelimit.should_stop(0, set(), "autonomous", 0.8, 2) and not ratelimit.should_stop(0, set())
    assert ratelimit.should_generate_paths(0, 3) and not ratelimit.should_generate_paths(1, 2)
