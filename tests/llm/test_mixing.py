import numpy as np
import pandas as pd
import pytest

from orthostat.llm import mixing

TARGETS = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3), ("none", 0.1, 2)]


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def documents(spark, n=900):
    rng = np.random.default_rng(2)
    names = ["a", " A ", "b", "C", "other", None]
    rows = [(i, "parola " * int(rng.integers(1, 60)), names[int(rng.integers(0, 6))], 1, 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, p double")


def test_shares_are_met(spark, targets):
    used, plan = mixing.mix(documents(spark), targets)
    got = {r["source"]: r for r in mixing.reached(used, plan).collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"]["tokens"] == 0
    live = sum(s for n, s, _ in TARGETS if n != "none")
    for name, share, repeats in TARGETS[:3]:
        assert abs(got[name]["actual_share"] - share / live) < 0.002
        assert got[name]["most_uses"] <= repeats
    assert any(abs(r.uses - r.max_repeats) < 1e-9 for r in plan.itertuples())  # as large as the caps allow


def test_flights_in_blocks_keep_the_balance(spark, targets, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    used, plan = mixing.mix(documents(spark), targets)
    got = {r["source"]: r for r in mixing.reached(used, plan).collect()}
    want = {r.source: r for r in plan.itertuples()}
    for name in "abc":
        assert abs(got[name]["tokens"] - want[name].tokens) <= 2 * 130
        assert abs(got[name]["uses"] - want[name].uses * want[name].docs) <= 2
    assert used.count() == used.select("id").distinct().count()


def test_flight_keeps_sums_and_inclusion_probabilities():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 100, 60)
    hits = np.zeros(60)
    for k in range(400):
        p = mixing.fly(tokens, np.full(60, 0.3), np.random.default_rng(k))
        assert abs(p.sum() - 18) < 1e-6 and abs((p * tokens).sum() - 0.3 * tokens.sum()) < 1e-4
        assert ((p > 0) & (p < 1)).sum() <= 2
        hits += mixing.land(tokens, p)
    assert abs(hits / 400 - 0.3).max() < 0.1


def test_equal_sizes_and_zero_tokens():
    p = mixing.fly(np.zeros(10), np.full(10, 0.5), np.random.default_rng(0))
    assert abs(p.sum() - 5) < 1e-9 and ((p > 0) & (p < 1)).sum() <= 2


def test_dirt_and_empty(spark, targets):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 50_000, "b"), (4, "y", None), (5, "z", "c"), (5, "z", "c")]
    used, plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets)
    assert used.count() >= 1 and plan["docs"].sum() == 5
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    used, plan = mixing.mix(none, targets)
    assert used.count() == 0 and mixing.reached(used, plan).count() == 4
    used, plan = mixing.mix(spark.createDataFrame(rows, none.schema), targets.limit(0))
    assert used.count() == 0 and mixing.reached(used, plan).count() == 0


def test_plan_caps():
    totals = pd.DataFrame({"source": ["a", "b"], "docs": [10, 10], "size": [100, 1000]})
    targets = pd.DataFrame({"source": ["A ", "b"], "target_share": [0.5, 0.5], "max_repeats": [2, 5]})
    plan = mixing.plan_mix(totals, targets).set_index("source")
    assert plan.loc["a", "uses"] == 2 and plan.loc["a", "tokens"] == plan.loc["b", "tokens"] == 200
    assert mixing.plan_mix(totals, targets, 100)["tokens"].sum() == 100
