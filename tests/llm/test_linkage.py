import numpy as np
import pytest
from pyspark.sql import functions as F

from orthostat.llm import linkage
from orthostat.operators.components import find, union

SCHEMA = "id string, kind string, tokens array<string>, label string, confidence double, item string"


def sets(spark, rows, batches=False):
    schema = SCHEMA + (", batch_no int" if batches else "")
    return linkage.typed_sets(spark.createDataFrame(rows, schema), "id", "kind", F.col("tokens"), "label", "confidence", also=("batch_no",) if batches else ())


def row(i, kind, tokens, confidence=0.9, *batch):
    return (i, kind, tokens, "label " + (i or ""), confidence, "clash", *batch)


def test_batches_in_order(spark):
    big = [f"t{i}" for i in range(10)]
    history = sets(spark, [row("h1", "geo", big), row("h2", "geo", ["a", "b", "c"], 0.5), row("h3", "geo", ["p", "q"], None)])
    batch = sets(
        spark,
        [
            row("b1", "geo", big[:8], 0.9, 1),  # 0.8 of h1
            row("b2", "geo", big[:7], 0.9, 1),  # 0.7
            row("b3", "typo", big, 0.9, 1),  # other type
            row("b4", "geo", ["a", "b", "c"], 0.9, 1),  # h2 is not confident
            row("b5", "geo", ["a", "b", "c"], 0.9, 1),  # same batch: doesn't block
            row("b6", "geo", ["a", "b", "c"], 0.9, 2),  # b4 is known by now
            row("b4", "geo", ["a", "b", "c"], 0.9, 3),  # delivered again
            row("b7", "geo", ["z"], 0.2, 2), row("b8", "geo", ["z"], 0.9, 3),  # b7 wasn't confident
            row("b9", "geo", ["p", "q"], 0.9, 1), row("b10", "geo", None, 0.9, 1), row("b11", None, ["z"], 0.9, 3), row(None, "geo", big, 0.9, 1),
            row("b12", "geo", big, 0.9, None), row("b1", "geo", big[:8], 0.9, 1),
        ],
        batches=True,
    )
    cases, links = linkage.link_batches(history, batch, 0.8)
    assert {(r["batch_no"], r["item"]) for r in cases.collect()} == {(1, "b1"), (2, "b6"), (3, "b4")}
    reps = {r["item"]: r["representative"] for r in linkage.representatives(links).collect()}
    assert reps["b1"] == reps["h1"] and reps["b6"] == reps["b4"] and "b2" not in reps


def test_pairs_at_threshold_one(spark):
    history = sets(spark, [row("r1", "near", ["x", "y"]), row("r2", "near", ["x", "z"], 0.69)])
    batch = sets(spark, [row("n1", "near", ["y", "x"], 0.9, 1), row("n2", "near", ["x", "z"], 0.9, 1), row("n3", "same", ["x", "y"], 0.9, 1), row("n4", "near", ["z", "x"], 0.9, 2)], batches=True)
    cases, _ = linkage.link_batches(history, batch, 1.0)
    assert {(r["batch_no"], r["item"]) for r in cases.collect()} == {(1, "n1"), (2, "n4")}


@pytest.mark.parametrize("threshold", [0.8, 1.0])
def test_all_members_of_a_touched_class_have_representatives(spark, threshold):
    many = [f"h{k:02}" for k in range(30)]
    history = sets(spark, [row(i, "near", ["x", "y"]) for i in many] + [row("low", "near", ["x", "y"], 0.5), row("other", "same", ["x", "y"]), row("far", "near", ["p", "q"]), row("far2", "near", ["p", "q"])])
    batch = sets(spark, [row("n1", "near", ["y", "x"], 0.9, 1), row("e1", "near", ["u", "v"], 0.9, 1), row("e2", "near", ["u", "v"], 0.9, 1), row("e3", "near", ["v", "u"], 0.9, 2)], batches=True)
    cases, links = linkage.link_batches(history, batch, threshold)
    assert {(r["batch_no"], r["item"]) for r in cases.collect()} == {(1, "n1"), (2, "e3")}
    groups = {}
    for r in linkage.representatives(links).collect():
        groups.setdefault(r["representative"], set()).add(r["item"])
    assert sorted(map(sorted, groups.values())) == [["e1", "e2", "e3"], [*many, "n1"]]


@pytest.mark.parametrize("threshold", [0.8, 1.0])
def test_empty(spark, threshold):
    nothing = sets(spark, [])
    cases, links = linkage.link_batches(nothing, sets(spark, [], batches=True), threshold)
    assert cases.count() == 0 and links.count() == 0
    cases, _ = linkage.link_batches(nothing, sets(spark, [row("a", "geo", ["x"], 0.9, 1), row("b", "geo", ["x"], 0.9, 2)], batches=True), threshold)
    assert [(r["batch_no"], r["item"]) for r in cases.collect()] == [(2, "b")]


def test_weights_favour_agreement():
    patterns = [(3, 2, 1), (3, 2, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0)]
    weights = linkage.fellegi_sunter(patterns, [80, 20, 500, 300, 90])
    assert weights["overlap"][3] > weights["overlap"][0] and weights["label"][2] > weights["label"][0]
    assert linkage.fellegi_sunter([], [])["overlap"] == [0.0, 1.0, 2.0, 3.0]


def batches_of(spark, rng, n, first, values=40):
    rows = []
    for k in range(first, first + n):
        tokens = [f"t{int(v)}" for v in rng.integers(0, values, rng.integers(1, 9))]
        rows.append(row(f"i{k:04}", "geo" if k % 3 else "typo", tokens, 0.9 if k % 5 else 0.5))
    return rows


def brute(known, batch, threshold):
    """Cases and links of a batch; what is new is appended to ``known``."""
    cases, links, fresh = set(), set(), []
    for i, kind, tokens, _, confidence, _ in batch:
        s = frozenset(tokens)
        near = {j for j, k, o in known if k == kind and len(s & o) / len(s | o) >= threshold - 1e-9}
        if near:
            cases.add(i)
            links |= {(i, j) for j in near}
        elif confidence >= 0.7:
            fresh.append((i, kind, s))
    known += fresh
    return cases, links


@pytest.mark.parametrize("buckets", [False, True])
@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_stored_records_over_runs_equal_brute_force(spark, tmp_path, monkeypatch, threshold, buckets):
    """Each batch opens what the last one left, with new values in later ones and several versions of frequencies."""
    if buckets:
        monkeypatch.setattr(linkage, "BUCKET_KEYS", 20)
    rng = np.random.default_rng(3)
    history, known, links = batches_of(spark, rng, 60, 0), [], set()
    known += [(i, k, frozenset(t)) for i, k, t, _, c, _ in history if c >= 0.7]
    path = f"file://{tmp_path}/known"
    linkage.KnownRecords.create(spark, path, sets(spark, history).where("confidence >= 0.7"), threshold)
    for b in range(3):
        batch = batches_of(spark, rng, 50, 100 * (b + 1), 40 + 25 * b)
        store = linkage.KnownRecords.open(spark, path)
        got, _ = linkage.link(store, sets(spark, batch), unite=True)
        cases, more = brute(known, batch, threshold)
        links |= more
        assert {r["item"] for r in got.collect()} == cases
    store = linkage.KnownRecords.open(spark, path)
    assert len(store.state["versions"]) >= (2 if threshold < 1 else 0)
    if buckets and threshold < 1:
        assert store.state["versions"][-1]["buckets"] > 3
    parent = {}
    for a, b in links:
        union(parent, a, b)
    want = {n: find(parent, n) for n in parent}
    assert {r["item"]: r["representative"] for r in store.representatives().collect()} == want


def test_a_batch_reads_a_share_of_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "BUCKET_KEYS", 20)
    history = sets(spark, [row(f"h{k}", "geo", [f"a{k}", f"b{k}", f"c{k}"]) for k in range(400)])
    store = linkage.KnownRecords.create(spark, f"file://{tmp_path}/known", history, 0.8)
    asked = store._keyed(linkage._classed(sets(spark, [row("n", "geo", ["a7", "b7", "c7"])])).select("cls", "kind", "tokens"), store.state["versions"][0])
    hit, every = store.hit_keys(0, asked), store._table("keys", 0)
    assert every.count() == 400 and 1 <= hit.count() < 100
    assert len({r[0] for r in hit.select(F.input_file_name()).distinct().collect()}) <= 2
    assert set(every.columns) == {"key", "cls", "n", "bucket"}


def test_a_run_that_ends_half_way_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/known"
    store = linkage.KnownRecords.create(spark, path, sets(spark, [row("h", "geo", ["a", "b"])]), 0.8)
    linkage._classed(sets(spark, [row("lost", "geo", ["c"])])).select("cls", "item", "kind", "tokens", "label", "confidence", "value").write.parquet(store._new("members"))
    again = linkage.KnownRecords.open(spark, path)
    assert again.state["seq"] == store.state["seq"] and again._table("members").count() == 1


def test_the_score_chooses_among_matches(spark):
    history = sets(spark, [("h1", "geo", ["a", "b"], "Tower", 0.71, "x"), ("h2", "geo", ["a", "b", "c", "d", "e"], "Bay of stones", 0.9, "x"), ("h3", "geo", ["a", "b", "c", "d", "f"], "Other", 0.71, "x")])
    batch = sets(spark, [("n", "geo", ["a", "b", "c", "d"], "Bay of Stones", 0.9, "x", 1)], batches=True)
    cases, _ = linkage.link_batches(history, batch, 0.8)
    assert [(r["item"], r["matched"], r["similarity"]) for r in cases.collect()] == [("n", "h2", 0.8)]
