import random

import pytest

from orthostat.llm import setjoin

SCHEMA = "id string, sites array<string>, cls string, tokens int, n int"


def brute(rows, threshold):
    sets = {}
    for i, s in rows:
        s = frozenset(x for x in s or () if x is not None)
        if i is not None and s:
            sets.setdefault(i, set()).add(s)
    out = set()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    n = len(s & t)
                    if n + 1e-9 >= threshold * (len(s) + len(t) - n):
                        out.add((a, b))
    return out


def run(spark, rows, threshold, **kw):
    df = spark.createDataFrame([(i, s, "x", 1, 2) for i, s in rows], SCHEMA)  # extra columns with names that the operator uses
    classes = setjoin.set_classes(df, "id", "sites")
    pairs = setjoin.similar_classes(classes, threshold, **kw)
    got = setjoin.expand_pairs(classes.select("id", "cls"), pairs).collect()
    assert len(got) == len(set(got))
    return {(r["id_a"], r["id_b"]) for r in got}


def rows(seed, sizes, vocabulary=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    # one hub value is in most sets
    return [(f"r{i:03d}", rng.sample(words, rng.choice(sizes)) + (["hub"] if rng.random() < 0.7 else [])) for i in range(120)]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("most", [0, 200])
def test_equals_brute_force(spark, threshold, most):
    data = rows(1, [1, 2, 3, 4, 5, 6, 9, 11])
    assert run(spark, data, threshold, max_subsets=most) == brute(data, threshold)


def test_dirt(spark):
    data = [("a", ["x", None, "x", "y"]), ("b", ["y", "x"]), ("c", []), ("d", None), (None, ["x", "y"]), ("e", [None]), ("a", ["y", "x"]), ("f", ["y", "x", "z"])]
    assert run(spark, data, 0.6) == {("a", "b"), ("a", "f"), ("b", "f")}


def test_many_equal_sets_make_one_class(spark):
    df = spark.createDataFrame([(f"r{i}", ["a", "b", "c"]) for i in range(500)] + [("s", ["a", "b", "c", "d"])], "id string, sites array<string>")
    members, pairs = setjoin.similar_records(df, "id", "sites", 0.6)
    assert pairs.count() == 1 and members.select("cls").distinct().count() == 2


def test_empty(spark):
    assert run(spark, [], 0.6) == set()


def test_least_overlap_is_exact():
    for n in range(1, 40):
        for m in range(n, 40):
            for t in (0.5, 0.6, 0.8, 0.9):
                c = setjoin.least_overlap(n, m, t)
                assert c + 1e-9 >= t * (n + m - c) and not (c - 1) - 1e-9 >= t * (n + m - c + 1)


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        run(spark, [("a", ["x"])], 0.0)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("share", [0, 10**9])
def test_lists_and_bitmaps_equal_brute_force(spark, monkeypatch, threshold, share):
    monkeypatch.setattr(setjoin, "SCAN_SHARE", share)
    monkeypatch.setattr(setjoin, "SCAN_BLOCK", 30)
    monkeypatch.setattr(setjoin, "_COLUMNS", 16)
    data = rows(4, [1, 3, 6, 11, 14, 30, 90], 100) + [(f"t{i}", [f"w{k}" for k in range(i, i + 300)]) for i in range(0, 100, 7)]
    data += [(f"{i}x", s[1:] + ["odd"]) for i, s in rows(4, [1, 3, 6, 11, 14, 30, 90], 100)]
    assert run(spark, data, threshold) == brute(data, threshold)


def test_sets_of_common_values_meet_by_bitmaps(spark, monkeypatch):
    called = []
    scanned = setjoin._scanned_pairs
    monkeypatch.setattr(setjoin, "_scanned_pairs", lambda *a: called.append(1) or scanned(*a))
    data = rows(2, [20, 22, 25], 40)
    assert run(spark, data, 0.6) == brute(data, 0.6) and called
    called.clear()
    data = [(f"r{i}", [f"v{i // 2}_{k}" for k in range(20)] + [f"own{i}"]) for i in range(1200)]
    assert run(spark, data, 0.6) == brute(data, 0.6) and not called
