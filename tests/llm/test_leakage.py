import random
import re
import unicodedata

import numpy as np
import pytest

from orthostat.llm import leakage

WORDS = [f"parola{i}" for i in range(400)] + ["perché", "città", "d'acqua"]


def words(text):
    text = unicodedata.normalize("NFKD", text or "")
    text = "".join(c for c in text if unicodedata.category(c)[0] != "M" and c not in "­​").lower()
    return re.findall(r"[^\W_]+", text)


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            n = min(12, len(v))
            if n and d is not None and i is not None and any(w[k : k + n] == v[j : j + n] for j in range(len(v) - n + 1) for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def corpus():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, text(rng.choice([5, 9, 12, 30, 60]))) for k in range(30)]
    docs = []
    for k in range(120):
        parts = [text(rng.randrange(40))]
        if k % 3 == 0:
            w = rng.choice(items)[1].split()
            n = rng.choice([len(w), 12, 11])
            at = rng.randrange(max(1, len(w) - n + 1))
            piece = " ".join(w[at : at + n])
            piece = piece.upper() if k % 2 else piece.replace("a", "a­").replace(" ", "\n ")
            parts += [piece, text(rng.randrange(30))]
        docs.append((k, " ".join(parts)))
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs], "doc_id long, text string, item string, similarity double")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, codes string")
    got = leakage.leaks(d, e, **kw).collect()
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    return {(r["doc_id"], r["item_id"]) for r in got}


def test_equals_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_parts_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(leakage, "MAX_WINDOWS", 100)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_miss_no_fingerprint_within_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, (50, 12), dtype=np.uint64)
    index = leakage._Index.of(12, np.arange(50), codes, 3)
    flips = [rng.choice(64, rng.integers(0, 5), replace=False) for _ in range(400)]
    of = rng.integers(0, 50, 400)
    prints = np.array([index.prints[o] ^ np.uint64(sum(1 << int(b) for b in f)) for o, f in zip(of, flips)], np.uint64)
    at, what = index.probe(prints, 3)
    want = {(i, j) for i in range(400) for j in range(50) if bin(int(prints[i] ^ index.prints[j])).count("1") <= 3}
    assert set(zip(at.tolist(), what.tolist())) == want


def test_simhash_is_the_majority_of_bits():
    codes = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    for size in (1, 2, 5, 9, 12, 13):
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1)
        want = [np.packbits(bits[k : k + size].sum(axis=0) > size // 2).view(np.uint64)[0] for k in range(40 - size + 1)]
        assert leakage.simhashes(codes, size).tolist() == want


def test_near_windows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "x " + item + " y"), (2, " ".join(f"w{i}" for i in range(6)))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), min_similarity=0.8).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["position"]) for r in got] == [(1, 7, 1.0, 1)]


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = rng.choice(["neu", "altro", "other"]) + str(rng.randrange(1000))
    return words


def altered_corpus():
    rng = random.Random(11)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    shared = text(14)
    items = [(k, text(rng.randrange(50, 130))) for k in range(60)]
    items = [(k, w[:20] + shared + w[20:]) if k % 6 == 0 else (k, w) for k, w in items]
    docs = []
    for k in range(360):
        item = rng.choice(items)[1]
        docs.append((k, " ".join(text(rng.randrange(30)) + edited(rng, item, rng.choice([1, 1, 2, 3])) + text(rng.randrange(30)))))
    return docs, [(k, " ".join(w)) for k, w in items]


def brute_near(docs, items, least):
    """Pairs with two item-sized windows of a weighted shingle similarity of ``least`` or more."""
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    cuts, seen = [], {}
    for i, t in items:
        w = words(t)
        size = max(s for s in leakage.SIZES if s <= len(w))
        cuts += [(i, size, shingles(w[k : k + size])) for k in range(len(w) - size + 1)]
    for i, _, s in cuts:
        for x in s:
            seen.setdefault(x, set()).add(i)
    weight = {x: 1 / len(i) for x, i in seen.items()}
    by_shingle = {}
    for n, (_, size, s) in enumerate(cuts):
        for x in s:
            by_shingle.setdefault((size, x), []).append(n)
    found = set()
    for d, t in docs:
        w = words(t)
        for size in {c[1] for c in cuts}:
            for k in range(len(w) - size + 1):
                a = shingles(w[k : k + size])
                for n in {n for x in a for n in by_shingle.get((size, x), [])}:
                    i, _, b = cuts[n]
                    total = sum(weight[x] for x in b)
                    if (d, i) not in found and sum(weight[x] for x in a & b) / (total + len(a - b) * total / len(b)) >= least:
                        found.add((d, i))
    return found


def test_recall_of_altered_passages(spark):
    """Items with one, two or three words replaced: 0.9 at least of what brute force finds, and nothing else."""
    docs, items = altered_corpus()
    want = brute_near(docs, items, 0.8)
    got = run(spark, docs, items, min_similarity=0.8)
    equal = brute_near(docs, items, 1.0)
    assert got <= want and len(want) > 200 and len(equal) < 0.5 * len(want)
    assert len(got) >= 0.9 * len(want) and equal <= got
    print("recall", len(got) / len(want), len(got - equal) / len(want - equal))


def test_weights_come_from_all_items(spark, monkeypatch):
    docs, items = altered_corpus()
    docs, items = docs[:60], items[:20]
    whole = run(spark, docs, items, min_similarity=0.7)
    monkeypatch.setattr(leakage, "MAX_WINDOWS", 100)
    assert run(spark, docs, items, min_similarity=0.7) == whole


def test_a_document_in_several_rows_counts_once(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a " + item), (1, item), (1, "a b c " + item), (1, item)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    for least in (1.0, 0.8):
        got = leakage.leaks(docs, items, min_similarity=least).collect()
        assert [(r["doc_id"], r["item_id"], r["similarity"], r["position"]) for r in got] == [(1, 7, 1.0, 0)]


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_changed_blocks_miss_no_fingerprint_within_radius(radius):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, (50, 30), dtype=np.uint64)
    index = leakage._Index.of(30, np.arange(50), codes, radius)
    flips = [rng.choice(64, rng.integers(0, 9), replace=False) for _ in range(600)]
    of = rng.integers(0, 50, 600)
    prints = np.array([index.prints[o] ^ np.uint64(sum(1 << int(b) for b in f)) for o, f in zip(of, flips)], np.uint64)
    at, what = index.probe(prints, radius)
    want = {(i, j) for i in range(600) for j in range(50) if bin(int(prints[i] ^ index.prints[j])).count("1") <= radius}
    assert set(zip(at.tolist(), what.tolist())) == want


def test_dirt_and_empty(spark):
    docs = [(1, None), (2, ""), (3, "uno due"), (None, "uno due"), (4, "uno due " * 40_000)]
    items = [(1, "Uno, due!"), (2, None), (3, "..."), (None, "uno"), (1, "Uno, due!")]
    assert run(spark, docs, items) == {(3, 1), (4, 1)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
