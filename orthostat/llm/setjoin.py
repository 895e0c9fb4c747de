"""All similar pairs between set-valued records: the size-aware overlap join.

Records with equal sets form a class, and classes are joined. For two classes of n and m
values a Jaccard similarity of at least t means an overlap of at least
c(n, m) = ceil(t / (1 + t) * (n + m)). Small sets enumerate their subsets of c values, for each
size that a partner can have: two small sets that share one such subset are similar, and no
other pair ever meets. Large sets scan the inverted lists of their rarest values, where the
prefix, the position of the match and a bitmap of the values bound the overlap. If even their
rarest values are in so many sets that the lists hold a large part of all pairs, the bitmaps of all
pairs are compared instead, which is far cheaper for each. The union of both is filtered by the
exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: A set is small if it has at most so many subsets to enumerate.
MAX_SUBSETS = 200
_EPS = 1e-9
#: Longs in the bitmap of a set.
_WORDS = 4
#: Lists are scanned unless their matches are more than all pairs divided by this; then bitmaps are
#: compared, pair by pair, in blocks of at most so many sets.
SCAN_SHARE, SCAN_BLOCK = 20, 100_000
#: Bitmaps compared at once.
_ROWS, _COLUMNS = 8, 8192


def least_overlap(n: int, m: int, threshold: float) -> int:
    """The overlap from which sets of n and m values are similar."""
    return ceil(threshold / (1 + threshold) * (n + m) - _EPS)


@lru_cache(maxsize=1024)
def _roles(n: int, threshold: float) -> tuple[tuple[int, int, int], ...]:
    """(n, m, c) of each pair of sizes, the smaller first, in which a set of n values takes part."""
    low, high = ceil(threshold * n - _EPS), int(n / threshold + _EPS)
    return tuple((min(n, m), max(n, m), least_overlap(n, m, threshold)) for m in range(max(1, low), high + 1))


def subsets_of(n: int, threshold: float) -> int:
    """Number of subsets that a set of n values enumerates."""
    return sum(comb(n, c) for _, _, c in _roles(n, threshold)) if n <= 64 else MAX_SUBSETS + 1


def largest_small(threshold: float, max_subsets: int = MAX_SUBSETS) -> int:
    """The size up to which sets enumerate subsets."""
    n = 0
    while n < 64 and subsets_of(n + 1, threshold) <= max_subsets:
        n += 1
    return n


def set_classes(records: DataFrame, key: str, values: str) -> DataFrame:
    """(id, cls, tokens): records with their class; equal sets have one class.

    Null values, order and repetition don't count; records without value are left out, as are
    null ids. Repeated rows count once.
    """
    tokens = F.array_sort(F.array_distinct(F.array_compact(F.col(values))))
    return (
        records.select(F.col(key).cast("string").alias("id"), tokens.alias("tokens"))
        .where(F.col("id").isNotNull() & (F.size("tokens") > 0))
        .withColumn("cls", F.md5(F.array_join(F.transform("tokens", lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")))
        .select("id", "cls", "tokens")
        .distinct()
    )


def similar_classes(classes: DataFrame, threshold: float, max_subsets: int = MAX_SUBSETS) -> DataFrame:
    """(cls_a, cls_b, overlap, similarity) of different classes (cls, tokens), cls_a < cls_b."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    small = largest_small(threshold, max_subsets)
    sets = classes.select("cls", "tokens").dropDuplicates(["cls"]).withColumn("codes", F.transform("tokens", lambda t: F.xxhash64(t))).withColumn("n", F.size("tokens"))
    sets = cut(sets, "sets")
    pairs = _small_pairs(sets.where(F.col("n") <= small), threshold, small).unionByName(_large_pairs(sets, threshold, small)).distinct()
    a = sets.select(F.col("cls").alias("cls_a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    b = sets.select(F.col("cls").alias("cls_b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(a, "cls_a")
        .join(b, "cls_b")
        .select("cls_a", "cls_b", overlap.alias("overlap"), (F.col("na") + F.col("nb")).alias("both"))
        .withColumn("similarity", F.col("overlap") / (F.col("both") - F.col("overlap")))
        .where(F.col("similarity") >= threshold - _EPS)
        .drop("both")
    )


def _mix(codes: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _small_pairs(sets: DataFrame, threshold: float, small: int) -> DataFrame:
    """Candidates among small sets: a common subset of c(n, m) values, for sizes n and m."""

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        picks: dict = {}
        for batch in batches:
            for n, rows in batch.groupby("n"):
                codes = _mix(np.array(rows["codes"].tolist(), dtype=np.int64).view(np.uint64))
                cls = rows["cls"].to_numpy()
                for low, high, c in _roles(int(n), threshold):
                    if high > small:
                        continue
                    pick = picks.setdefault((n, c), np.array(list(combinations(range(n), c))))
                    key = _mix(codes[:, pick].sum(axis=2) ^ np.uint64(low << 32 | high)).view(np.int64)
                    for role in "sl" if low == high else "s" if low == n else "l":
                        yield pd.DataFrame({"key": key.ravel(), "role": role, "cls": np.repeat(cls, len(pick)), "same": low == high})

    keys = sets.select("cls", "codes", "n").mapInPandas(subsets, "key long, role string, cls string, same boolean")
    keys = cut(keys, "subsets")
    s, l = keys.where("role = 's'").select("key", "same", F.col("cls").alias("x")), keys.where("role = 'l'").select("key", F.col("cls").alias("y"))
    pairs = s.join(l, "key").where("x != y and (not same or x < y)")
    return pairs.select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b"))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(token, pos, cls, n, b0...): the values that a similar partner can't all lack, rarest first."""
    each = sets.select("cls", "n", F.explode("codes").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("f"))
    ordered = each.join(often, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("o"))
    length = F.col("n") - F.ceil(threshold * F.col("n") - _EPS).cast("int") + 1
    bits = F.transform("o", lambda e: F.pmod(F.xxhash64(e["token"]), F.lit(64 * _WORDS)))

    def word(k: int) -> Column:
        own = F.filter(bits, lambda v: F.floor(v / 64) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int"))))

    ordered = ordered.withColumns({f"b{k}": word(k) for k in range(_WORDS)})
    return ordered.select("cls", "n", *(f"b{k}" for k in range(_WORDS)), F.posexplode(F.slice("o", F.lit(1), length)).alias("pos", "e")).select("cls", "n", *(f"b{k}" for k in range(_WORDS)), "pos", F.col("e.token").alias("token"))


def _large_pairs(sets: DataFrame, threshold: float, small: int) -> DataFrame:
    """Candidates of which one at least is large: a match within both prefixes that can lead to the overlap."""
    if not sets.where(F.col("n") > small).take(1):
        return sets.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")).limit(0)
    prefixes = cut(_prefixes(sets, threshold), "prefixes")
    named = lambda side: prefixes.select("token", *(F.col(c).alias(f"{c}_{side}") for c in prefixes.columns if c != "token"))
    # the larger set looks into the lists of all sets that aren't larger; since these overlap with
    # it in c(n, n) values at least, a shorter prefix of theirs suffices
    mutual = F.ceil(2 * threshold / (1 + threshold) * F.col("n_b") - _EPS)
    a, b = named("a").where(F.col("n_a") > small), named("b").where(F.col("pos_b") <= F.col("n_b") - mutual)
    met = a.groupBy("token").agg(F.count("*").cast("double").alias("x")).join(b.groupBy("token").agg(F.count("*").cast("double").alias("y")), "token").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0
    alone = prefixes.where("pos = 0").drop("pos", "token")
    all_sets, large = alone.agg(F.count("*"), F.count(F.when(F.col("n") > small, 1))).first()
    if met * SCAN_SHARE > float(large) * all_sets:
        return _scanned_pairs(alone, all_sets, threshold, small)
    # a match at pos_a leaves room for partners of some sizes only: they meet by class of size
    low = F.ceil(threshold * F.col("n_a") - _EPS)
    high = F.least(F.col("n_a"), F.floor((F.col("n_a") - F.col("pos_a")) * ((1 + threshold) / threshold) + _EPS) - F.col("n_a"))
    size_class = lambda n: F.floor(F.ln(n) * (4 / log(1 / threshold)) + _EPS) if threshold < 1 else n.cast("long")
    a = a.where(high >= low).withColumn("sizes", F.explode(F.sequence(size_class(low), size_class(high))))
    b = b.withColumn("sizes", size_class(F.col("n_b")))
    least = F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - _EPS)
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    apart = sum((F.bit_count(F.col(f"b{k}_a").bitwiseXOR(F.col(f"b{k}_b"))) for k in range(1, _WORDS)), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
    fits = (
        ((F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("cls_b") < F.col("cls_a"))))
        & (F.col("n_b") >= threshold * F.col("n_a") - _EPS)
        & (rest >= least)
        & (apart <= F.col("n_a") + F.col("n_b") - 2 * least)
    )
    pairs = a.join(b, ["token", "sizes"]).where(fits)
    return pairs.select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b")).distinct()


def _scanned_pairs(sets: DataFrame, count: int, threshold: float, small: int) -> DataFrame:
    """Candidates of which one at least is large, by their bitmaps alone, of sets (cls, n, b0...).

    A task compares two blocks of sets; each block has a copy for each other one.
    """
    words = [f"b{k}" for k in range(_WORDS)]
    blocks = max(min(8, ceil(count / 2000)), ceil(count / SCAN_BLOCK))
    named = cut(sets.withColumn("id", F.monotonically_increasing_id()), "bitmaps")
    rows = named.select("id", "n", *words, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "n", *words, "block", (F.least("block", "other") * blocks + F.greatest("block", "other")).alias("task"))

    def apart(total: np.ndarray) -> np.ndarray:
        """Values that only one of two similar sets has, at most, by n + m."""
        return total - 2 * np.ceil(threshold / (1 + threshold) * total - _EPS).astype(np.int64)

    def scan(group: pa.Table) -> pa.Table:
        ids, n, of = (group[c].to_numpy().astype(np.int64) for c in ("id", "n", "block"))
        order = np.argsort(n, kind="stable")  # by size, so that partners lie in a range
        left, right = order[of[order] == of.min()], order[of[order] == of.max()]
        bits = np.stack([group[w].to_numpy() for w in words]).view(np.uint64)
        own, theirs = n[right], np.ascontiguousarray(bits[:, right])
        within = np.maximum.accumulate(apart(np.arange(2 * n.max() + 1)))
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), _ROWS):
            x = left[at : at + _ROWS]
            low, high = np.searchsorted(own, threshold * n[x[0]] - _EPS), np.searchsorted(own, n[x[-1]] / threshold + _EPS, "right")
            for start in range(low, high, _COLUMNS):
                y = slice(start, min(start + _COLUMNS, high))
                differ = np.bitwise_count(bits[0, x, None] ^ theirs[0, y])
                differ += np.bitwise_count(bits[1, x, None] ^ theirs[1, y])
                i, j = np.nonzero(differ <= np.minimum(within[n[x[-1]] + own[y]], 255).astype(np.uint8))
                if len(i):
                    found.append(np.stack([x[i], right[j + start]]))
        a, b = np.concatenate(found, axis=1)
        smaller, larger = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fits = (larger > small) & (smaller >= threshold * larger - _EPS) & ((of.min() != of.max()) | (ids[a] < ids[b]))
        a, b = a[fits], b[fits]
        differ = np.bitwise_count(bits[:, a] ^ bits[:, b]).sum(axis=0, dtype=np.int64)
        fits = differ <= apart(n[a] + n[b])
        return pa.table({"x": ids[a[fits]], "y": ids[b[fits]]})

    # a number of its own, so that small rows don't bring the tasks together
    pairs = rows.repartition(blocks * (blocks + 1) // 2, "task").groupBy("task").applyInArrow(scan, "x long, y long")
    x, y = (named.select(F.col("id").alias(k), F.col("cls").alias(f"cls_{k}")) for k in "xy")
    return pairs.join(x, "x").join(y, "y").select(F.least("cls_x", "cls_y").alias("cls_a"), F.greatest("cls_x", "cls_y").alias("cls_b"))


def similar_records(records: DataFrame, key: str, values: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (id, cls) of each record, and (cls_a, cls_b, overlap, similarity).

    Records of one class are equal and hence similar; they aren't expanded into pairs.
    """
    classes = cut(set_classes(records, key, values), "classes")
    return classes.select("id", "cls"), similar_classes(classes, threshold)


def expand_pairs(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids whose classes are equal or similar."""
    a, b = (membership.select(F.col("id").alias(f"id_{s}"), F.col("cls").alias(f"cls_{s}")) for s in "ab")
    equal = a.join(b, F.col("cls_a") == F.col("cls_b")).select("id_a", "id_b").where("id_a < id_b")
    other = pairs.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").where("id_a != id_b")
    return equal.unionByName(other.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))).distinct()
