"""Similarity joins between entities, by shared features and by vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .components import connected_components


def feature_classes(features: DataFrame, least_features: int = 2) -> DataFrame:
    """(entity, features): entities with their sorted feature set; those with fewer features are left out."""
    sets = features.groupBy("entity").agg(F.sort_array(F.collect_set("feature")).alias("features"))
    return sets.where(F.size("features") >= least_features)


def prefixes(rows: DataFrame, tokens: str, frequencies_of: DataFrame, threshold: float) -> DataFrame:
    """``rows`` once for each ``key``: the rarest values of the set ``tokens`` that a set of this Jaccard similarity can't all lack.

    Frequencies are counted in ``frequencies_of``; values that it lacks come first, and two sets
    compared must be ordered by the same frequencies. Empty sets have no key.
    """
    often = frequencies_of.select(F.explode(tokens).alias("_v")).groupBy("_v").agg(F.count("*").alias("_f"))
    sets = rows.select(tokens).distinct()
    each = sets.select(F.col(tokens).alias("_set"), F.explode(tokens).alias("_v")).join(often, "_v", "left")
    ranked = each.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "_v")))["_v"].alias("_order"))
    length = F.size("_set") - F.ceil(threshold * F.size("_set") - 1e-9).cast("int") + 1
    keyed = ranked.select("_set", F.explode(F.slice("_order", F.lit(1), length)).alias("key"))
    return rows.join(keyed, F.col(tokens) == F.col("_set")).drop("_set")


def feature_pairs(classes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(a, b, n_a, n_b, shared, similarity) of similar feature sets, a <= b, with their numbers of entities.

    Entities of one feature set are one class, so that a feature that very many entities have
    makes no pairs of entities; a set that two entities or more have is paired with itself. The
    classes meet on the rarest features that similar sets can't all lack, if their sizes can reach
    the threshold.
    """
    sets = classes.groupBy("features").agg(F.count("*").alias("n"))
    keys = prefixes(sets, "features", sets, threshold)
    side = lambda s: keys.select(F.col("features").alias(s), F.col("n").alias(f"n_{s}"), F.col("key").alias("feature"))
    na, nb = F.size("a"), F.size("b")
    fits = (F.col("a") < F.col("b")) & (na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9)
    met = side("a").join(side("b"), "feature").where(fits).select("a", "b", "n_a", "n_b").distinct()
    met = met.withColumn("shared", F.size(F.array_intersect("a", "b")).cast("long"))
    met = met.withColumn("similarity", F.col("shared") / (na + nb - F.col("shared"))).where(F.col("similarity") >= threshold - 1e-9)
    alone = sets.where("n > 1").select(F.col("features").alias("a"), F.col("features").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.size("features").cast("long").alias("shared"), F.lit(1.0).alias("similarity"))
    return met.unionByName(alone)


def first_feature_pairs(features: DataFrame, order: DataFrame, threshold: float = 0.3, most: int = 20) -> DataFrame:
    """(a, b, shared, similarity) of the first ``most`` similar entity pairs in load order, as a report.

    Such a pair has its ends among the first ``most`` + 1 entities of their classes.
    """
    classes = feature_classes(features)
    pairs = feature_pairs(classes, threshold)
    first = Window.partitionBy("features").orderBy("load_order", "entity")
    members = classes.join(order.select(F.col("id").alias("entity"), "load_order"), "entity").withColumn("k", F.row_number().over(first)).where(F.col("k") <= most + 1)
    side = lambda s: members.select(F.col("features").alias(s), F.col("entity").alias(f"e_{s}"), F.col("load_order").alias(f"o_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("o_a") < F.col("o_b")))
    swap = F.col("o_a") > F.col("o_b")
    one, two = (F.struct(F.col(f"o_{s}").alias("o"), F.col(f"e_{s}").alias("e")) for s in "ab")
    ends = rows.select(F.when(swap, two).otherwise(one).alias("x"), F.when(swap, one).otherwise(two).alias("y"), "shared", "similarity")
    return ends.orderBy("x.o", "y.o").limit(most).select(F.col("x.e").alias("a"), F.col("y.e").alias("b"), "shared", "similarity")


#: Vectors of a block on average, and pivots in all, which are broadcast (20 000 vectors at most, whatever the table).
BLOCK, MAX_PIVOTS = 1000, 20_000


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def vector_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(category, a, b, cosine) of labels of one category, a < b, null and zero vectors skipped.

    ``vectors`` has (category, label, vector), one length of vectors. Every ``block``-th label, by
    its hash, is a pivot; a label belongs to the pivot at the smallest angle. It is copied only to
    pivots whose labels may lie near enough by the triangle inequality of angles, so that distant
    blocks never meet. Labels of a crowded pivot are cut into parts of about ``block``; two parts
    are multiplied in one task, and only pairs above the threshold leave it.
    """
    length = F.aggregate("vector", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    rows = vectors.where("category is not null and label is not null and vector is not null").select("category", "label", F.transform("vector", lambda v: v.cast("double")).alias("vector")).where(length > 0)
    every = max(block, -(-rows.count() // MAX_PIVOTS))
    chosen = F.pmod(F.xxhash64("label"), F.lit(every)) == 0
    first = rows.groupBy("category").agg(F.min("label").alias("label"))  # each category has a pivot
    pivots = rows.where(chosen).unionByName(rows.join(first, ["category", "label"])).distinct().toPandas()  # MAX_PIVOTS and the categories
    pivots["pivot"] = np.arange(len(pivots))
    own = {c: (g["pivot"].to_numpy(), _unit(g["vector"])) for c, g in pivots.groupby("category")}
    shared = vectors.sparkSession.sparkContext.broadcast(own)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for category, g in batch.groupby("category"):
                names, centres = shared.value[category]
                for k in range(0, len(g), 500):
                    part = g.iloc[k : k + 500]
                    angle = np.arccos(np.clip(_unit(part["vector"]) @ centres.T, -1, 1))
                    at = angle.argmin(axis=1)
                    yield part.assign(pivot=names[at], angle=angle[np.arange(len(part)), at])

    schema = "category string, label string, vector array<double>"
    placed = cut(rows.mapInPandas(assign, schema + ", pivot int, angle double"), "placed")
    facts = placed.groupBy("pivot").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("parts")).toPandas()  # a row per pivot
    radius, parts = dict(zip(facts["pivot"], facts["radius"])), dict(zip(facts["pivot"], facts["parts"]))
    within = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    told = vectors.sparkSession.sparkContext.broadcast((radius, parts))

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        radius, parts = told.value
        for batch in batches:
            for category, g in batch.groupby("category"):
                names, centres = shared.value[category]
                full = np.array([n in radius for n in names])
                names, centres = names[full], centres[full]
                reach = np.array([radius[n] for n in names]) + within
                for k in range(0, len(g), 500):
                    part = g.iloc[k : k + 500]
                    near = np.arccos(np.clip(_unit(part["vector"]) @ centres.T, -1, 1)) <= reach
                    out = []
                    for r, (label, vector, mine) in enumerate(zip(part["label"], part["vector"], part["pivot"])):
                        me = (int(mine), xxhash.xxh32_intdigest(label) % parts[mine])
                        for n in names[near[r]]:
                            for s in range(parts[n]):
                                i, j = sorted((me, (int(n), s)))
                                out.append((category, label, vector, f"{me[0]}.{me[1]}", f"{i[0]}.{i[1]}", f"{j[0]}.{j[1]}"))
                    yield pd.DataFrame(out, columns=["category", "label", "vector", "own", "i", "j"])

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        x, own, label = _unit(group["vector"]), group["own"].to_numpy(), group["label"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        cosine = x[left] @ x[right].T
        a, b = np.nonzero(cosine >= threshold)
        la, lb = label[left[a]], label[right[b]]
        if i == j:
            kept = la < lb
            a, b, la, lb = a[kept], b[kept], la[kept], lb[kept]
        swap = la > lb
        return pd.DataFrame({"category": group["category"].iloc[0], "a": np.where(swap, lb, la), "b": np.where(swap, la, lb), "cosine": cosine[a, b]})

    spread = placed.mapInPandas(copies, schema + ", own string, i string, j string")
    return spread.groupBy("category", "i", "j").applyInPandas(multiply, "category string, a string, b string, cosine double")


def merge_labels(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(category, label, canonical): similar labels under the one with most entities, then the smallest."""
    key = lambda c, x: F.concat_ws("\u0001", c, x)
    edges = pairs.select(key("category", "a").alias("a"), key("category", "b").alias("b"))
    roots = connected_components(edges, "a", "b").select(F.col("node").alias("k"), "root")
    rows = counts.withColumn("k", key("category", "label")).join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    best = Window.partitionBy("category", "root").orderBy(F.col("n").desc(), "label")
    return rows.withColumn("canonical", F.first("label").over(best)).select("category", "label", "canonical", "n")
