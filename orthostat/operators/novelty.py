"""Cross-run novelty: what earlier runs already know.

Novelty is a set-based comparison with a snapshot of the history; items of one batch don't
block each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .similarity import prefixes

#: Members of more history sets than this are common ones; so many of them, the most frequent, have a bit each.
COMMON_SETS, COMMON_BITS = 500, 64


def known(history: DataFrame, least_confidence: float = 0.70) -> DataFrame:
    """M3: the part of the history that counts."""
    return history.where(F.col("confidence") >= least_confidence)


def best_overlaps(items: DataFrame, history: DataFrame, kind: str | None) -> DataFrame:
    """(item, similarity, match) of the most similar history set that shares a member.

    ``items`` and ``history`` have (item, tokens) and the column ``kind``, if given, within which
    sets compete. Equal history sets are joined once, under their smallest item.
    """
    by = [kind] if kind else []
    size = F.size("tokens")
    sets = history.where(size > 0).groupBy(*by, "tokens").agg(F.min("item").alias("match"))
    a = items.where(size > 0).select("item", *by, size.alias("na"), F.explode("tokens").alias("t"))
    b = sets.select("match", *by, F.size("tokens").alias("nb"), F.explode("tokens").alias("t"))
    shared = a.join(b, [*by, "t"]).groupBy("item", "match", "na", "nb").agg(F.count("*").alias("n"))
    similarity = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return shared.select("item", "match", similarity.alias("similarity"))


def overlaps_from(items: DataFrame, history: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(item, match, similarity, and the columns ``h_*`` of the history) of history sets from ``threshold`` on.

    Both have (item, tokens) and the columns ``by``, within which sets compete. Sets meet on their
    rarest members only, so that a member of very many sets makes few candidates. Equal sets of
    the history stand for themselves once for each of its other columns.
    """
    size = F.size("tokens")
    others = [c for c in history.columns if c not in ("item", "tokens", "confidence", *by)]
    sets = history.where(size > 0).groupBy(*by, *others, "tokens").agg(F.min("item").alias("match"))
    a = prefixes(items.where(size > 0).select("item", *by, "tokens"), "tokens", sets, threshold)
    b = prefixes(sets, "tokens", sets, threshold).select("key", *by, "match", F.col("tokens").alias("h_tokens"), *(F.col(c).alias(f"h_{c}") for c in others))
    na, nb = size, F.size("h_tokens")
    met = a.join(b, ["key", *by]).where((na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9)).drop("key").distinct()
    n = F.size(F.array_intersect("tokens", "h_tokens"))
    return met.withColumn("similarity", n / (na + nb - n)).where(F.col("similarity") >= threshold - 1e-9).drop("h_tokens")


def _first_best(rows: DataFrame) -> DataFrame:
    """The greatest similarity of each item; ties go to the smallest match."""
    first = rows.groupBy("item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("m"))
    return first.select("item", (-F.col("m.s")).alias("similarity"), F.col("m.match").alias("match"))


def cluster_novelty(items: DataFrame, history: DataFrame, threshold: float = 0.8, report_best: bool = True) -> DataFrame:
    """M4: (item, similarity, match, novel) of clusters (item, kind, tokens).

    A cluster without members is not novel. Without overlap the similarity is 0. Without
    ``report_best`` similarities below the threshold are not looked for and are 0 as well; ``novel``
    is the same.
    """
    if report_best:
        best = _first_best(best_overlaps(items, known(history), "kind"))
    else:
        best = _first_best(overlaps_from(items, known(history).select("item", "kind", "tokens"), ["kind"], threshold).select("item", "match", "similarity"))
    out = items.select("item", "tokens").join(best, "item", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.select("item", "similarity", "match", ((F.size("tokens") > 0) & (F.col("similarity") < threshold)).alias("novel"))


def pair_key(source: Column, target: Column) -> list[Column]:
    """An edge without direction as two columns."""
    return [F.least(source, target).alias("a"), F.greatest(source, target).alias("b")]


def relation_novelty(items: DataFrame, history: DataFrame) -> DataFrame:
    """(item, novel) of relations (item, kind, a, b); known in either direction is not novel."""
    seen = known(history).select("kind", "a", "b").distinct().withColumn("seen", F.lit(True))
    return items.join(seen, ["kind", "a", "b"], "left").select("item", F.col("seen").isNull().alias("novel"))


def _path_overlaps(items: DataFrame, sets: DataFrame, boost: float, common_sets: int) -> DataFrame:
    """(item, match, similarity) among which the best match of each path is, of paths (item, theme, tokens).

    Equal sets of one theme are joined once, under their smallest item. Members of more than
    ``common_sets`` history sets join no pairs: a bit each tells which of them a set has, and of
    the sets with the same bits and size (and theme) the smallest item stands for all. If it has
    more in common with the path than those bits, it is a better match than the sets it stands for.
    """
    size, theme = F.size("tokens"), F.lower("theme").alias("theme")
    mine = cut(items.where(size > 0).select("item", theme, "tokens").distinct(), "paths")
    seen = cut(sets.where(size > 0).groupBy(theme, "tokens").agg(F.min("item").alias("match")), "known")
    often = seen.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f")).where(F.col("f") > common_sets)
    common = F.array(*(F.lit(r["t"]) for r in often.orderBy(F.col("f").desc(), "t").limit(COMMON_BITS).collect())).cast("array<string>")
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(common, t) - 1).cast("int"))
    bits = F.aggregate(F.array_intersect("tokens", common), F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(bit(t)))

    def side(df: DataFrame, own: str, s: str) -> DataFrame:
        return df.select(own, F.col("theme").alias(f"t{s}"), size.alias(f"n{s}"), bits.alias(f"m{s}"), F.array_except("tokens", common).alias(f"rare{s}"), F.xxhash64("theme", "tokens").alias(f"k{s}"))

    a, b = side(mine, "item", "a"), side(seen, "match", "b")
    both, same = F.bit_count(F.col("ma").bitwiseAND(F.col("mb"))), F.coalesce(F.col("ta") == F.col("tb"), F.lit(False))

    def similarity(n: Column, boosted: Column) -> Column:
        plain = n / (F.col("na") + F.col("nb") - n)
        return F.when(boosted, F.least(F.lit(1.0), plain * boost)).otherwise(plain).alias("similarity")

    each = a.withColumn("t", F.explode("rarea")).drop("rarea").join(b.withColumn("t", F.explode("rareb")).drop("rareb"), "t")
    shared = each.groupBy("item", "ka", "na", "ma", "match", "kb", "nb", "mb", same.alias("same")).agg(F.count("*").alias("n"))
    rare = shared.select("item", "match", similarity(F.col("n") + both, F.col("same")))

    def by_bits(boosted: bool) -> DataFrame:
        on = ["theme"] if boosted else []
        x, y = (df.where(F.col(m) != 0).withColumn("theme", F.col(t)) for df, m, t in ((a, "ma", "ta"), (b, "mb", "tb")))
        kinds, groups = x.select(*on, "ma", "na").distinct(), y.groupBy(*on, "mb", "nb").agg(F.min("match").alias("match"))
        met = kinds.withColumn("bit", F.explode(_set_bits("ma"))).join(groups.withColumn("bit", F.explode(_set_bits("mb"))), [*on, "bit"])
        found = met.select(*on, "ma", "na", "match", similarity(both, F.lit(boosted)))
        top = _first_best(found.select(F.struct(*on, "ma", "na").alias("item"), "match", "similarity"))
        return x.select("item", *on, "ma", "na").join(top.select("item.*", "match", "similarity"), [*on, "ma", "na"]).select("item", "match", "similarity")

    return rare.unionByName(by_bits(False)).unionByName(by_bits(True))


def _set_bits(column: str) -> Column:
    """The numbers of the bits of a long that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(COMMON_BITS - 1)), lambda k: F.col(column).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)


def path_novelty(items: DataFrame, history: DataFrame, threshold: float = 0.7, boost: float = 1.2, report_best: bool = True, common_sets: int = COMMON_SETS) -> DataFrame:
    """M6: (item, similarity, match, novel) of paths (item, theme, tokens), over all types.

    Equal themes (without case) raise the similarity by ``boost``, to 1 at most. ``report_best`` is
    as in :func:`cluster_novelty`.
    """
    sets = known(history)
    size = F.size("tokens")
    if not report_best:
        near = overlaps_from(items, sets.select("item", F.lower("theme").alias("theme"), "tokens"), [], threshold / boost)
        themed = near.join(items.select("item", F.lower("theme").alias("own")).distinct(), "item")
        raised = F.when(F.col("own") == F.col("h_theme"), F.least(F.lit(1.0), F.col("similarity") * boost)).otherwise(F.col("similarity"))
        best = _first_best(themed.select("item", "match", raised.alias("similarity")).where(F.col("similarity") >= threshold))
        out = items.select("item", "tokens").join(best, "item", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
        return out.select("item", "similarity", "match", ((size > 0) & (F.col("similarity") < threshold)).alias("novel"))
    best = _first_best(_path_overlaps(items, sets, boost, common_sets))
    out = items.select("item", "tokens").join(best, "item", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.select("item", "similarity", "match", ((size > 0) & (F.col("similarity") < threshold)).alias("novel"))
