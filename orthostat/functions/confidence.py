"""Confidence scoring: blends of a stated and a computed score, all in [0, 1]."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Weights:
    """Weights of the stated and the computed score, normalised when their sum is off by over 0.01."""

    stated: float = 0.7
    computed: float = 0.3

    def normalized(self) -> Weights:
        total = self.stated + self.computed
        if total <= 0:
            return Weights()
        return self if abs(total - 1) <= 0.01 else Weights(self.stated / total, self.computed / total)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def hybrid(stated: Column, computed: Column, weights: Weights = Weights(), penalty: bool = True) -> Column:
    """Weighted mean, lowered where the two differ by more than 0.4."""
    w = weights.normalized()
    a, b = clamp(stated), clamp(computed)
    base, apart = w.stated * a + w.computed * b, F.abs(a - b)
    return F.when(apart > 0.4, F.greatest(F.lit(0.0), base - 0.3 * (apart - 0.4))).otherwise(base) if penalty else base


def cluster(stated: Column, computed: Column, members: Column, least: int = 2) -> Column:
    """Small clusters lose, clusters of five and more gain up to 0.1."""
    base = hybrid(stated, computed)
    small = F.greatest(F.lit(0.0), base - 0.2 * (least - members) / least)
    large = F.least(F.lit(1.0), base + 0.1 * F.least(F.lit(1.0), (members - 5) / 5))
    return F.when(members < least, small).when(members >= 5, large).otherwise(base)


def relation(stated: Column, computed: Column, strength: Column) -> Column:
    """A fifth comes from the relation's strength, where it is given."""
    base = hybrid(stated, computed)
    return F.when(strength.isNotNull(), 0.8 * base + 0.2 * clamp(strength)).otherwise(base)


def path(stated: Column, computed: Column, stops: Column, narrative: Column) -> Column:
    """C4: long paths lose up to a fifth; narrative quality counts for 0.15, where it is given."""
    base = hybrid(stated, computed)
    base = F.when(stops >= 5, base * F.greatest(F.lit(0.8), 1 - 0.05 * (stops - 5))).otherwise(base)
    return F.when(narrative.isNotNull(), 0.85 * base + 0.15 * narrative).otherwise(base)


def feature(count: Column, total: Column, category: Column) -> Column:
    """By the share of entities with the feature; two categories gain 0.05; within [0.30, 0.95]."""
    share = F.when(total > 0, count / total).otherwise(0.0)
    raw = 0.70 + F.least(F.lit(0.15), 0.30 * share) + F.when(category.isin("architectural", "material"), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.30), F.least(F.lit(0.95), raw))


def level(confidence: Column) -> Column:
    """High, medium, low or very_low."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence >= 0.3, "low").otherwise("very_low")


def tier(confidence: Column) -> Column:
    """Validated from 0.70, PendingReview from 0.60, else Rejected; a missing one is Rejected."""
    return F.when(confidence >= 0.70, "Validated").when(confidence >= 0.60, "PendingReview").otherwise("Rejected")
