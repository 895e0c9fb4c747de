"""Period normalisation and interval overlap."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Period words in the order in which they are tried, with start and end year.
PERIODS = {
    "bronzo antico": (-2300, -1700), "bronzo medio": (-1700, -1350), "bronzo recente": (-1350, -1150),
    "bronzo finale": (-1150, -900), "età del bronzo": (-2300, -900), "eneolitico": (-3000, -2300),
    "calcolitico": (-3000, -2300), "età del rame": (-3000, -2300), "neolitico": (-5000, -3000),
    "età del ferro": (-900, -27), "bronzo": (-2300, -900), "neolithic": (-5000, -3000),
    "eneolithic": (-3000, -2300), "chalcolithic": (-3000, -2300), "copper age": (-3000, -2300),
    "bronze age": (-2300, -900), "iron age": (-900, -27),
}
# Standard ranges of English period names, in the order in which they are tried.
STANDARD_RANGES = {
    "paleolithic": (-2500000, -10000), "mesolithic": (-10000, -6000), "neolithic": (-6000, -3000),
    "eneolithic": (-3000, -2300), "chalcolithic": (-3000, -2300), "copper age": (-3000, -2300),
    "bronze age": (-2300, -900), "early bronze age": (-2300, -1700), "middle bronze age": (-1700, -1350),
    "late bronze age": (-1350, -900), "iron age": (-900, -27), "protohistory": (-3000, -27),
}


def normalized_period(label: Column) -> Column:
    """Struct (period, start_year, end_year) of the first period word in a label, else null."""
    low = F.trim(F.lower(label))

    def of(name: str, start: int, end: int) -> Column:
        return F.struct(F.lit(name).alias("period"), F.lit(start).alias("start_year"), F.lit(end).alias("end_year"))

    found = [F.when(low.contains(word), of(word.title(), *years)) for word, years in PERIODS.items()]
    numbered = low.rlike("millenni(o|um)") & low.rlike(r"\d|[ivx]")
    return F.coalesce(*found, F.when(numbered, of("Millennium-based", -5000, -2000)))


def common_range(a: Column, b: Column) -> Column:
    """T4: the first standard period that both lower-case labels name, else null."""
    return F.coalesce(*(F.when(a.contains(name) & b.contains(name), F.lit(name)) for name in STANDARD_RANGES))


def overlap_score(start1: Column, end1: Column, start2: Column, end2: Column, tolerance: int = 100) -> Column:
    """Overlap of two year ranges as a share of the shorter one; 0 where a year is missing.

    Ranges are widened by ``tolerance`` on both sides; degenerate ranges that meet give 0.5.
    """
    s1, e1, s2, e2 = start1 - tolerance, end1 + tolerance, start2 - tolerance, end2 + tolerance
    shared, shorter = F.least(e1, e2) - F.greatest(s1, s2), F.least(e1 - s1, e2 - s2)
    known = start1.isNotNull() & end1.isNotNull() & start2.isNotNull() & end2.isNotNull()
    meet = known & (s1 <= e2) & (s2 <= e1)
    return F.when(~F.coalesce(meet, F.lit(False)), 0.0).when(shorter <= 0, 0.5).otherwise(F.least(F.lit(1.0), shared / shorter))
