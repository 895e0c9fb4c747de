"""Per-document text quality statistics, percentiles and robust z-scores by language.

Each statistic of a language is summarised by a mergeable KLL quantile sketch. Sketches of all
languages, or of several parts of a corpus, merge. They are taken of the documents themselves or
read from a stored profile of other texts, so that values can be compared over time. Values become
percentiles and robust z-scores, with a scale for each side of the median, and values in the tails
of a distribution are flagged.

What is natural prose is not a question of how frequent it is: in a corpus of lists no list lies
in a tail. The share of running prose has therefore an absolute tail, below one half, that no
other document moves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: The statistics, in the order of the result.
STATISTICS = ["word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "prose_share"]
#: Least scale of a statistic: spreads below it don't make a tail.
_SCALE = {"word_count": 20.0, "mean_word_length": 0.3, "symbol_ratio": 0.01, "punctuated_lines": 0.1, "common_words": 0.03, "prose_share": 0.05}
#: Robust z-score from which a value lies in a tail, and the share of prose below which one does.
TAIL, LEAST_PROSE = 3.5, 0.5

_ENDING = re.compile(r"[.!?…][\"'»”’)\]]*[ \t\r]*(?:\n|$)")
_INNER = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ELISION = re.compile(r"(?:[ldnsmtcj]|un|all|dell|dall|nell|sull|coll|quell|quest|qu|jusqu)['’][^\W\d_]+", re.I)
_OUTER = "\"'«»“”„‘’.,;:!?…()[]-–—*•>#"
_MOJIBAKE = re.compile("[ÂÃâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|�")
#: Soft hyphens and characters of no width.
_UNSEEN = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
# Evidence of a token for (above 0) or against running prose.
_COMMON, _PLAIN, _NUMBER, _ODD, _BROKEN = 2.0, -0.45, -0.15, -2.5, -6.0
#: Tokens over which evidence is averaged.
_SPAN = 13


class _Tokens:
    """Facts about tokens, found out once each: evidence, letters and digits, symbols, word, common, length."""

    def __init__(self, common: frozenset[str]):
        self.common, self.ids, self.facts = common, {}, []

    def __call__(self, token: str) -> int:
        at = self.ids.get(token)
        if at is None:
            at = self.ids[token] = len(self.facts)
            self.facts.append(self._facts(token))
        return at

    def _facts(self, raw: str) -> tuple[float, int, int, int, int, int]:
        token = unicodedata.normalize("NFKC", raw).translate(_UNSEEN)
        solid = sum(c.isalnum() for c in token)
        core = token.strip(_OUTER)
        low = core.lower()
        common = low in self.common
        if _MOJIBAKE.search(token):
            evidence, common = _BROKEN, False
        elif re.fullmatch(r"\w{1,2}\)", token):
            evidence = _NUMBER
        elif common:
            evidence = _COMMON
        elif _ELISION.fullmatch(core):
            evidence = _COMMON / 2
        elif _INNER.fullmatch(core):
            inner_case = core[1:] != core[1:].lower() and core != core.upper()
            evidence = _ODD if len(core) > 25 or inner_case else _NUMBER if len(core) < 4 else _PLAIN
        elif not core:
            evidence = _NUMBER if len(token) < 3 else _ODD
        elif re.fullmatch(r"[\d.,]+", core):
            evidence = _NUMBER
        elif re.fullmatch(r"[^\W\d_]+(?:[-.][^\W\d_]+)+", core) or re.fullmatch(r"[^\W_]{2,12}", core):
            evidence = _PLAIN
        else:
            evidence = _ODD
        return evidence, solid, len(token) - solid, int(solid > 0), int(common), len(raw)


def _means(values: np.ndarray, of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of the evidence around each token, within its document."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(values))
    low, high = np.maximum(at - _SPAN // 2, starts[of]), np.minimum(at + _SPAN // 2 + 1, ends[of])
    return (total[high] - total[low]) / np.maximum(high - low, 1)


def statistics_of(texts: list, tokens: _Tokens) -> pd.DataFrame:
    """The statistics of some texts; those of texts without words are 0."""
    n = len(texts)
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    if len(tokens.ids) > 400_000:
        tokens.ids.clear()
        tokens.facts.clear()
    ids = np.fromiter((tokens(t) for s in split for t in s), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    facts = np.array(tokens.facts, float).reshape(-1, 6)[ids] if len(ids) else np.zeros((0, 6))
    evidence, solid, symbols, word, common, length = facts.T
    per = lambda v: np.bincount(of, weights=v, minlength=n)
    prose = per((length + 1) * (_means(evidence, of, starts, ends) > 0))
    words, letters = per(word), per(solid * word)
    lines = np.array([sum(1 for x in t.splitlines() if x.strip()) if t else 0 for t in texts], float)
    ending = np.array([len(_ENDING.findall(t)) if t else 0 for t in texts], float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    return pd.DataFrame(
        {
            "word_count": words,
            "mean_word_length": share(letters, words),
            "symbol_ratio": share(per(symbols), per(solid + symbols)),
            "punctuated_lines": np.minimum(share(ending, lines), 1.0),
            "common_words": share(per(common), words),
            "prose_share": np.minimum(share(prose, np.array([len(t) if t else 0 for t in texts], float)), 1.0),
        }
    )


def text_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, statistics) of whole texts.

    ``common_words`` (lang, word) is a small list, used for all languages at once since the
    stated language of a text may be wrong. A null language is ``und``. Words are tokens
    between blanks that hold a letter or digit; word lengths count letters and digits.
    """
    known = frozenset(r[0] for r in common_words.select(F.lower("word")).where("word is not null").distinct().collect())
    schema = "key long, lang string, " + ", ".join(f"{s} double" for s in STATISTICS)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens(known)
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                yield pd.concat([part[["key", "lang"]].reset_index(drop=True), statistics_of(part["text"].tolist(), tokens)], axis=1)

    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.lower(F.trim(F.col(lang))), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInPandas(scan, schema).withColumnRenamed("key", key)


def profiles(statistics: DataFrame, by: str = "lang") -> DataFrame:
    """(by, statistic, sketch): a KLL sketch of each statistic of each language.

    Written to a table, it is a profile that :func:`score` takes later; profiles of several parts
    are merged there.
    """
    sketches = statistics.groupBy(by).agg(*(F.call_function("kll_sketch_agg_double", F.col(s)).alias(s) for s in STATISTICS))
    return sketches.unpivot([by], STATISTICS, "statistic", "sketch")


def merged(profiles_: DataFrame, *by: str) -> DataFrame:
    """(by..., statistic, sketch) over all other columns, by merging sketches only."""
    return profiles_.groupBy(*by, "statistic").agg(F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"))


def centres(sketches: DataFrame) -> DataFrame:
    """Median, robust scales below and above it (distance of the quartile / 0.6745) and the 99 percentiles of each sketch."""
    q = lambda p: F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(p))
    marks = F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.array(*(F.lit(k / 100) for k in range(1, 100))))
    return sketches.withColumns({"median": q(0.5), "below": (q(0.5) - q(0.25)) / 0.6745, "above": (q(0.75) - q(0.5)) / 0.6745, "marks": marks})


def _percentile(marks: Column, value: Column) -> Column:
    return F.size(F.filter(marks, lambda mark: mark <= value)).cast("double")


def _z(value: Column, median: Column, below: Column, above: Column, least: float) -> Column:
    return (value - median) / F.greatest(F.when(value < median, below).otherwise(above), F.lit(least))


def score(statistics: DataFrame, tail: float = TAIL, profile: DataFrame | None = None, least_prose: float = LEAST_PROSE) -> DataFrame:
    """The statistics with z_<statistic> (robust, by language), pct_<statistic> (percentile) and ``flags``.

    ``profile`` (lang, statistic, sketch) has the sketches to compare with, by default those of the
    documents. Languages that it lacks are compared with all its languages. ``flags`` names the
    statistics of which the value lies in a tail of its language or of all; ``prose_share`` is
    flagged below ``least_prose``, in empty texts too, and nowhere else.
    """
    own = merged(cut(profiles(statistics) if profile is None else profile.select("lang", "statistic", "sketch"), "profiles"), "lang", "statistic")
    parts = [F.first(c).alias(name) for c, name in (("median", "m"), ("below", "b"), ("above", "a"), ("marks", "k"))]
    every = centres(merged(own)).groupBy().pivot("statistic", STATISTICS).agg(*parts).first().asDict()  # one row
    wide = centres(own).groupBy("lang").pivot("statistic", STATISTICS).agg(*parts)
    rows = statistics.join(wide, "lang", "left")
    columns, flags = {}, []
    for s in STATISTICS:
        x = F.col(s)
        whole = [F.lit(every[f"{s}_{part}"]) for part in ("m", "b", "a")]
        marks = F.coalesce(F.col(f"{s}_k"), F.array(*map(F.lit, every[f"{s}_k"] or [])))
        near = [F.coalesce(F.col(f"{s}_{part}"), w) for part, w in zip(("m", "b", "a"), whole)]
        z = _z(x, *near, _SCALE[s])
        columns[f"z_{s}"] = z
        columns[f"pct_{s}"] = _percentile(marks, x)
        absolute = x < least_prose
        flags.append(F.when(absolute if s == "prose_share" else (F.abs(z) >= tail) | (F.abs(_z(x, *whole, _SCALE[s])) >= tail), F.lit(s)))
    return rows.withColumns(columns).withColumn("flags", F.array_compact(F.array(*flags))).select(*statistics.columns, *columns, "flags")


def junk(scored: DataFrame) -> DataFrame:
    """Documents in the absolute tail of running prose; empty texts are among them."""
    return scored.where(F.array_contains("flags", "prose_share"))
