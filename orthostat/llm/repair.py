"""Mapping freely typed values to the entries of a reference list.

Distinct values are cut into tokens. Each distinct token, and each value written without
blanks, is joined to the vocabulary of the reference list by edit distance: a vocabulary
string of k allowed edits is split into k + 1 segments, of which one at least must occur in the
token near its place (an equi-join, so that no token meets the whole vocabulary). The entries
that share a repaired token with a value are ranked by soft TF-IDF over the repaired tokens;
glued, cut off and turned values are compared as strings. Values that reach no entry, or two
different ones equally, are reported as unmatched.

Which words wrap or qualify values without changing what they mean is learned from all values: a
word that stands beside many different entries, in values that name an entry word by word, says
nothing of which one is meant.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

#: Score from which an entry is taken, and its lead over the next other entry.
LEAST_SCORE, LEAST_LEAD = 0.74, 0.015
#: Keys of the vocabulary (about 100 bytes each) up to which it is broadcast.
BROADCAST_KEYS = 200_000

#: What it costs to cut words off at the ends of a value without blanks.
STRIPPED = 0.08
#: A word wraps values of a kind if it stands beside so many of the kind's entries, and this share of them.
WRAPPING_ENTRIES, WRAPPING_SHARE = 3, 0.15
# Digits that stand for letters in damaged text.
_LOOKS = str.maketrans("01345", "oleas")
#: A mark of a word that was cut off.
_CUT = re.compile(r"[^\W\d_](?:\.+|…)(?:[\s,?)\"']|$)")
_STOP = {"di", "a", "d", "in", "of", "da", "del", "the"}


@lru_cache(maxsize=200_000)
def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of bits at a time."""
    if a == b or not a or not b:
        return max(len(a), len(b)) if a != b else 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    last, mask = 1 << (len(a) - 1), (1 << len(a)) - 1
    plus, minus, score = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        vertical = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up, down = minus | ~(eq | plus) & mask, plus & eq
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & mask, (down << 1) & mask
        plus, minus = down | ~(vertical | up) & mask, up & vertical
    return score


def allowed_edits(length: int) -> int:
    """Edits within which a string of the vocabulary is recognised."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


def normal(text: str) -> str:
    """Compatibility form, lower case, without marks."""
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower().replace("’", "'")


def tokens_of(text: str) -> list[str]:
    """Runs of letters and digits; digits within words read as the letters that they look like."""
    found = re.findall(r"[^\W_]+", text.replace("'", ""))
    return [t.translate(_LOOKS) if sum(c.isalpha() for c in t) > 1 else t for t in found]


def _segments(word: str) -> list[tuple[int, int, str]]:
    """(part, start, text) of a vocabulary string: allowed edits + 1 even segments."""
    k = allowed_edits(len(word))
    edges = [len(word) * i // (k + 1) for i in range(k + 2)]
    return [(i, edges[i], word[edges[i] : edges[i + 1]]) for i in range(k + 1)]


@lru_cache(maxsize=50_000)
def _probes(token: str) -> frozenset[str]:
    """Keys at which a token meets all vocabulary strings within their allowed edits.

    Of all segments that match, one has at most as many edits before it as segments, and few
    enough behind it; only the places that this leaves are looked up.
    """
    keys = set()
    for length in range(max(1, len(token) - 3), len(token) + 4):
        k = allowed_edits(length)
        if abs(length - len(token)) > k:
            continue
        edges = [length * i // (k + 1) for i in range(k + 2)]
        for i in range(k + 1):
            size = edges[i + 1] - edges[i]
            longer, after = len(token) - length, k - i
            first, last = edges[i] + max(-i, longer - after), edges[i] + min(i, longer + after)
            for start in range(max(0, first), min(len(token) - size, last) + 1):
                keys.add(f"{length}:{i}:{token[start : start + size]}")
    return frozenset(keys)


def _vocabulary(form: str) -> set[str]:
    """Strings of a form that a value may contain: its longer tokens and the form without blanks."""
    words = tokens_of(normal(form))
    return {w for w in words if len(w) > 2 and w not in _STOP} | {"".join(words)}


class Wrapping:
    """The words of one kind that wrap values, and what is left of values without them."""

    def __init__(self, words: Iterable[str] = (), named: Iterable[str] = ()):
        self.words = frozenset(words)
        #: those that no entry's forms have
        self.foreign = self.words - frozenset(named)
        self._by_length: dict[int, list[str]] = {}
        for w in self.words:
            self._by_length.setdefault(len(w), []).append(w)
        self._ends = sorted({w.rstrip("0123456789") for w in self.words} - {""}, key=lambda w: (-len(w), w))
        self._known: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        """Whether the word, perhaps with some edits, is one of them."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 100_000:
                self._known.clear()
            near = (q for n in range(len(word) - 3, len(word) + 4) for q in self._by_length.get(n, ()))
            known = self._known[word] = word in self.words or any(edit_distance(word, q) <= allowed_edits(len(q)) for q in near)
        return known

    def _ending(self, glued: str) -> str:
        """One number or wrapping word less at the end."""
        shorter = glued.rstrip("0123456789")
        return shorter if shorter != glued else next((glued[: -len(w)] for w in self._ends if glued.endswith(w)), glued)

    def _start(self, glued: str) -> str:
        return next((glued[len(w) :] for w in self._ends if len(w) > 1 and glued.startswith(w)), glued)

    def bare(self, glued: str) -> list[str]:
        """A value without blanks, cut shorter by such words and by numbers at its ends, step by step."""

        def chain(text: str, step) -> list[str]:
            out = [text]
            while len(shorter := step(out[-1])) >= 4 and shorter != out[-1]:
                out.append(shorter)
            return out

        return [shorter for first in chain(glued, self._start) for shorter in chain(first, self._ending)]

    def glued(self, text: str, words: list[str]) -> dict[str, float]:
        """The value without blanks, with what the form costs: as typed, without wrapping words, and with a turned order undone."""
        orders = [words]
        if "," in text:
            head, tail = text.split(",", 1)
            orders.append(tokens_of(tail) + tokens_of(head))
        whole = ["".join(w for w in order if w not in drop and (not drop or not w.isdigit())) for order in orders for drop in ((), self.words, self.foreign)]
        costs = dict.fromkeys((g for g in whole if g), 0.0)
        raw = "".join(re.findall(r"[^\W_]+", text))  # digits at the ends are numbers, not letters
        for g in [*costs, raw]:
            for shorter in self.bare(g):
                costs.setdefault(shorter.translate(_LOOKS), STRIPPED)
        return costs


def similarity(text: str, words: list[str], glued_forms: dict[str, float], form: str, weights: dict[str, float], wrapping: Wrapping) -> float:
    """How well a value, with its words and its forms without blanks, means a form of an entry, from 0 to 1."""
    wanted = tokens_of(normal(form))
    whole = "".join(wanted)
    if not words or not wanted:
        return 0.0
    # soft TF-IDF: each token of the form with the best token of the value that is left
    left, got, total = list(words), 0.0, 0.0
    for w in sorted(wanted, key=len, reverse=True):
        weight = weights.get(w, 1.0) * (0.2 if w in _STOP else 1.0)
        total += weight
        best = min(left, key=lambda v: edit_distance(w, v), default=None)
        if best is not None and (d := edit_distance(w, best)) <= allowed_edits(len(w)):
            got += weight * (1 - d / max(len(w), len(best)))
            left.remove(best)
    known = sum(len(w) for w in wanted)
    extra = sum(len(v) for v in left if len(v) > 2 and not v.isdigit() and v not in wrapping)
    soft = got / total * (known / (known + 0.5 * extra))
    # written without blanks, turned, or cut off
    best = soft
    for glued, cost in glued_forms.items():
        if len(glued) > len(whole) + 3:
            continue
        d = edit_distance(glued, whole)
        if d <= max(allowed_edits(len(whole)), 1):
            best = max(best, 1 - d / max(len(glued), len(whole)) - 0.005 - cost)
        if 4 <= len(glued) < len(whole) and (_CUT.search(text) or len(glued) >= 0.5 * len(whole)):
            near = min(edit_distance(glued, whole[:k]) for k in range(max(1, len(glued) - 1), min(len(whole), len(glued) + 1) + 1))
            if near <= (1 if len(glued) >= 6 else 0):
                best = max(best, 0.92 - 0.08 * near - cost)
    return best


def forms_of(terms: DataFrame) -> DataFrame:
    """(term_id, kind, form): the term and the aliases of each entry."""
    every = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    return terms.select("term_id", "kind", F.explode(F.array_distinct(every)).alias("form")).where("form is not null and trim(form) != ''").distinct()


def wrapping_words(values: DataFrame, terms: DataFrame, least: int = WRAPPING_ENTRIES, share: float = WRAPPING_SHARE) -> DataFrame:
    """(kind, token, entries, named): the words that stand beside many entries, from all distinct values (kind, value).

    Counted are values that hold all words of a form of an entry, spelled alike. ``named`` are the
    words that some entry's form has as well.
    """
    schema = "kind string, text string, tokens array<string>"

    def cut_up(column: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"kind": batch["kind"], "text": batch[column], "tokens": [list(dict.fromkeys(tokens_of(normal(t)))) for t in batch[column]]})

        return run

    forms = forms_of(terms)
    named = forms.select("kind", "form").distinct().mapInPandas(cut_up("form"), schema).withColumnRenamed("text", "form").where("size(tokens) > 0")
    of_form = forms.join(named, ["kind", "form"]).select("kind", "term_id", "form", F.col("tokens").alias("wanted"))
    rows = values.select("kind", "value").mapInPandas(cut_up("value"), schema)
    # a form is met at its rarest word only
    often = of_form.select("kind", "form", F.explode("wanted").alias("token")).distinct()
    rank = often.join(often.groupBy("kind", "token").agg(F.count("*").alias("n")), ["kind", "token"])
    rarest = rank.groupBy("kind", "form").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    met = rows.select("kind", "tokens", F.explode("tokens").alias("token")).join(of_form.join(rarest, ["kind", "form"]), ["kind", "token"])
    beside = met.where(F.size(F.array_except("wanted", "tokens")) == 0).select("kind", "term_id", F.explode(F.array_except("tokens", "wanted")).alias("token")).distinct()
    entries = terms.groupBy("kind").agg(F.countDistinct("term_id").alias("all"))
    counts = beside.groupBy("kind", "token").agg(F.count("*").alias("entries")).join(entries, "kind")
    many = counts.where((F.col("entries") >= least) & (F.col("entries") >= share * F.col("all")))
    names = often.select("kind", "token", F.lit(True).alias("named")).distinct()
    return many.join(names, ["kind", "token"], "left").select("kind", "token", "entries", F.coalesce("named", F.lit(False)).alias("named"))


def match_values(values: DataFrame, terms: DataFrame, least: float = LEAST_SCORE, lead: float = LEAST_LEAD, wrapping: DataFrame | None = None) -> DataFrame:
    """(kind, value, term_id, score): the entry of its kind that each distinct value means, or -1.

    ``values`` has (kind, value), ``terms`` (term_id, kind, term, aliases). Null and blank values
    give no row. Entries of one kind compete; an entry counts with its best form. ``wrapping``
    (kind, token, named) has the words that say nothing, by default those of :func:`wrapping_words`.
    """
    forms = forms_of(terms)
    distinct = cut(values.select("kind", "value").where("kind is not null and value is not null and trim(value) != ''").distinct(), "values")
    wraps: dict[str, tuple[set[str], set[str]]] = {}
    # at most 1 / WRAPPING_SHARE of the words beside an entry on average
    for r in (wrapping_words(distinct, terms) if wrapping is None else wrapping).select("kind", "token", "named").collect():
        words, named = wraps.setdefault(r["kind"], (set(), set()))
        words.add(r["token"])
        if r["named"]:
            named.add(r["token"])

    longest = forms.agg(F.max(F.length("form"))).first()[0] or 0  # longer strings mean no form

    def vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(kind, tid, form, w, f"{len(w)}:{i}:{part}") for kind, tid, form in zip(batch["kind"], batch["term_id"], batch["form"]) for w in _vocabulary(form) for i, _, part in _segments(w)]
            rows += [(kind, tid, form, "", f"cut:{''.join(tokens_of(normal(form)))[a : a + 4]}") for kind, tid, form in zip(batch["kind"], batch["term_id"], batch["form"]) for a in (0, 1)]
            yield pd.DataFrame(rows, columns=["kind", "term_id", "form", "word", "key"])

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {kind: Wrapping(*words) for kind, words in wraps.items()}
        for batch in batches:
            rows = []
            for kind, value in zip(batch["kind"], batch["value"]):
                wrapping, text = known.setdefault(kind, Wrapping()), normal(value).strip()
                words = tokens_of(text)
                glued = wrapping.glued(text, words)
                for w in dict.fromkeys([w for w in words if w not in wrapping.words] + list(glued)):
                    if 2 < len(w) <= longest + 3 and w not in _STOP:
                        rows += [(kind, value, w, key) for key in _probes(w)]
                starts = dict.fromkeys(g[a : a + 4] for g in glued for a in (0, 1) if len(g) >= 4)
                rows += [(kind, value, "", f"cut:{start}") for start in starts]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["kind", "value", "token", "key"])
                    rows = []
            yield pd.DataFrame(rows, columns=["kind", "value", "token", "key"])

    # few bytes, but much work for each row: spread it evenly, whatever the size of the tables
    spread = max(distinct.sparkSession.sparkContext.defaultParallelism, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = cut(forms.mapInPandas(vocabulary, "kind string, term_id long, form string, word string, key string"), "vocabulary")
    asked = distinct.repartition(spread, "kind", "value").mapInPandas(probes, "kind string, value string, token string, key string")
    # the planner can't know how many keys a value has: only a vocabulary of known size is broadcast
    known = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")
    meets = asked.join(known, ["kind", "key"]).where((F.col("token") == "") | (F.levenshtein("token", "word") <= F.when(F.length("word") < 4, 0).when(F.length("word") < 6, 1).when(F.length("word") < 12, 2).otherwise(3)))
    pairs = cut(meets.select("kind", "value", "term_id", "form").distinct(), "pairs")
    # inverse document frequency of the vocabulary's words, within a kind
    words = F.filter(F.split(F.lower(F.regexp_replace("form", "'", "")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    often = forms.select("kind", "term_id", F.explode(words).alias("w")).groupBy("kind", "w").agg(F.countDistinct("term_id").alias("df"))
    entries = {r["kind"]: r["n"] for r in terms.groupBy("kind").agg(F.countDistinct("term_id").alias("n")).collect()}
    weights = forms.select("kind", "form", F.explode(words).alias("w")).distinct().join(often, ["kind", "w"]).groupBy("kind", "form").agg(F.collect_list(F.struct("w", "df")).alias("df"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {kind: Wrapping(*words) for kind, words in wraps.items()}

        @lru_cache(maxsize=10_000)
        def parts(kind: str, value: str) -> tuple[str, list[str], dict[str, float]]:
            text = normal(value).strip()
            words = tokens_of(text)
            return text, words, known.setdefault(kind, Wrapping()).glued(text, words)

        for batch in batches:
            scores = []
            for kind, value, form, df in zip(batch["kind"], batch["value"], batch["form"], batch["df"]):
                n = entries[kind]
                weights = {normal(r["w"]): log(1 + n / r["df"]) for r in df}
                scores.append(similarity(*parts(kind, value), form, weights, known.setdefault(kind, Wrapping())))
            yield batch[["kind", "value", "term_id"]].assign(score=scores)

    ranked = pairs.join(weights, ["kind", "form"]).repartition(spread, "kind", "value").mapInPandas(rank, "kind string, value string, term_id long, score double")
    by_term = ranked.groupBy("kind", "value", "term_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("kind", "value").orderBy(F.col("score").desc(), "term_id")
    best = by_term.withColumns({"k": F.row_number().over(order), "next": F.lead("score").over(order)}).where("k = 1")
    sure = (F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= lead)
    best = best.select("kind", "value", F.when(sure, F.col("term_id")).otherwise(F.lit(-1).cast("long")).alias("term_id"), "score")
    return distinct.join(best, ["kind", "value"], "left").select("kind", "value", F.coalesce("term_id", F.lit(-1).cast("long")).alias("term_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(record_id, pos, kind, value, term_id, score) of (record_id, pos, kind, value).

    Values that are a term of their kind character for character are left out, as are null and
    blank ones; repeated rows count once.
    """
    exact = terms.select("kind", F.col("term").alias("value")).where("term is not null").distinct()
    free = cut(rows.select("record_id", "pos", "kind", "value").where("value is not null and trim(value) != ''").distinct().join(exact, ["kind", "value"], "left_anti"), "free")
    return free.join(match_values(free, terms), ["kind", "value"]).select("record_id", "pos", "kind", "value", "term_id", "score")
