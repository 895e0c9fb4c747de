"""Evaluation texts that leak into training text.

Documents are compared with the passages of items by windows of as many words: passages of a
fixed number of words, and, for near copies, item-sized ones. Each window has a SimHash of 64
bits over its pairs of neighbouring words. The fingerprints of the items' windows are indexed by four blocks of 16
bits: fingerprints at most ``radius`` bits apart differ by at most ``radius // 4`` bits in one
block at least, and a block is looked up with all such changes, so that none is missed. Each
candidate is then verified by the exact similarity of the two windows' weighted shingles of five
words.

The corpus is read once for each bounded part of the items' windows and never shuffled; whole
texts are scanned.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Words of a passage, bits by which fingerprints may differ, the same for near copies, words of a shingle.
PASSAGE, RADIUS, NEAR_RADIUS, SHINGLE = 12, 3, 7, 5
#: Blocks of a fingerprint.
_BLOCKS = 4
#: Item-sized windows have the largest of these sizes that fits into the item; each is a quarter above the last.
SIZES = [PASSAGE]
while SIZES[-1] < 200:
    SIZES.append(SIZES[-1] * 5 // 4)
#: Windows of items sent to the executors at once (about 150 bytes each).
MAX_WINDOWS = 200_000
_CHUNK_WORDS = 150_000
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _dropped() -> re.Pattern:
    """Combining marks, soft hyphens and zero-width spaces."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    runs: list[list[int]] = []
    for c in sorted([*marks, 0xAD, 0x200B]):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters or digits after NFKD, without marks, lower-cased."""
    if not text:
        return []
    if not text.isascii():
        text = _dropped().sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


class _Codes(dict):
    """64-bit codes of words, made once each."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def _coded(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of some texts, and the text of each."""
    found = [list(map(_codes.__getitem__, words_of(t))) for t in texts]
    sizes = [len(w) for w in found]
    return np.fromiter((c for w in found for c in w), np.uint64, sum(sizes)), np.repeat(np.arange(len(texts)), sizes)


def simhashes(codes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` (less than 256) consecutive words."""
    if len(codes) < size:
        return np.array([], np.uint64)
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1)
    n, total, start, power = len(codes) - size + 1, None, 0, bits
    left = size
    step = 1
    while left:  # sums over windows by doubling
        if left & 1:
            part = power[start : start + n]
            total = part.copy() if total is None else total + part
            start += step
        left >>= 1
        if left:
            power = power[:-step] + power[step:]
            step *= 2
    return np.packbits(total > size // 2, axis=1).view(np.uint64).ravel()


def fingerprints(codes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window over its pairs of neighbouring words; single words are too common to tell windows apart."""
    if size < 2:
        return simhashes(codes, size)
    with np.errstate(over="ignore"):
        pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
        pairs = (pairs ^ pairs >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return simhashes(pairs ^ pairs >> np.uint64(32), size - 1)


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(codes, size)


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Code of the shingle at each place; less words than a shingle has are one."""
    size = min(SHINGLE, len(codes))
    out = np.zeros(len(codes) - size + 1 if size else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


@dataclass
class _Index:
    """The windows of one length: item, codes, fingerprint, and per block their order by value."""

    size: int
    items: np.ndarray
    codes: np.ndarray
    prints: np.ndarray
    blocks: list

    @classmethod
    def of(cls, size: int, items: np.ndarray, codes: np.ndarray, radius: int) -> _Index:
        prints = np.concatenate([fingerprints(row, size) for row in codes])
        changes = np.array([sum(1 << b for b in bits) for n in range(radius // _BLOCKS + 1) for bits in combinations(range(16), n)], np.uint64)
        blocks = []
        for k in range(_BLOCKS):
            shift = np.uint64(16 * k)
            value = (((prints >> shift) & np.uint64(0xFFFF))[:, None] ^ changes).ravel()
            order = np.argsort(value, kind="stable")
            known = np.zeros(1 << 16, bool)
            known[value.astype(int)] = True
            blocks.append((shift, order // len(changes), value[order], known))
        return cls(size, items, codes, prints, blocks)

    def probe(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, indexed window) of all fingerprints at most ``radius`` bits apart."""
        at, with_ = [np.array([], np.int64)], [np.array([], np.int64)]
        for shift, order, values, known in self.blocks:
            value = (prints >> shift) & np.uint64(0xFFFF)
            some = np.flatnonzero(known[value.astype(np.intp)])
            value = value[some]
            first, last = np.searchsorted(values, value), np.searchsorted(values, value, "right")
            count = last - first
            for k in range(0, len(some), 20_000):  # bounds what one step holds
                c = count[k : k + 20_000]
                where = np.repeat(some[k : k + 20_000], c)
                what = order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[k : k + 20_000], c)]
                near = np.bitwise_count(prints[where] ^ self.prints[what]) <= radius
                at.append(where[near])
                with_.append(what[near])
        pairs = np.unique(np.concatenate(at).astype(np.int64) << 32 | np.concatenate(with_).astype(np.int64))
        return pairs >> 32, pairs & 0xFFFFFFFF


def item_windows(items: DataFrame, key: str, text: str, passage: int = PASSAGE, sized: bool = False) -> DataFrame:
    """(item, size, codes): each window of ``passage`` words of an item; an item of fewer words is one window.

    With ``sized`` the windows are item-sized instead: of the largest of SIZES that fits, or all
    of a shorter item.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"]):
                codes = np.array([_codes[w] for w in words_of(text)], np.uint64).view(np.int64)
                size = max((s for s in SIZES if s <= len(codes)), default=len(codes)) if sized else min(passage, len(codes))
                if size:
                    rows += [(item, size, w) for w in _windows(codes, size)]
            yield pd.DataFrame(rows, columns=["item", "size", "codes"])

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null")
    return rows.mapInPandas(cut_up, "item long, size int, codes array<long>").distinct()


def shared_shingles(windows: DataFrame) -> DataFrame:
    """(shingle, n) of the shingles that windows of ``n`` > 1 items have, over all items."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_shingles(np.asarray(c, np.int64).view(np.uint64)).view(np.int64) for c in batch["codes"]]
            rows = pd.DataFrame({"item": np.repeat(batch["item"].to_numpy(), [len(f) for f in found]), "shingle": np.concatenate(found) if found else np.array([], np.int64)})
            yield rows.drop_duplicates()

    own = windows.select("item", "codes").mapInPandas(each, "item long, shingle long").distinct()
    return own.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_similarity: float = 1.0, passage: int = PASSAGE, radius: int | None = None) -> DataFrame:
    """(doc_id, item_id, similarity, position): documents with a passage of an item, each pair once.

    ``similarity`` is the best of the windows' weighted shingle similarities, ``position`` the
    first word of the best window. At ``min_similarity`` 1 the windows have ``passage`` words and
    are equal word by word; below, they are item-sized, so that nearly whole items come out.
    Shingles of several items weigh less (1 / items). Documents and items without words, and null texts, give nothing;
    repeated rows count once.
    """
    near = min_similarity < 1
    radius = radius if radius is not None else NEAR_RADIUS if near else RADIUS
    windows = cut(item_windows(items, item_key, text, passage, near), "windows")
    n = windows.count()
    parts = max(1, -(-n // MAX_WINDOWS))
    of_part = F.pmod(F.xxhash64("item", "codes"), F.lit(parts))
    docs = documents.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    schema = "doc long, item long, similarity double, position int"
    often = cut(shared_shingles(windows), "shingles") if near else None
    found = None
    for part in range(parts):
        rows = windows.where(of_part == part).toPandas()  # MAX_WINDOWS rows or so
        sizes = [(int(size), g["item"].to_numpy(), np.array(g["codes"].tolist(), np.int64).view(np.uint64)) for size, g in rows.groupby("size")]
        weights = _weights(sizes, often) if near else {}
        shared = documents.sparkSession.sparkContext.broadcast((sizes, weights))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sizes, weights = shared.value
            indexes = [_Index.of(*s, radius) for s in sizes]
            for batch in batches:
                keys, texts = batch["doc"].to_numpy(), batch["text"].tolist()
                start = 0
                lengths = np.cumsum([len(t) if t else 0 for t in texts])
                while start < len(texts):
                    done = lengths[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(lengths, done + 6 * _CHUNK_WORDS, "right")))
                    yield from _scan(keys[start:stop], *_coded(texts[start:stop]), indexes, weights, min_similarity, radius)
                    start = stop

        hits = docs.mapInPandas(scan, schema)
        found = hits if found is None else found.unionByName(hits)
    # a document may come in several rows, an item in several parts
    best = F.max(F.struct("similarity", (-F.col("position")).alias("p"))).alias("b")
    found = found.groupBy("doc", "item").agg(best).select("doc", "item", "b.similarity", (-F.col("b.p")).alias("position"))
    return found.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "similarity", "position")


def _weights(sizes: list, often: DataFrame) -> dict[int, float]:
    """Weights below 1 of the shingles of some windows (at most MAX_WINDOWS), from all items."""
    own = np.unique(np.concatenate([_shingles(row) for _, _, codes in sizes for row in codes])) if sizes else np.array([], np.uint64)
    if not len(own):
        return {}
    wanted = often.sparkSession.createDataFrame(pd.DataFrame({"shingle": own.view(np.int64)}))
    return {r["shingle"] & 0xFFFFFFFFFFFFFFFF: 1.0 / r["n"] for r in often.join(wanted, "shingle").collect()}


def _scan(keys: np.ndarray, codes: np.ndarray, of: np.ndarray, indexes: list[_Index], weights: dict, least: float, radius: int) -> Iterator[pd.DataFrame]:
    rows = []
    for index in indexes:
        if len(codes) < index.size:
            continue
        prints = fingerprints(codes, index.size)
        inside = np.flatnonzero(of[: len(prints)] == of[index.size - 1 :])
        at, what = index.probe(prints[inside], radius)
        at = inside[at]
        mine = _windows(codes, index.size)
        equal = (mine[at] == index.codes[what]).all(axis=1)
        rows.append(pd.DataFrame({"at": at[equal], "item": index.items[what[equal]], "similarity": 1.0}))
        if least < 1 and not equal.all():
            at, what = at[~equal], what[~equal]
            score = np.array([_similarity(mine[a], index.codes[w], weights) for a, w in zip(at, what)])
            rows.append(pd.DataFrame({"at": at[score >= least], "item": index.items[what[score >= least]], "similarity": score[score >= least]}))
    if rows and len(hits := pd.concat(rows)):
        first = np.searchsorted(of, of[hits["at"]])
        hits = hits.assign(doc=keys[of[hits["at"]]], position=(hits["at"] - first).astype(np.int32)).sort_values(["similarity", "position"], ascending=[False, True])
        yield hits.drop_duplicates(["doc", "item"])[["doc", "item", "similarity", "position"]]


def _similarity(text: np.ndarray, item: np.ndarray, weights: dict) -> float:
    """Weighted Jaccard similarity of a window of a text and one of an item.

    Shingles of the text that the item lacks weigh as much as those of the item on average.
    """
    a, b = set(_shingles(text).tolist()), set(_shingles(item).tolist())
    own = {s: weights.get(s, 1.0) for s in b}
    total = sum(own.values())
    return sum(own[s] for s in a & b) / (total + len(a - b) * total / len(b))
