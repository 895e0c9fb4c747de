"""Mixing sources to target weights by the cube method.

The total is the largest at which each source that has documents can give its share without
using a document more than ``max_repeats`` times. A source then needs each document e times on
average: floor(e) times for certain, and once more with the probability e - floor(e). The cube
method draws the latter so that the tokens and the number of documents come out as expected:
three undecided probabilities at a time move along the null space of the two constraints until
one of them reaches 0 or 1. This flight runs in blocks of bounded size, the few left over in
each block fly again, and at most two documents of a source are left for the landing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

#: Documents of one flight.
BLOCK_ROWS = 20_000


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> tuple[str, str]:
    """(path, pattern) of a byte-level BPE vocabulary of the public tokenizers."""
    import public_tokenizers

    return path or str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def count_tokens(documents: DataFrame, key: str, text: str, source: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id, source, n_tokens): tokens of whole texts; sources without case and outer blanks.

    Null and empty texts have 0 tokens.
    """
    path, pattern = vocabulary or tokenizer()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "n_tokens": np.array(sizes, np.int64)})

    rows = documents.select(F.col(key).cast("string").alias("id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "id string, source string, n_tokens long")


def plan_mix(totals: pd.DataFrame, targets: pd.DataFrame, total_tokens: float | None = None) -> pd.DataFrame:
    """One row per target source: source, target_share, max_repeats, docs, size, tokens, uses.

    ``uses`` is how often each document of the source is used on average. Shares of sources
    without tokens go to the others in proportion. Repeated targets of a source are added up.
    """
    targets = targets.assign(source=targets["source"].str.strip().str.lower())
    targets = targets[targets["source"].notna()].groupby("source", as_index=False).agg(target_share=("target_share", "sum"), max_repeats=("max_repeats", "min"))
    plan = targets.merge(totals, on="source", how="left").fillna({"docs": 0, "size": 0, "target_share": 0.0, "max_repeats": 0})
    live = (plan["size"] > 0) & (plan["target_share"] > 0) & (plan["max_repeats"] > 0)
    share = plan["target_share"].where(live, 0.0)
    share = share / share.sum() if live.any() else share
    most = (plan["max_repeats"] * plan["size"] / share.where(live))[live].min() if live.any() else 0.0
    total = most if total_tokens is None else min(most, total_tokens)
    plan["tokens"] = share * total
    uses = (plan["tokens"] / plan["size"].where(live)).fillna(0.0)
    plan["uses"] = np.minimum(np.where(np.abs(uses - uses.round()) < 1e-9, uses.round(), uses), plan["max_repeats"])
    return plan


def fly(tokens: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: probabilities with sums of p and of p * tokens kept, at most two undecided."""
    p, t = p.astype(float).tolist(), tokens.astype(float).tolist()
    draws = iter(rng.random(len(p) + 8).tolist())
    held: list[int] = []
    eps = 1e-9
    for k in range(len(p)):
        if eps < p[k] < 1 - eps:
            held.append(k)
        while len(held) == 3:
            a, b, c = held
            v = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if not any(v):
                v = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, v) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, v) if x)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for i, x in zip(held, v):
                p[i] += step * x
            for i in held:
                if p[i] <= eps:
                    p[i] = 0.0
                elif p[i] >= 1 - eps:
                    p[i] = 1.0
            held = [i for i in held if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the last ones so that the tokens, then the documents, come closest to what they should."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    done = p.copy()
    want = (tokens[open_] * p[open_]).sum(), p[open_].sum()
    done[open_] = min(product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(np.dot(tokens[open_], x) - want[0]), abs(sum(x) - want[1])))
    return done


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, vocabulary: tuple[str, str] | None = None, seed: int = 7) -> tuple[DataFrame, pd.DataFrame]:
    """((id, source, n_tokens, copies), plan): the documents used and how often, and the plan.

    Only sources with a target take part; the targets are a small table (one row per source).
    """
    wanted = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).toPandas()
    names = sorted({s.strip().lower() for s in wanted["source"].dropna()})
    own = documents.where(F.lower(F.trim(F.col(source))).isin(names))
    sizes = cut(count_tokens(own, key, text, source, vocabulary), "tokens")
    totals = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("size")).toPandas()
    plan = plan_mix(totals, wanted, total_tokens)
    spark = documents.sparkSession
    small = spark.createDataFrame([(r.source, float(r.uses), int(max(1, -(-r.docs // BLOCK_ROWS)))) for r in plan.itertuples()], "source string, uses double, blocks int")
    rows = sizes.join(F.broadcast(small), "source").where("uses > 0").withColumn("whole", F.floor("uses").cast("int")).withColumn("p", F.col("uses") - F.floor("uses"))
    certain = rows.where("p = 0").select("id", "source", "n_tokens", F.col("whole").alias("copies"))
    schema = "id string, source string, n_tokens long, whole int, p double"

    def flight(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["r", "id"])
        rng = np.random.default_rng([seed, len(group), abs(int(group["r"].iloc[0]))])
        return group.assign(p=fly(group["n_tokens"].to_numpy(), group["p"].to_numpy(), rng))[["id", "source", "n_tokens", "whole", "p"]]

    def last(group: pd.DataFrame) -> pd.DataFrame:
        group = flight(group)
        return group.assign(p=land(group["n_tokens"].to_numpy(), group["p"].to_numpy()))

    decided, round_ = [certain], 0
    most = int(plan["docs"].max()) if len(plan) else 0
    undecided = rows.where("p > 0")
    while most > BLOCK_ROWS:  # each block leaves two documents at most
        block = F.pmod(F.xxhash64(F.lit(seed + round_), "id"), F.col("blocks"))
        flown = undecided.withColumn("r", F.xxhash64("id", F.lit(seed))).groupBy("source", block.alias("block")).applyInPandas(flight, schema)
        flown = cut(flown, "flight")
        decided.append(flown.where("p in (0, 1)").select("id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")))
        blocks = -(-most // BLOCK_ROWS)
        most = 2 * blocks
        undecided = flown.where("p > 0 and p < 1").withColumn("blocks", F.lit(-(-most // BLOCK_ROWS)))
        round_ += 1
    landed = undecided.withColumn("r", F.xxhash64("id", F.lit(seed))).groupBy("source").applyInPandas(last, schema)
    decided.append(landed.select("id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")))
    used = decided[0]
    for part in decided[1:]:
        used = used.unionByName(part)
    return used.where("copies > 0"), plan


def reached(used: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, uses, most_uses) of each target source."""
    spark = used.sparkSession
    goal = spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats)) for r in plan.itertuples()], "source string, target_share double, max_repeats int")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"))
    filled = goal.join(got, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    every = F.sum("tokens").over(Window.partitionBy())  # one row per target source
    share = F.when(every > 0, F.col("tokens") / every).otherwise(F.lit(0.0))
    return filled.select("source", "target_share", share.alias("actual_share"), "max_repeats", "tokens", "documents", "uses", "most_uses")
