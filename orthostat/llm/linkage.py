"""Deduplicating new batches against all that was accepted before.

Known records are set-valued (the sites of a cluster; the two ends of a relation) and typed.
:class:`KnownRecords` keeps them under a path, between runs: classes of equal sets, their members,
and, for a Jaccard threshold below 1, blocking keys, the values that a similar record can't all
lack (rarest first). A batch probes these tables: the key table holds only (key, class, size), in
buckets by key of which those without a key of the batch aren't read, and token arrays are read
for classes that a key hits. Accepted records are appended. Value frequencies are versioned: a
version orders the keys of the segments written under it, and a new one is made from frequencies
over all records when these have grown by half, so that no segment is ever keyed again.

Candidate pairs are scored field by field with weights learned from their agreement patterns
(Fellegi-Sunter, by EM over the patterns of all candidates so far), the exact rule decides which
records match, and the score which of the matches is named. Representatives are a stored
mapping; a batch changes only the rows of the clusters that it touches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.components import connected_components
from ..session import cut, table_path

#: Keys of a bucket, and the growth at which a new version of the frequencies is made.
BUCKET_KEYS, REFRESH = 1_000_000, 0.5
#: Rows that the expectation of higher agreement among matches counts for, beside the counted patterns.
PRIOR_ROWS = 20
_EPS = 1e-9
#: Fields of a candidate pair with their levels of agreement.
FIELDS = {"overlap": 4, "label": 3, "confidence": 2, "value": 2}
_ITEM = ["item", "label", "confidence", "value"]
_SCHEMAS = {
    "members": "cls string, item string, kind string, tokens array<string>, label string, confidence double, value double",
    "classes": "cls string, kind string, tokens array<string>, item string, label string, confidence double, value double",
    "keys": "key string, cls string, n int, bucket int",
    "ranks": "token string, f long",
    "representatives": "item string, representative string, seq int",
}


def typed_sets(rows: DataFrame, key: str, kind: str, values: Column, label: str | None, confidence: str, also: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """(item, kind, tokens, label, confidence, value): one row per item and set, and per value of ``also``.

    Items without id are left out; an item's repeated rows are one, with its greatest
    confidence. ``values`` is an array of normalised strings; ``label`` and ``value`` name a text
    and a number that scores compare, where records have such.
    """
    text = (F.col(label) if label else F.lit(None)).cast("string").alias("label")
    number = (F.col(value) if value else F.lit(None)).cast("double").alias("value")
    tokens = F.array_sort(F.array_distinct(F.array_compact(values))).alias("tokens")
    picked = rows.select(*also, F.col(key).cast("string").alias("item"), F.col(kind).alias("kind"), tokens, text, F.col(confidence).cast("double").alias("confidence"), number)
    least = [F.min("label").alias("label"), F.max("confidence").alias("confidence"), F.min("value").alias("value")]
    return picked.where("item is not null").groupBy(*also, "item", "kind", "tokens").agg(*least)


def _classed(sets: DataFrame) -> DataFrame:
    """The sets that can match at all, with the name of their class of equal sets."""
    name = F.md5(F.concat_ws("\u0001", "kind", "tokens"))
    return sets.where("kind is not null and size(tokens) > 0").withColumn("cls", name)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the folder's own file system, complete or absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at(path + ".new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(at(path + ".new"), at(path)):
        raise RuntimeError(f"can't commit {path}")


@dataclass
class KnownRecords:
    """Known records of one threshold, kept in tables under ``path``.

    ``state`` is what the last commit says: the segments of each table, the versions of the
    frequencies and the patterns counted so far. Tables without a commit are not seen, so that a
    run that ends half-way leaves the previous state.
    """

    spark: SparkSession
    path: str
    state: dict

    @classmethod
    def create(cls, spark: SparkSession, path: str, history: DataFrame, threshold: float) -> KnownRecords:
        """Index the history once, under a path that holds no records yet."""
        own = cls(spark, path.rstrip("/"), {"seq": 0, "threshold": threshold, "segments": {}, "versions": [], "patterns": {}, "classes": 0})
        own.add(history)
        return own

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KnownRecords:
        """The records as the last commit under ``path`` left them."""
        commits = [json.loads(r[0]) for r in spark.read.text(f"{path.rstrip('/')}/commits").collect()]  # one row a commit
        return cls(spark, path.rstrip("/"), max(commits, key=lambda c: c["seq"]))

    @property
    def threshold(self) -> float:
        return self.state["threshold"]

    def _commit(self, **changes) -> None:
        self.state = {**self.state, **changes, "seq": self.state["seq"] + 1}
        _write_text(self.spark, f"{self.path}/commits/{self.state['seq']:06}.json", json.dumps(self.state))

    def _new(self, name: str) -> str:
        return f"{self.path}/{name}/segment={self.state['seq'] + 1}"

    def _table(self, name: str, version: int | None = None) -> DataFrame | None:
        """All segments of a table (of one version); None where there is none."""
        paths = [p for v, p in self.state["segments"].get(name, []) if version is None or v == version]
        if not paths:
            return None
        # one scan, however many segments
        return self.spark.read.schema(_SCHEMAS[name] + ", segment int").option("basePath", f"{self.path}/{name}").parquet(*paths).drop("segment")

    def _keyed(self, classes: DataFrame, version: dict) -> DataFrame:
        """(key, cls, n, bucket) of classes (cls, kind, tokens), in the order of one version."""
        ranks = self.spark.read.schema(_SCHEMAS["ranks"]).parquet(version["ranks"])
        each = classes.select("cls", "kind", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(ranks, "token", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "token")))
        length = F.col("n") - F.ceil(self.threshold * F.col("n") - _EPS).cast("int") + 1
        first = each.groupBy("cls", "kind", "n").agg(order.alias("o")).select("cls", "kind", "n", F.explode(F.slice("o", F.lit(1), length)).alias("o"))
        key = F.concat_ws("\u0001", "kind", "o.token").alias("key")
        return first.select(key, "cls", "n").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(version["buckets"])).cast("int"))

    def add(self, sets: DataFrame) -> None:
        """Append accepted sets, in one commit; sets of no kind or without values are left out."""
        members = self._new("members")
        _classed(sets).select("cls", "item", "kind", "tokens", "label", "confidence", "value").write.parquet(members)
        rows = self.spark.read.schema(_SCHEMAS["members"]).parquet(members)
        classes = self._new("classes")
        first = F.min(F.struct(*_ITEM)).alias("r")
        rows.groupBy("cls", "kind", "tokens").agg(first).select("cls", "kind", "tokens", "r.*").write.parquet(classes)
        segments = {k: list(v) for k, v in self.state["segments"].items()}
        segments.setdefault("members", []).append([0, members])
        segments.setdefault("classes", []).append([0, classes])
        versions, total = list(self.state["versions"]), 0
        if self.threshold < 1:
            fresh = self.spark.read.schema(_SCHEMAS["classes"]).parquet(classes)
            total = self.state["classes"] + fresh.count()
            if not versions or total > (1 + REFRESH) * versions[-1]["classes"]:
                versions.append(self._version(segments, total))
            version = versions[-1]
            keys = self._new("keys")
            keyed = self._keyed(fresh, version)
            if version["buckets"] > 1:
                keyed = keyed.repartition("bucket")
            keyed.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(keys)
            segments.setdefault("keys", []).append([len(versions) - 1, keys])
        self._commit(segments=segments, versions=versions, classes=total)

    def _version(self, segments: dict, total: int) -> dict:
        """Frequencies of the values over all members so far."""
        ranks = self._new("ranks")
        rows = self.spark.read.schema(_SCHEMAS["members"]).parquet(*(path for _, path in segments["members"]))
        rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f")).write.parquet(ranks)
        keys = self.spark.read.parquet(ranks).agg(F.sum("f")).first()[0] or 0
        return {"ranks": ranks, "classes": total, "buckets": max(1, -(-keys // BUCKET_KEYS))}

    def hit_keys(self, version: int, asked: DataFrame) -> DataFrame:
        """The stored keys of one version in the buckets that the keys ``asked`` fall into."""
        stored = self._table("keys", version)
        buckets = self.state["versions"][version]["buckets"]
        if buckets > 1:
            hit = sorted(r[0] for r in asked.select("bucket").distinct().collect())  # a bucket of the index each
            if len(hit) < buckets:
                stored = stored.where(F.col("bucket").isin(hit))
        return stored

    def candidates(self, classes: DataFrame) -> DataFrame:
        """(cls, k_cls, similarity and the known class's fields) of classes (cls, kind, tokens) that share a key."""
        known = self._table("classes")
        fields = [F.col("cls").alias("k_cls"), *(F.col(c).alias(f"k_{c}") for c in _ITEM)]
        if self.threshold >= 1:
            return classes.select("cls").join(known.select("cls", *fields), "cls").withColumn("similarity", F.lit(1.0))
        pairs = None
        for v, version in enumerate(self.state["versions"]):
            if self._table("keys", v) is None:
                continue
            asked = self._keyed(classes, version)
            asked = cut(asked, "asked") if version["buckets"] > 1 else asked
            stored = self.hit_keys(v, asked).select("key", F.col("cls").alias("k_cls"), F.col("n").alias("m"))
            fits = (F.col("n") >= self.threshold * F.col("m") - _EPS) & (F.col("m") >= self.threshold * F.col("n") - _EPS)
            met = asked.join(stored, "key").where(fits).select("cls", "k_cls")
            pairs = met if pairs is None else pairs.unionByName(met)
        own = classes.select("cls", "tokens")
        both = pairs.distinct().join(known.select(*fields, F.col("tokens").alias("k_tokens")), "k_cls").join(own, "cls")
        shared = F.size(F.array_intersect("tokens", "k_tokens"))
        similarity = shared / (F.size("tokens") + F.size("k_tokens") - shared)
        return both.withColumn("similarity", similarity).drop("tokens", "k_tokens")

    def matches(self, sets: DataFrame) -> DataFrame:
        """(item, cls, k_cls, k_item, similarity, score) of the known classes that the rule accepts.

        Equal sets of the batch are compared as one class. The weights come from the agreement
        patterns of all candidates of this and earlier calls.
        """
        own = _classed(sets)
        classes = own.select("cls", "kind", "tokens").distinct()
        pairs = own.select("cls", *_ITEM).join(self.candidates(classes), "cls")
        pairs = cut(pairs.select("item", "cls", "k_cls", "k_item", "similarity", *levels()), "pairs")
        counts = dict(self.state["patterns"])
        for r in pairs.groupBy(*FIELDS).count().collect():  # one row per pattern
            pattern = ",".join(str(r[f]) for f in FIELDS)
            counts[pattern] = counts.get(pattern, 0) + r["count"]
        self.state["patterns"] = counts
        weights = fellegi_sunter([tuple(map(int, p.split(","))) for p in counts], list(counts.values()))
        score = F.lit(0.0)
        for f in FIELDS:
            score = score + F.element_at(F.array(*(F.lit(w) for w in weights[f])), F.col(f) + 1)
        found = pairs.where(F.col("similarity") >= self.threshold - _EPS)
        return found.select("item", "cls", "k_cls", "k_item", "similarity", score.alias("score"))

    def members(self, found: DataFrame) -> DataFrame:
        """(item, k_item) of all known records whose class the matches ``found`` touch, but for the class's own item."""
        touched = found.select(F.col("k_cls").alias("cls"), "k_item").distinct()
        return self._table("members").select("cls", "item").join(touched, "cls").where("item != k_item").select("item", "k_item")

    def unite(self, links: DataFrame) -> None:
        """Join the representatives of linked records (item, k_item); clusters without a link keep theirs."""
        edges = cut(links.select("item", "k_item").distinct(), "links")
        nodes = edges.select(F.explode(F.array("item", "k_item")).alias("item")).distinct()
        stored = self.representatives()
        now = cut(nodes.join(stored, "item", "left").select("item", F.coalesce("representative", "item").alias("root"), F.col("representative").isNull().alias("fresh")), "now")
        side = lambda column, name: now.select(F.col("item").alias(column), F.col("root").alias(name))
        joined = edges.join(side("item", "a"), "item").join(side("k_item", "b"), "k_item").select("a", "b")
        roots = connected_components(joined, "a", "b").withColumnRenamed("root", "least")
        moved = roots.where("node != least")
        fresh = now.where("fresh").join(roots, F.col("root") == F.col("node"), "left").select("item", F.coalesce("least", "root").alias("representative"))
        changed = stored.join(moved, F.col("representative") == F.col("node")).select("item", F.col("least").alias("representative"))
        path = self._new("representatives")
        fresh.unionByName(changed).withColumn("seq", F.lit(self.state["seq"] + 1)).write.parquet(path)
        segments = {**self.state["segments"], "representatives": [*self.state["segments"].get("representatives", []), [0, path]]}
        self._commit(segments=segments)

    def representatives(self) -> DataFrame:
        """(item, representative): the stored mapping of all records that some match touched."""
        rows = self._table("representatives")
        if rows is None:
            return self.spark.createDataFrame([], "item string, representative string")
        return rows.groupBy("item").agg(F.max_by("representative", "seq").alias("representative"))


def levels() -> list[Column]:
    """Levels of agreement of a candidate pair, 0 the lowest."""
    similarity = F.col("similarity")
    overlap = F.when(similarity >= 1, 3).when(similarity >= 0.8 - _EPS, 2).when(similarity >= 0.5, 1).otherwise(0)
    a, b = (F.lower(F.trim(c)) for c in ("label", "k_label"))
    far = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    label = F.when(a == b, 2).when(far <= 0.3, 1).otherwise(0)
    confidence = F.when(F.abs(F.col("confidence") - F.col("k_confidence")) <= 0.05, 1).otherwise(0)
    x, y = F.col("value"), F.col("k_value")
    value = F.when(F.abs(x - y) <= 0.05 * F.greatest(F.abs(x), F.abs(y)), 1).otherwise(0)
    return [overlap.alias("overlap"), label.alias("label"), confidence.alias("confidence"), value.alias("value")]


def fellegi_sunter(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 100) -> dict[str, list[float]]:
    """log2(m / u) of each level of each field, from counted agreement patterns.

    Without patterns higher levels simply weigh more. Patterns may have fewer fields than
    FIELDS, the first ones.
    """
    fields = dict(list(FIELDS.items())[: len(patterns[0])]) if patterns else FIELDS
    sizes = list(fields.values())
    if not patterns:
        return {f: [float(k) for k in range(n)] for f, n in fields.items()}
    rows, n = np.array(patterns), np.array(counts, float)
    expected = [[np.linspace(*ends, s) / np.linspace(*ends, s).sum() for s in sizes] for ends in ((1, 3), (3, 1))]
    m, u = list(expected[0]), list(expected[1])
    share = 0.5
    for _ in range(rounds):
        pm = share * np.prod([m[k][rows[:, k]] for k in range(len(sizes))], axis=0)
        pu = (1 - share) * np.prod([u[k][rows[:, k]] for k in range(len(sizes))], axis=0)
        g = pm / (pm + pu)
        share = float(np.clip((g * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for k in range(len(sizes)):  # few patterns leave the weights near the expectation
            m[k] = PRIOR_ROWS * expected[0][k] + np.bincount(rows[:, k], g * n, sizes[k])
            u[k] = PRIOR_ROWS * expected[1][k] + np.bincount(rows[:, k], (1 - g) * n, sizes[k])
            m[k], u[k] = m[k] / m[k].sum(), u[k] / u[k].sum()
    return {f: np.log2(m[k] / u[k]).round(6).tolist() for k, f in enumerate(fields)}


def link(known: KnownRecords, batch: DataFrame, least_confidence: float = 0.70, unite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases, links) of one batch (columns of :func:`typed_sets`), whose other confident items are then known.

    ``cases`` (item, matched, similarity, score) has each item that a known record matches, with
    the best one by score, then similarity, then name. ``links`` (item, k_item) has all its matches,
    each with the smallest item of its class, and the other known records of these classes. With
    ``unite`` the stored representatives are brought up to date.
    """
    found = known.matches(batch)
    best = F.max(F.struct("score", "similarity", F.col("k_item").alias("matched"))).alias("b")
    cases = found.groupBy("item").agg(best).select("item", "b.matched", "b.similarity", "b.score")
    links = found.select("item", "k_item").unionByName(known.members(found)).distinct()
    if unite:
        known.unite(links)
    known.add(batch.where(F.col("confidence") >= least_confidence).join(found.select("item").distinct(), "item", "left_anti"))
    return cases, links


def link_all(known: KnownRecords, batches: DataFrame, least_confidence: float = 0.70, unite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases, links) of batches in the order of ``batch_no``; rows without one are left out. ``cases`` has ``batch_no``.

    With ``unite`` the stored representatives are brought up to date once, after the last batch.
    """
    rows = cut(batches.where("batch_no is not null"), "batches")
    cases = links = None
    for batch in sorted(r[0] for r in rows.select("batch_no").distinct().collect()):
        case, more = link(known, rows.where(F.col("batch_no") == batch).drop("batch_no"), least_confidence)
        case = case.select(F.lit(batch).alias("batch_no"), "*")
        cases, links = (case, more) if cases is None else (cases.unionByName(case), links.unionByName(more))
    if cases is None:
        cases = known.spark.createDataFrame([], "batch_no int, item string, matched string, similarity double, score double")
        links = known.spark.createDataFrame([], "item string, k_item string")
    links = links.distinct()
    if unite:
        known.unite(links)
    return cases, links


def link_batches(history: DataFrame, batches: DataFrame, threshold: float, least_confidence: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """:func:`link_all` of batches against a history that is indexed for this call only.

    Known are history rows and items of earlier batches that weren't cases, of at least
    ``least_confidence`` (null is below).
    """
    known = KnownRecords.create(history.sparkSession, table_path(history.sparkSession, "known"), history.where(F.col("confidence") >= least_confidence), threshold)
    return link_all(known, batches, least_confidence)


def representatives(links: DataFrame) -> DataFrame:
    """(item, representative) of all records that some match touches, from all links at once."""
    return connected_components(links, "item", "k_item").select(F.col("node").alias("item"), F.col("root").alias("representative"))
