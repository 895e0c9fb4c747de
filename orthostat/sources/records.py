"""Readers of catalogue records (RDF/XML), histories and run metadata."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_LINK = "array<struct<`_rdf:resource`:string>>"
#: The schema is explicit: inference would read identifiers as numbers and depends on the files.
RECORD_SCHEMA = (
    f"`_rdf:about` string, `rdfs:label` array<struct<_VALUE:string,`_xml:lang`:string>>, `dc:title` array<string>, `dc:description` array<string>, "
    f"`core:description` array<string>, `a-cd:historicalInformation` array<string>, `dc:type` array<string>, `arco:hasCulturalPropertyCategory` {_LINK}, "
    f"`a-loc:hasTypeOfContext` {_LINK}, `arco:regionIdentifier` string, `dc:coverage` array<string>, `clv:hasGeometry` {_LINK}, `a-cd:hasDating` {_LINK}, "
    f"`a-loc:hasCulturalPropertyAddress` {_LINK}, `dcterms:spatial` {_LINK}, `foaf:depiction` {_LINK}, `pico:preview` {_LINK}, _corrupt_record string"
)
CLUSTERS = "cluster_id string, cluster_type string, label string, member_uris array<string>, confidence double, run_id string, created_at timestamp_ntz, metadata string"
RELATIONS = "relation_id string, relation_type string, source_uri string, target_uri string, confidence double, run_id string, created_at timestamp_ntz, value double, metadata string"
PATHS = "path_id string, theme string, path_type string, stop_uris array<string>, confidence double, run_id string, created_at timestamp_ntz, metadata string"


def first_text(column: str) -> Column:
    """The first value of an element that isn't blank, trimmed."""
    kept = F.filter(F.transform(F.col(f"`{column}`"), F.trim), lambda x: x != "")
    return F.get(kept, F.lit(0))


def resources(column: str) -> Column:
    """All non-empty resources of an element."""
    return F.filter(F.transform(F.coalesce(F.col(f"`{column}`"), F.array().cast(_LINK)), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull() & (x != ""))


def label_of(identifier: Column) -> Column:
    """S3: the Italian label, any label, the title, or one made of the identifier."""
    labels = F.col("`rdfs:label`")
    text = lambda x: F.trim(x["_VALUE"])
    italian = F.filter(F.transform(F.filter(labels, lambda x: x["_xml:lang"] == "it"), text), lambda x: x != "")
    every = F.filter(F.transform(labels, text), lambda x: x != "")
    return F.coalesce(F.get(italian, F.lit(0)), F.get(every, F.lit(0)), first_text("dc:title"), F.concat(F.lit("Entity "), identifier))


def read_records(spark: SparkSession, directory: str, limit: int | None = None) -> DataFrame:
    """One row per readable record of ``*.xml``; files without one are skipped.

    Only the first record of a file counts. Records without URI are left out. A missing
    directory is an error, one without files gives no rows. ``limit`` keeps the first files in
    the order of their names that could be read.
    """
    if "://" not in directory and not os.path.isdir(directory):
        raise FileNotFoundError(directory)
    if "://" not in directory and not glob.glob(f"{directory}/*.xml"):
        raw = spark.createDataFrame([], RECORD_SCHEMA)
        raw = raw.withColumn("source_file", F.lit(""))
    else:
        raw = spark.read.format("xml").option("rowTag", "rdf:Description").option("columnNameOfCorruptRecord", "_corrupt_record").schema(RECORD_SCHEMA).load(f"{directory}/*.xml")
        raw = raw.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    uri = F.col("`_rdf:about`")
    identifier = F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)
    images = F.array_distinct(F.concat(resources("foaf:depiction"), resources("pico:preview")))
    one = lambda c: F.get(resources(c), F.lit(0))
    rows = raw.where("_corrupt_record is null").where(uri.isNotNull() & (F.trim(uri) != "")).select(
        uri.alias("uri"), identifier.alias("identifier"), label_of(identifier).alias("label"), F.coalesce(first_text("dc:description"), first_text("core:description")).alias("description"),
        first_text("a-cd:historicalInformation").alias("historical_info"), F.coalesce(first_text("dc:type"), F.lit("dolmen")).alias("property_type"), one("arco:hasCulturalPropertyCategory").alias("category_uri"),
        one("a-loc:hasTypeOfContext").alias("context_type_uri"), F.trim("`arco:regionIdentifier`").alias("region_id"), first_text("dc:coverage").alias("coverage"), one("clv:hasGeometry").alias("geometry_uri"),
        one("a-cd:hasDating").alias("dating_uri"), F.coalesce(one("a-loc:hasCulturalPropertyAddress"), one("dcterms:spatial")).alias("address_uri"), images.alias("image_urls"), "source_file",
    )
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    first = rows.groupBy("source_file").agg(F.min("_at").alias("_at"))
    rows = rows.join(first, ["source_file", "_at"]).drop("_at")
    return rows.orderBy("source_file").limit(limit) if limit is not None else rows


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, relations, paths) of a history; a missing or unreadable part is empty.

    ``path`` holds the parquet tables ``clusters``, ``relations`` and ``paths``, or is a JSON file
    with arrays of these names.
    """

    def of(name: str, ddl: str) -> DataFrame:
        schema = T.StructType.fromDDL(ddl)
        try:
            if path.endswith(".json"):
                whole = spark.read.schema(T.StructType.fromDDL(f"{name} array<struct<{ddl.replace(' ', ':').replace(',:', ',')}>>")).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
                return whole.select(F.explode(name).alias("r")).select("r.*")
            return spark.read.schema(schema).parquet(f"{path}/{name}")
        except Exception:  # noqa: BLE001  a history that can't be read is no error
            return spark.createDataFrame([], schema)

    return of("clusters", CLUSTERS), of("relations", RELATIONS), of("paths", PATHS)


def append_history(df: DataFrame, path: str, name: str) -> None:
    """K7, M1: append rows to a part of the history; runs are partitions, so that no backup is needed."""
    df.write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def history_statistics(clusters: DataFrame, relations: DataFrame, paths: DataFrame) -> DataFrame:
    """M1, M2: (total_runs, last_run, entities_seen), always computed, never stored."""
    runs = clusters.select("run_id", "member_uris").unionByName(paths.select("run_id", F.col("stop_uris").alias("member_uris"))).unionByName(relations.select("run_id", F.array("source_uri", "target_uri").alias("member_uris")))
    seen = runs.select(F.explode("member_uris").alias("u")).agg(F.countDistinct("u").alias("entities_seen")).withColumn("one", F.lit(1))
    own = runs.agg(F.countDistinct("run_id").alias("total_runs"), F.max("run_id").alias("last_run")).withColumn("one", F.lit(1))
    return own.join(seen, "one").drop("one")


def read_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Metadata.json of each run directory, tagged with its name."""
    schema = "run_id string, status string, duration_seconds double, assertions_count long, triples_count long, assertions_by_type map<string,long>, novelty_filtering map<string,struct<proposed:long,novel:long,filtered:long>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{directory}/*/metadata.json")
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/metadata\.json$", 1))
