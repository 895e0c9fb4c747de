import datetime
import json

import pytest
from pyspark.sql import functions as F

from orthostat import cli, pipeline
from orthostat.params import Params
from orthostat.sources import records
from orthostat.streaming.novelty import relations_to_history, request_counts

HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="r" xmlns:dc="d" xmlns:core="c" xmlns:arco="a" xmlns:clv="v" xmlns:a-cd="x" xmlns:a-loc="l" xmlns:dcterms="t" xmlns:foaf="f" xmlns:pico="p">'
FILES = {
    "a.xml": '<rdf:Description rdf:about="http://x/arco/07001"><rdfs:label xml:lang="en">Dolmen</rdfs:label><rdfs:label xml:lang="it">dolmen, Dolmen Uno (Neolitico)</rdfs:label><dc:description> testo </dc:description><arco:regionIdentifier>07</arco:regionIdentifier><dc:coverage>Luras (OT)</dc:coverage><clv:hasGeometry rdf:resource="g/1"/><clv:hasGeometry rdf:resource="g/2"/><foaf:depiction rdf:resource="i/1"/><pico:preview rdf:resource="i/2"/><pico:preview rdf:resource="i/1"/><dcterms:spatial rdf:resource="s/1"/></rdf:Description><rdf:Description rdf:about="http://x/second"><dc:title>no</dc:title></rdf:Description>',
    "b.xml": '<rdf:Description rdf:about="http://x/2/"><rdfs:label> </rdfs:label><dc:title>Titolo (Neolitico)</dc:title><core:description>due</core:description><clv:hasGeometry rdf:resource="g/2"/></rdf:Description>',
    "c.xml": '<rdf:Description><dc:title>without about</dc:title></rdf:Description>',
    "d.xml": '<rdf:Description rdf:about="http://x/4"><dc:type>cista</dc:type></rdf:Description>',
}


@pytest.fixture(scope="module")
def directory(tmp_path_factory):
    d = tmp_path_factory.mktemp("records")
    for name, body in FILES.items():
        (d / name).write_text(f'<?xml version="1.0" encoding="UTF-8"?>{HEAD}{body}</rdf:RDF>', encoding="utf-8")
    (d / "e.xml").write_text("<rdf:RDF><rdf:Description rdf:about='x' <broken", encoding="utf-8")
    return d


def test_records(spark, directory):
    got = {r["source_file"]: r for r in records.read_records(spark, str(directory)).collect()}
    assert set(got) == {"a.xml", "b.xml", "d.xml"}
    a = got["a.xml"]
    assert (a["identifier"], a["label"], a["description"], a["region_id"], a["geometry_uri"], a["address_uri"], a["property_type"]) == ("07001", "dolmen, Dolmen Uno (Neolitico)", "testo", "07", "g/1", "s/1", "dolmen")
    assert a["image_urls"] == ["i/1", "i/2"]
    assert (got["b.xml"]["label"], got["b.xml"]["identifier"], got["b.xml"]["description"]) == ("Titolo (Neolitico)", "2", "due")
    assert (got["d.xml"]["label"], got["d.xml"]["property_type"]) == ("Entity 4", "cista")
    assert [r["source_file"] for r in records.read_records(spark, str(directory), limit=2).collect()] == ["a.xml", "b.xml"]


def test_no_records(spark, tmp_path):
    assert records.read_records(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path / "none"))


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    assert all(part.count() == 0 for part in records.read_history(spark, path))
    for run in ("r1", "r2"):
        rows = spark.createDataFrame([(f"c{run}", "geo", None, ["a", "b"], 0.9, run, datetime.datetime(2024, 1, 1), None)], records.CLUSTERS)
        records.append_history(rows, path, "clusters")
    clusters, relations, paths = records.read_history(spark, path)
    assert clusters.count() == 2
    r = records.history_statistics(clusters, relations, paths).first()
    assert (r["total_runs"], r["last_run"], r["entities_seen"]) == (2, "r2", 2)
    file = tmp_path / "h.json"
    file.write_text(json.dumps({"clusters": [{"cluster_id": "x", "member_uris": ["u"]}], "relations": []}))
    clusters, relations, _ = records.read_history(spark, str(file))
    assert [c["cluster_id"] for c in clusters.collect()] == ["x"] and relations.count() == 0
    file.write_text("{broken")
    assert records.read_history(spark, str(file))[0].count() == 0


def test_runs(spark, tmp_path):
    for name, n in (("run_1", 10), ("run_2", 12)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps({"run_id": name, "assertions_count": n, "novelty_filtering": {"geo": {"proposed": 3, "novel": 2, "filtered": 1}}}, indent=1))
    got = records.read_runs(spark, str(tmp_path)).select("run", "assertions_count", F.col("novelty_filtering")["geo"]["novel"].alias("n")).collect()
    assert sorted((r["run"], r["assertions_count"], r["n"]) for r in got) == [("run_1", 10, 2), ("run_2", 12, 2)]


def test_params(monkeypatch):
    monkeypatch.setenv("ORTHOSTAT_NEAR_KM", "12.5")
    assert Params.load(max_stops=4) == Params(near_km=12.5, max_stops=4)


SITES = "id string, load_order long, lat double, lon double, period_label string"


def test_run_with_proposals_and_history(spark):
    sites = spark.createDataFrame([("s1", 1, 40.0, 10.0, "Neolitico"), ("s2", 2, 40.01, 10.0, "Neolitico"), ("s3", 3, 45.0, 10.0, None)], SITES)
    clusters = spark.createDataFrame([(c, t, "L", m, 0.9) for c, t in (("c1", "geographic"), ("c2", "chronological")) for m in ("s1", "s2")] + [("c3", "geographic", "far", m, 0.9) for m in ("s1", "s3")], "cluster_id string, cluster_type string, label string, member string, stated double")
    relations = spark.createDataFrame([("r1", "nearTo", "s1", "s2", 0.9), ("r2", "contemporaryWith", "s1", "s2", 0.8), ("r3", "nearTo", "s1", "s3", 0.9)], "relation_id string, relation_type string, source string, target string, stated double")
    source = pipeline.TableProposals(clusters, relations)
    result = pipeline.run(spark, sites, source)
    assert {r["assertion_type"]: r["count"] for r in result.assertions.groupBy("assertion_type").count().collect()} == {"geographic_cluster": 1, "chronological_cluster": 1, "nearTo": 1, "contemporaryWith": 1}
    history = (
        result.assertions.where("assertion_type like '%cluster'").select(F.col("assertion_id").alias("item"), F.regexp_replace("assertion_type", "_cluster$", "").alias("kind"), F.col("subject_uris").alias("tokens"), "confidence"),
        result.assertions.where("source_uri is not null").select(F.col("assertion_id").alias("item"), F.col("assertion_type").alias("kind"), F.least("source_uri", "target_uri").alias("a"), F.greatest("source_uri", "target_uri").alias("b"), "confidence"),
    )
    assert pipeline.run(spark, sites, source, history).assertions.count() == 0  # a second run knows it all


CLUSTERS = "cluster_id string, cluster_type string, label string, member string, stated double"
RELATIONS = "relation_id string, relation_type string, source string, target string, stated double"


def counts_of(result):
    return {r["assertion_type"]: r["count"] for r in result.assertions.groupBy("assertion_type").count().collect()}


def test_run_with_types_and_paths(spark):
    sites = spark.createDataFrame([(f"s{k}", k, 40.0 + k / 100, 10.0, None) for k in range(20)], SITES)
    clusters = spark.createDataFrame([(c, "typological", "Passage graves", m, 0.9) for c, ms in (("c1", ("s1", "s2")), ("c2", ("s1", "s3"))) for m in ms], CLUSTERS)
    relations = spark.createDataFrame([("r1", "similarTo", "s1", "s2", 0.9), ("r2", "similarTo", "s1", "s3", 0.2), ("r3", "similarTo", "s1", "s9", 0.9)], RELATIONS)
    extracted = spark.createDataFrame([("s1", "architectural", "Slab"), ("s2", "architectural", "Slab"), ("s1", "material", "granite"), ("s3", "material", "granite"), ("s3", "functional", "burial")], "entity string, category string, label string")
    vectors = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [1.0, 0.1]), ("s3", [0.0, 1.0])], "id string, vector array<double>")
    paths = spark.createDataFrame([("p1", "geographic", "tombs", "Walk", 0.9), ("p2", "mixed", "tombs", "Unknown", 0.9)], "path_id string, path_type string, theme string, label string, stated double")
    stops = spark.createDataFrame([("p1", k, f"s{k}") for k in range(20)] + [("p2", 0, "s1"), ("p2", 1, "nowhere")], "path_id string, ord int, member string")
    source = pipeline.TableProposals(clusters, relations, extracted, vectors, None, (paths, stops))
    result = pipeline.run(spark, sites, source)
    assert counts_of(result) == {"typological_cluster": 1, "similarTo": 1, "extracted_feature": 4, "thematic_path": 2, "path_stop": 12}
    got = {r["label"]: r for r in result.assertions.collect()}
    assert got["Passage graves"]["shared_features"] == ["Slab"] and got["Passage graves"]["subject_uris"] == ["s1", "s2"]
    assert len(got["Walk"]["stops"]) == 10 and got["Walk"]["subject_uris"] == [f"s{k}" for k in range(10)]  # cut to max_stops
    assert got["Unknown"]["confidence"] < got["Walk"]["confidence"]  # scored, not filtered
    assert [r.asDict() for r in result.violations.collect()] == []
    history = (
        result.assertions.where("assertion_type like '%cluster'").select(F.col("assertion_id").alias("item"), F.lit("typological").alias("kind"), F.col("subject_uris").alias("tokens"), F.lit(0.9).alias("confidence")),
        result.assertions.where("source_uri is not null").select(F.col("assertion_id").alias("item"), F.col("assertion_type").alias("kind"), F.least("source_uri", "target_uri").alias("a"), F.greatest("source_uri", "target_uri").alias("b"), F.lit(0.9).alias("confidence")),
        result.assertions.where("assertion_type = 'thematic_path'").select(F.col("assertion_id").alias("item"), "theme", F.col("subject_uris").alias("tokens"), F.lit(0.9).alias("confidence")),
    )
    assert counts_of(pipeline.run(spark, sites, source, history)) == {"extracted_feature": 4}


def test_fallbacks_state_agent_region_centroid_and_years(spark):
    sites = spark.createDataFrame([("s1", 1, 40.0, 10.0, "Neolitico", "Puglia"), ("s2", 2, 40.02, 10.0, "Neolitico", "Puglia"), ("s3", 3, 40.01, 10.0, None, None)], SITES + ", region string")
    rows = {r["assertion_type"]: r for r in pipeline.fallback_clusters(sites, Params()).collect()}
    geo, chrono = rows["geographic_cluster"], rows["chronological_cluster"]
    assert (geo["generated_by"], geo["region"], geo["label"]) == ("geo_analyzer", "Puglia", "Geographic Cluster - Puglia") and abs(geo["centroid_lat"] - 40.01) < 1e-9
    assert chrono["generated_by"] == "temporal_analyzer" and chrono["start_year"] < chrono["end_year"] and chrono["subject_uris"] == ["s1", "s2"]


@pytest.mark.parametrize("what", ["cluster", "relation"])
def test_unknown_types_are_refused(spark, what):
    sites = spark.createDataFrame([("s1", 1, 40.0, 10.0, None)], SITES)
    clusters = spark.createDataFrame([("c", "stylistic" if what == "cluster" else "geographic", "L", "s1", 0.9)], CLUSTERS)
    relations = spark.createDataFrame([("r", "nearTo" if what == "cluster" else None, "s1", "s1", 0.9)], RELATIONS)
    with pytest.raises(ValueError, match="unknown"):
        pipeline.run(spark, sites, pipeline.TableProposals(clusters, relations))


def test_a_second_run_over_the_same_data_is_less_novel(spark, tmp_path):
    sites = spark.createDataFrame([(f"s{k}", k, 40.0 + k / 1000, 10.0, "Neolitico") for k in range(4)], SITES)
    clusters = spark.createDataFrame([(c, t, "L", m, 0.95) for c, t in (("c1", "geographic"), ("c2", "chronological")) for m in ("s1", "s2", "s3")], CLUSTERS)
    relations = spark.createDataFrame([("r1", "nearTo", "s1", "s2", 0.95), ("r2", "contemporaryWith", "s1", "s2", 0.95)], RELATIONS)
    more = spark.createDataFrame([("r3", "nearTo", "s0", "s3", 0.95), ("r1", "nearTo", "s2", "s1", 0.95)], RELATIONS)
    history, out = str(tmp_path / "history"), str(tmp_path / "out")
    metas = []
    for k, pairs in enumerate((relations, relations.unionByName(more))):
        result = pipeline.run(spark, sites, pipeline.TableProposals(clusters, pairs), pipeline.known_history(spark, history))
        metas.append(pipeline.finish(result, out, run_id=f"run_{k}", history=history))
    first, second = (m["novelty_filtering"] for m in metas)
    assert first["geo_analyzer"] == {"proposed": 2, "novel": 2, "filtered": 0} and first["temporal_analyzer"]["filtered"] == 0
    assert second["geo_analyzer"]["novel"] == 1 and second["geo_analyzer"]["filtered"] >= 2 and second["temporal_analyzer"]["novel"] == 0
    assert metas[1]["assertions_by_type"] == {"nearTo": 1}
    assert {r["run_id"] for r in pipeline.read_history(spark, history)[1].collect()} == {"run_0", "run_1"}


def test_similar_feature_labels_are_merged(spark):
    sites = spark.createDataFrame([("s1", 1, None, None, None), ("s2", 2, None, None, None)], SITES)
    extracted = spark.createDataFrame([("s1", "architectural", "slab"), ("s2", "architectural", "slabs")], "entity string, category string, label string")
    vectors = spark.createDataFrame([("architectural", "slab", [1.0, 0.0]), ("architectural", "slabs", [1.0, 0.1])], "category string, label string, vector array<double>")
    made = lambda v: {(r["feature_label"], r["entity_uri"]) for r in pipeline.feature_assertions(sites, extracted, v, Params()).collect()}
    assert made(None) == set() and made(vectors) == {("slab", "s1"), ("slab", "s2")}


def test_run_with_all_fallbacks(spark):
    text = "Dolmen con camera e corridoio, tomba con sepoltura"
    sites = spark.createDataFrame([(f"s{k}", k, 40.0 + k, 10.0, None, text, None) for k in range(3)], SITES + ", description string, historical_info string")
    got = counts_of(pipeline.run(spark, sites))
    assert got == {"typological_cluster": 1, "similarTo": 3, "thematic_path": 1, "path_stop": 3}
    assert set(counts_of(pipeline.run(spark, sites, with_paths=False))) == {"typological_cluster", "similarTo"}


def test_command_line(spark, directory, tmp_path):
    spark.createDataFrame([("g/1", 40.0, 9.0, None), ("g/2", 40.001, 9.0, None)], "geometry_uri string, latitude double, longitude double, wkt string").write.parquet(str(tmp_path / "g"))
    assert cli.main([str(directory), str(tmp_path / "g"), str(tmp_path / "out"), "--format", "turtle"]) == 0
    run = next((tmp_path / "out").iterdir())
    meta = json.loads(next(p for p in (run / "metadata").iterdir() if p.name.startswith("part")).read_text())
    assert meta["assertions_by_type"] == {"geographic_cluster": 1, "chronological_cluster": 1} and meta["triples_count"] > 10
    before = sorted((tmp_path / "out").iterdir())
    assert cli.main([str(directory), str(tmp_path / "g"), str(tmp_path / "out"), "--dry-run", "--quiet"]) == 0 and sorted((tmp_path / "out").iterdir()) == before
    flags = ["--run-id", "second", "--history", str(tmp_path / "history"), "--skip-validation", "--verbose"]
    assert cli.main([str(directory), str(tmp_path / "g"), str(tmp_path / "out"), *flags]) == 0 and (tmp_path / "out" / "second").is_dir()
    assert cli.main(["only-one"]) == 2 and cli.main([str(tmp_path / "no"), str(tmp_path / "g"), str(tmp_path / "out")]) == 3


def test_stream_of_relations(spark, tmp_path):
    schema = "item string, kind string, a string, b string, confidence double"
    source, history = str(tmp_path / "in"), str(tmp_path / "history")
    for k, rows in enumerate(([("x", "near", "a", "b", 0.9), ("y", "near", "a", "c", 0.5)], [("z", "near", "a", "b", 0.9), ("w", "near", "a", "c", 0.9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = relations_to_history(spark.readStream.schema(schema).parquet(source), history, str(tmp_path / "check"))
        q.awaitTermination(60)
        assert q.exception() is None
    got = {r["item"] for r in spark.read.parquet(history).collect()}
    assert got == {"x", "y", "w"}  # y wasn't confident enough to block w


def test_stream_of_requests(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(k, at + datetime.timedelta(seconds=20 * k)) for k in range(9)], "event_id int, ts timestamp_ntz").write.parquet(str(tmp_path / "e"))
    counts = request_counts(spark.readStream.schema("event_id int, ts timestamp_ntz").parquet(str(tmp_path / "e")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.sql("select n from counts order by start").collect()] == [3, 3, 3]
