"""Command line: ``python -m orthostat.cli RECORDS GEOMETRIES OUT``; ``--help`` lists the flags.

Exit codes: 0 done, 1 shape violations, 2 wrong arguments, 3 unreadable input, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import pipeline
from .functions import text
from .graph.sinks import FORMATS
from .operators.proximity import site_points
from .params import Params
from .session import cut, get_session, ship
from .sources.records import read_records


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orthostat", description="Turn catalogue records into a checked knowledge graph.")
    parser.add_argument("records", help="directory of RDF/XML records")
    parser.add_argument("geometries", help="parquet table (geometry_uri, latitude, longitude, wkt)")
    parser.add_argument("out", help="directory of the runs")
    parser.add_argument("--format", default="ntriples", choices=sorted(FORMATS))
    parser.add_argument("--limit", type=int, help="read so many records at most")
    parser.add_argument("--master", help="Spark master, if none is set")
    parser.add_argument("--max-radius-km", type=float, default=Params.max_radius_km)
    parser.add_argument("--paths", action="store_true", help="make paths through the first clusters as well")
    parser.add_argument("--history", help="directory of the accepted assertions of earlier runs; known ones are dropped, new ones appended")
    parser.add_argument("--run-id", help="name of the run, by default its time")
    parser.add_argument("--dry-run", action="store_true", help="read the records, print their number and stop")
    parser.add_argument("--skip-validation", action="store_true", help="don't check the graph")
    loud = parser.add_mutually_exclusive_group()
    loud.add_argument("--verbose", action="store_true", help="say what is being done")
    loud.add_argument("--quiet", action="store_true", help="print nothing but errors")
    parser.add_argument("--version", action="version", version="orthostat 0.2")
    parser.add_argument("--strict", action="store_true", help="shape violations give exit code 1")
    try:
        given = parser.parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    say = (lambda x: None) if given.quiet else print
    tell = (lambda x: print(x, file=sys.stderr)) if given.verbose else (lambda x: None)
    spark = get_session(master=given.master)
    ship(spark)
    try:
        records = read_records(spark, given.records, given.limit)
        points = site_points(records, spark.read.parquet(given.geometries)).withColumnRenamed("key", "identifier")
        # ids grow over the sorted partitions, hence in the order of the file names
        ordered = cut(records.orderBy("source_file").withColumn("load_order", F.monotonically_increasing_id()), "records")
        sites = ordered.join(points, "identifier", "left").select(F.col("identifier").alias("id"), "load_order", "lat", "lon", text.period_in_label(F.col("label")).alias("period_label"), text.site_name(F.col("label")).alias("name"), "description", "historical_info")
        if given.dry_run:
            say(f"{sites.count()} sites")
            return 0
        known = pipeline.known_history(spark, given.history) if given.history else None
        tell("analysing")
        result = pipeline.run(spark, sites, None, known, Params.load(max_radius_km=given.max_radius_km), with_paths=given.paths)
        tell("writing")
        meta = pipeline.finish(result, given.out, given.format, given.run_id, not given.skip_validation, given.history)
    except FileNotFoundError as missing:
        print(f"no such directory: {missing}", file=sys.stderr)
        return 3
    except KeyboardInterrupt:
        return 130
    say(meta)
    return 1 if given.strict and meta["violations"] else 0


if __name__ == "__main__":
    sys.exit(main())
