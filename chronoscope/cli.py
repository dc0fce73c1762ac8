"""``python -m chronoscope.cli ARCHIVE [--export-csv DIR | --export-json DIR | --export-bodyfile DIR] [--sigma-rules DIR --events TABLE]``"""

from __future__ import annotations

import argparse
import os
import re
import sys


def archive_host(path: str) -> str:
    """The host that a collection's file name says, or ``unknown``."""
    found = re.match(r"Collection-(.+?)-202", os.path.basename(os.path.normpath(path)))
    return found[1] if found else "unknown"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronoscope", description="Builds a collection's timeline; the first export asked for (CSV, JSON, bodyfile) is written.")
    parser.add_argument("archive", help="a ZIP archive or an unpacked folder that all tasks can read")
    parser.add_argument("--export-csv", metavar="DIR")
    parser.add_argument("--export-json", metavar="DIR")
    parser.add_argument("--export-bodyfile", metavar="DIR")
    parser.add_argument("--sigma-rules", metavar="DIR", help="rules to run over --events")
    parser.add_argument("--events", metavar="PARQUET", help="decoded event records: event_id, channel, provider, computer, event_data, time")
    parser.add_argument("--show", metavar="N", type=int, default=100, help="detections to list; all are counted")
    parser.add_argument("--as-of", metavar="TIME", help="the time of rows that have none")
    args = parser.parse_args(argv)
    if args.sigma_rules and not args.events:
        parser.error("--sigma-rules needs --events: event records are decoded elsewhere")

    from pyspark.sql import SparkSession

    from chronoscope.operators import sigma, timeline
    from chronoscope.plans import normalize
    from chronoscope.plans.collection_timeline import Collection
    from chronoscope.sources import sinks

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = Collection(spark, args.archive, args.as_of)
    print(f"host: {archive_host(args.archive)}", file=sys.stderr)
    for row in found.counts().orderBy("artifact_class").collect():
        print(f"{row.artifact_class or 'other'}: {row.n}", file=sys.stderr)
    more = []
    if args.events:
        events = spark.read.parquet(args.events)
        more.append(normalize.event_log(events))
        if args.sigma_rules:
            rules, bad = sigma.load_rules(args.sigma_rules)
            print(f"{len(rules)} rules, {bad} files that aren't", file=sys.stderr)
            for title, field, pattern in sigma.refused_patterns(rules):
                print(f"never matches: {title}, {field}: {pattern}", file=sys.stderr)
            hits = sigma.detect(events, rules)
            for row in sigma.count_by_level(hits).orderBy("rule_level").collect():
                print(f"{row.rule_level}: {row.n} detections", file=sys.stderr)
            for row in hits.orderBy("time", "event_id", "rule_ord").limit(args.show).collect():
                print(f"[{row.rule_level}] {row.rule_title}: EventID {row.event_id} at {row.time} ({row.channel})", file=sys.stderr)
    rows = found.timeline(*more)
    if args.export_csv:
        sinks.write_csv(rows, args.export_csv)
    elif args.export_json:
        sinks.write_json(rows, args.export_json)
    elif args.export_bodyfile:
        sinks.write_bodyfile(rows, args.export_bodyfile)
    else:
        timeline.ordered(rows).select("primary_ts", "event_code", "path").show(50, truncate=120)
    found.remove()
    return 0


if __name__ == "__main__":
    sys.exit(main())
