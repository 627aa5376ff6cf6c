"""python -m ranklake COMMAND PATH: look at, verify and clean up stores and bundles. Output is a line of JSON for each row."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from ranklake.stores import bundle, generations

TABLES = {"inspect": generations.inspect, "stats": bundle.stats, "audit": generations.audit}


def show(rows: DataFrame) -> int:
    n = 0
    for line in rows.toJSON().toLocalIterator():
        print(json.dumps(json.loads(line), ensure_ascii=False))
        n += 1
    return n


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 1 if verification finds a problem, 2 if the command fails."""
    p = argparse.ArgumentParser("ranklake", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in (*TABLES, "verify", "gc", "export", "import"):
        c = commands.add_parser(name)
        c.add_argument("path")
        if name in ("export", "import"):
            c.add_argument("target")
        if name == "gc":
            c.add_argument("--retain", type=int, default=1)
            c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("ranklake").getOrCreate()
    try:
        if a.command == "verify":
            return int(show(generations.verify(spark, a.path)) > 0)
        if a.command == "gc":
            print(json.dumps(generations.gc(spark, a.path, a.retain, a.dry_run)))
        elif a.command == "export":
            generations.export_json(spark, a.path, a.target)
        elif a.command == "import":
            generations.import_json(spark, a.path, a.target)
        else:
            show(TABLES[a.command](spark, a.path))
    except (ValueError, OSError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
