"""Command line: ``python -m tessera extract | diff | generate | partition``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tessera.operators import diff as D
from tessera.operators.partitions import partition_ddl
from tessera.plans import migrate
from tessera.session import session
from tessera.sources import server
from tessera.sources.catalog import Catalog, extract_tables, read_directory, read_json
from tessera.sources.ddl import parse_all
from tessera.sources.scans import read_information_schema

#: More hash partitions than this are hardly of use.
MANY_PARTITIONS = 1024


def _desired(spark: SparkSession, folder: str) -> Catalog:
    catalog, errors = parse_all(read_directory(spark, folder))
    for w in catalog.sorted_rows("warnings"):
        print(f"warning: line {w['line']}: {w['message']}", file=sys.stderr)
    if errors:
        raise SystemExit("\n".join(errors))
    return catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="the catalog of Parquet tables, or of a server, as JSON")
    extract.add_argument("--jdbc", metavar="URL", help="a server to extract instead; credentials may be part of the address")
    extract.add_argument("--exclude", action="append", default=[], metavar="SCHEMA", help="a schema of the server to leave out")
    extract.add_argument("tables", nargs="*", help="NAME=PATH of each table, or paths whose last part names the table")
    extract.add_argument("--output", help="a file; standard output without it")
    for name, text in (("diff", "what differs between a stored catalog and a folder of SQL text"), ("generate", "migration files that lead from one to the other")):
        c = commands.add_parser(name, help=text)
        c.add_argument("--current", required=True, help="catalog as JSON")
        c.add_argument("--desired", required=True, help="folder of .sql files")
        if name == "diff":
            c.add_argument("--ignore-comments", action="store_true")
            c.add_argument("--ignore-constraint-names", action="store_true")
        else:
            c.add_argument("--output", required=True, help="folder of migrations; versions follow on those there")
            c.add_argument("--transactions", choices=("auto", "always", "never"), default="auto")
            c.add_argument("--max-changes", type=int, default=migrate.MAX_CHANGES)
            c.add_argument("--preview", action="store_true", help="print the files, write none")
    part = commands.add_parser("partition", help="statements of all hash partitions of a table")
    part.add_argument("table")
    part.add_argument("--schema", default="public")
    part.add_argument("--modulus", type=int, required=True)
    args = parser.parse_args(argv)
    if args.command == "extract" and bool(args.jdbc) == bool(args.tables):
        parser.error("extract takes tables or --jdbc")
    spark = session()
    if args.command == "extract":
        pairs = (t.split("=", 1) if "=" in t else (os.path.basename(t.rstrip("/")).removesuffix(".parquet"), t) for t in args.tables)
        if args.jdbc:
            found = server.extract(read_information_schema(spark, args.jdbc), server.read_server(spark, args.jdbc), args.exclude)
        else:
            found = extract_tables({n: spark.read.parquet(p) for n, p in pairs})
        text = found.to_json()
        if args.output:
            with open(args.output, "w") as out:
                out.write(text + "\n")
        else:
            print(text)
    elif args.command == "diff":
        changes = D.diff(spark, read_json(spark, args.current), _desired(spark, args.desired), args.ignore_comments, args.ignore_constraint_names)
        print(migrate.report(changes))
        return int(changes.filter(changes.severity == D.BREAKING).count() > 0)
    elif args.command == "generate":
        there = os.listdir(args.output) if os.path.isdir(args.output) else []
        options = migrate.Options(start_version=migrate.next_version(there), transactions=args.transactions, max_changes=args.max_changes)
        files, warnings = migrate.generate(spark, read_json(spark, args.current), _desired(spark, args.desired), options)
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
        if args.preview:
            print("\n".join(f"==> {f.name}\n{f.content}" for f in files))
        else:
            migrate.write_files(files, args.output)
            print("\n".join(f.name for f in files))
    else:
        if args.modulus > MANY_PARTITIONS:
            print(f"warning: {args.modulus} partitions are very many", file=sys.stderr)
        print("\n".join(r.sql for r in partition_ddl(spark, args.table, args.modulus, args.schema).orderBy("remainder").collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
