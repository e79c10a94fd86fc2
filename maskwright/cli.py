"""Command line: sanitize, restore and scan."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from .config import Switches, Settings
from .operators.restore import restore_files
from .plans.sanitize import sanitize, scan
from .sources.files import load_input, write_files
from .sources.maps import change_rows, map_document, read_map, write_map


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="maskwright")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("sanitize")
    one.add_argument("--input")
    one.add_argument("--text")
    one.add_argument("--output")
    one.add_argument("--map")
    one.add_argument("--dry-run", action="store_true")
    one.add_argument("--encrypt-map", action="store_true")
    one.add_argument("--password")
    one.add_argument("--mangle-sensitive-info", action=argparse.BooleanOptionalAction, default=True)
    one.add_argument("--mangle-code-identifiers", action=argparse.BooleanOptionalAction, default=True)
    two = sub.add_parser("restore")
    for name in ("--input", "--output", "--map"):
        two.add_argument(name, required=True)
    two.add_argument("--password")
    sub.add_parser("scan").add_argument("--input", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 1 where its arguments or its map are no good."""
    args = _parser().parse_args(argv)
    if args.command == "sanitize" and args.input is None and args.text is None:
        print("either --input or --text is needed", file=sys.stderr)
        return 1
    if args.command == "sanitize" and args.encrypt_map and not args.password:
        print("--encrypt-map needs --password", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("maskwright").getOrCreate()
    if args.command == "sanitize":
        options = Switches(sensitive_info=args.mangle_sensitive_info, code_identifiers=args.mangle_code_identifiers)
        done = sanitize(load_input(spark, args.input, args.text), Settings(options=options))
        count = done.changes.count()
        if args.text is not None or args.dry_run:
            for row in done.files.orderBy("file_ord").select("path", "sanitized").toLocalIterator():
                print(row["sanitized"] if args.text is not None else row["path"])
        print(f"{count} change(s)")
        if args.dry_run:
            return 0
        if args.output:
            write_files(done.files.select("path", F.col("sanitized").alias("content")), args.output)
        if args.map:
            write_map(map_document(done.files, change_rows(done.changes)), args.map, args.password if args.encrypt_map else None)
        return 0
    if args.command == "restore":
        try:
            changes = read_map(spark, args.map, args.password)
            changes.count()
        except Exception as bad:
            print(f"the map can't be read: {bad}".splitlines()[0], file=sys.stderr)
            return 1
        restored = restore_files(load_input(spark, args.input), changes)
        write_files(restored.select("path", F.col("restored").alias("content")), args.output)
        return 0
    rows = scan(load_input(spark, args.input)).orderBy("path", "category").collect()
    for row in rows:
        print(f"{row['path']}\t{row['language']}\t{row['category']}\t{row['count']}")
    print(f"{sum(r['count'] for r in rows)} finding(s)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
