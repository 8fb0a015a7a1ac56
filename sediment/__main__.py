"""``python -m sediment COMMAND ARCHIVE``: verify, analyse, reset, or bundle to a file; the exit code tells whether all is well."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.archive import Archive
from .plans import jobs


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sediment", description=__doc__)
    ap.add_argument("command", choices=("verify", "analyse", "reset", "bundle"))
    ap.add_argument("archive")
    ap.add_argument("--to", help="the bundle's file")
    ap.add_argument("--json", action="store_true")
    args = ap.parse_args(argv)
    archive = Archive(SparkSession.builder.getOrCreate(), args.archive)
    if args.command == "reset":
        jobs.reset_analysis(archive)
        return 0
    if args.command == "analyse":
        found = jobs.run_analysis(archive)
        jobs.store_analysis(archive, found)
        print(f"{jobs.record_pending(archive, found.changes)} changes are new")
        return 0
    checks = jobs.verify(archive)
    rows = [r.asDict() for r in checks.collect()]
    if args.command == "verify":
        print(json.dumps(rows) if args.json else "\n".join(f"{'ok  ' if r['ok'] else 'FAIL'} {r['check']}: {r['failed']} of {r['checked']} failed" for r in rows))
        return int(not all(r["ok"] for r in rows))
    if not args.to:
        ap.error("bundle needs --to")
    document = jobs.bundle(archive.sources(), archive.table("snapshots"), archive.table("changes"), archive.table("blobs"))
    try:
        jobs.publish(checks, document, args.to)
    except ValueError as e:
        print(e)
        return 1
    print("\n".join(jobs.summary(document)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
