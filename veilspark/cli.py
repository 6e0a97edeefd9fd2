"""Command line: mask files into a folder. Prints counts, never values.

Exit codes: 0 all files were masked, 1 some were not, 2 the arguments make no sense.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.operators.policy import PROFILES, policy
from veilspark.operators.verify import MaskingError
from veilspark.sources.files import suffix_of
from veilspark.sources.publish import mask_files
from veilspark.sources.scratch import release


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Mask personal data in text, CSV, Word and Excel files.")
    p.add_argument("src", nargs="+", help="files, on any file system that Spark reads")
    p.add_argument("-o", "--out", required=True, help="folder for the masked files, which all nodes share")
    p.add_argument("--profile", default="general", choices=sorted(PROFILES))
    p.add_argument("--entities", nargs="+", metavar="ENTITY", help="what to mask, in place of the profile's list")
    p.add_argument("--allow", nargs="+", metavar="PHRASE", default=[], help="phrases that are never masked")
    p.add_argument("--propagate", choices=("job", "seen"), help="also mask every occurrence of values that any file (job), or this or an earlier one (seen), proves")
    p.add_argument("--report", help="write the reports here, as a JSON list")
    p.add_argument("--report-values", action="store_true", help="with the original values: such a report is as sensitive as the files")
    p.add_argument("--keep-filename", action="store_true", help="leave file names as they are")
    p.add_argument("--long-tags", action="store_true", help="entities by their full names in tags")
    who = p.add_mutually_exclusive_group()
    who.add_argument("--mask-providers", dest="providers", action="store_true", default=None)
    who.add_argument("--preserve-professional-identities", dest="providers", action="store_false")
    p.add_argument("--mask-organizations", action="store_true")
    p.add_argument("--min-masked-age", type=int)
    p.add_argument("--no-verify", action="store_true", help="publish without reading the masked files back")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        for name in args.src:
            suffix_of(name)
    except MaskingError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    if args.report and PurePosixPath(args.report).parent == PurePosixPath(args.out):
        print("error: --report must not be among the masked files", file=sys.stderr)
        return 2
    chosen = policy(args.profile, entities=tuple(args.entities) if args.entities else None, mask_organizations=args.mask_organizations, min_masked_age=args.min_masked_age, mask_providers=args.providers, allowlist=tuple(args.allow), short_names=not args.long_tags)
    spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
    reports = mask_files(spark, args.src, None, args.out, chosen, not args.no_verify, args.report_values, args.propagate, args.keep_filename, each=True)
    told = reports.select(F.get_json_object("report", "$.verified").alias("ok"), F.size(F.from_json(F.get_json_object("report", "$.findings"), "array<string>")).alias("n"), "report").collect()  # a row a file named on the command line
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            json.dump([json.loads(r["report"]) for r in told], f, indent=1)
    failed = 0 if args.no_verify else sum(r["ok"] != "true" for r in told)
    print(f"{len(told) - failed} of {len(told)} files masked, {sum(r['n'] for r in told)} values")
    release(spark)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
