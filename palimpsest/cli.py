"""The command line: rewrites a file or a folder under a policy and reports what was done.

Exit status: 0 done; 1 something could not be read or written; 2 wrong use or policy; 3 a gate that was asked for fired.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from palimpsest.operators import report, walk
from palimpsest.plans.policy import Policy, PolicyError
from palimpsest.runtime import session
from palimpsest.sources import objects as store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    yes_no = {"type": lambda s: s.lower() in ("1", "t", "true", "yes"), "nargs": "?", "const": True}
    p.add_argument("--terms", default="", help="policy, a JSON file (needed)")
    p.add_argument("--in", dest="source", default="", help="file or folder to read (needed)")
    p.add_argument("--out", default="", help="file or folder to write")
    p.add_argument("--in-place", default=False, **yes_no, help="write over the input")
    p.add_argument("--report", default="", help="file for the report")
    p.add_argument("--audit", default="full", choices=report.AUDITS)
    p.add_argument("--redact-report", default=False, **yes_no, help="digests in place of what was found")
    p.add_argument("--salt", default="palimpsest")
    p.add_argument("--dry-run", default=False, **yes_no, help="report only")
    p.add_argument("--max-depth", type=int, default=16)
    p.add_argument("--max-expand-bytes", type=int, default=2 << 30)
    p.add_argument("--max-ratio", type=int, default=0, help="without effect")
    p.add_argument("--scrub-names", default=True, **yes_no)
    p.add_argument("--verbose", default=False, **yes_no, help="counts by rule")
    p.add_argument("--fail-on-unscrubbed", default=False, **yes_no)
    p.add_argument("--fail-on-risky", default=False, **yes_no)
    p.add_argument("--verify-output", default=False, **yes_no)
    p.add_argument("--master", default=None, help="Spark master")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    say = lambda *x: print(*x, file=sys.stderr)
    if args.max_ratio:
        say("warning: --max-ratio is ignored; --max-expand-bytes bounds what is unpacked")
    if not args.terms or not args.source:
        say("error: --terms and --in are needed")
        return 2
    if not (args.dry_run or args.in_place or args.out):
        say("error: one of --out, --in-place and --dry-run is needed")
        return 2
    try:
        policy = Policy.load(args.terms)
    except (PolicyError, OSError) as e:
        say(f"policy error: {e}")
        return 2
    if not os.path.exists(args.source):
        say(f"error: {args.source} does not exist")
        return 1
    try:
        return run(args, policy, say)
    except Exception as e:  # of Spark or of the file system
        say(f"fatal: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        return 1


def run(args: argparse.Namespace, policy: Policy, say) -> int:
    spark = session(master=args.master)
    limits = walk.Limits(depth=args.max_depth, total_bytes=args.max_expand_bytes, verify=args.verify_output, names=args.scrub_names)
    single = os.path.isfile(args.source)
    rows, _ = store.objects(spark, os.path.abspath(args.source))
    done = walk.walked(store.contents(rows), {"policy": policy}, "policy", limits).persist()
    # the files of one run make one report, in order of the objects and within them
    files = walk.files(done).withColumn("_object", F.col("object_key"))
    files = files.withColumn("seq", F.struct(F.col("_object").alias("object"), "seq")).withColumn("object_key", F.lit(os.path.abspath(args.source))).persist()
    found_in = walk.samples(done).select(F.lit(os.path.abspath(args.source)).alias("object_key"), F.struct(F.col("object_key").alias("object"), "seq").alias("seq"), "sample")
    summaries = report.with_samples(report.summary(files), found_in).persist()
    found = summaries.select("verdict", "files_not_inspected").first()
    if not args.dry_run:
        folder = os.path.abspath(args.source if args.in_place else args.out)
        named = done.withColumn("output_key", F.lit(os.path.basename(folder)) if single else F.col("object_key"))
        origin = os.path.dirname(os.path.abspath(args.source)) if single else os.path.abspath(args.source)
        named = named.withColumn("_origin", F.concat(F.lit(origin + "/"), "object_key"))
        store.write_objects(named.where("error is null"), os.path.dirname(folder) if single else folder, like="_origin").count()
    if args.report:
        line = report.report_json(files, summaries, args.audit, args.salt if args.redact_report else None).first()
        with open(args.report, "w", encoding="utf-8", opener=lambda path, flags: os.open(path, flags, 0o600)) as f:
            json.dump(json.loads(line["report"]) if line else {}, f, indent=2, ensure_ascii=False)
    for r in report.banner(summaries).collect():
        say(r["banner"])
    if args.verbose:
        counts = files.select(F.explode("matches").alias("m")).groupBy("m.rule").agg(F.count("*").alias("n"))
        for r in report.breakdown(counts).orderBy("place").collect():
            say(r["line"])
    lost = [f"{r['object_key']}: {r['error']}" for r in done.where("error is not null").select("object_key", "error").limit(report.NOTES).collect()]
    for line in lost:
        say(f"error: {line}")
    done.unpersist()
    if lost:
        return 1
    if found and args.fail_on_unscrubbed and found["files_not_inspected"] > 0:
        return 3
    return 3 if found and args.fail_on_risky and found["verdict"] == "incomplete-risky" else 0


if __name__ == "__main__":
    sys.exit(main())
