"""Command line: python -m lorelog [path] [flags].  Ends with 0, 2 for a refusal of the request, 1 for a fault."""

from __future__ import annotations

import argparse
import json
import sys

from lorelog import report
from lorelog.model import Config, UserError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorelog", description="Analyses the history of a local clone and writes a report.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--output", default="report.json")
    p.add_argument("--html", help="also write a page with the report inlined")
    p.add_argument("--config", help="JSON file with analysis keys; lists add to the defaults, an empty list clears them")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--year", type=int, default=0)
    p.add_argument("--anonymize", action="store_true")
    p.add_argument("--allow-shallow", action="store_true")
    p.add_argument("--count-merges", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--json", action="store_true", help="write the report to standard output")
    return p


def configure(args: argparse.Namespace) -> tuple[Config, list[str]]:
    given: dict = {}
    if args.config:
        try:
            with open(args.config, encoding="utf-8") as f:
                given = json.load(f)
        except (OSError, ValueError) as e:
            raise UserError("invalid_configuration", str(e)) from e
        if not isinstance(given, dict):
            raise UserError("invalid_configuration", "the file holds no object")
    for key in ("since", "until", "year", "anonymize", "count_merges"):
        if value := getattr(args, key):
            given[key] = value
    return Config().merged(given)


def analyse(spark, args: argparse.Namespace) -> dict:
    from pyspark.sql import functions as F

    from lorelog.functions.paths import has_nul
    from lorelog.operators import annotate, replay, steps
    from lorelog.sources import gitlog
    from lorelog.storage import stored

    config, warnings = configure(args)
    if not args.quiet:
        for w in warnings:
            print(w, file=sys.stderr)
    info = gitlog.preflight(args.path, args.allow_shallow)
    bounds = {k: v for k, v in (("since", config.since), ("until", config.until)) if v}
    log = gitlog.read_history(spark, info["path"], **bounds)
    commits = log.filter("diff_no = 0")
    tree = gitlog.tree_at(spark, info["path"])
    marks = ""
    if not tree.filter("path = '.gitattributes'").isEmpty():
        marks = gitlog.git(info["path"], "show", f"{info['head_commit']}:.gitattributes").decode("utf-8", "replace")
    annotated = annotate.annotate(commits, config, attributes=marks)
    if config.year:
        n = annotate.analysed(annotated, config.year).count()
        if n < report.MIN_YEAR_COMMITS:
            raise UserError("year_below_threshold", f"{config.year} has {n} analysed commits, {report.MIN_YEAR_COMMITS} are needed")
        annotated = annotated.withColumn("excluded", F.col("excluded") | (F.col("year") != config.year))
    oids = tree.filter("type = 'blob'").select(F.col("blob").alias("oid")).unionByName(steps.touched_blobs(log))
    contents = stored(gitlog.blobs(oids, info["path"]), "contents")
    head = tree.join(contents, F.col("blob") == F.col("oid"), "left").withColumn("text", F.col("content").isNotNull() & ~has_nul(F.col("content")))
    text_lines = head.filter("text and not oversized").select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line_no", "text"))
    changed, graph = steps.steps(log, annotated, contents, info["head_commit"])
    replayed = stored(replay.replay(changed, graph, info["head_commit"]), "replayed")
    built = report.build(annotated, annotate.file_changes(annotated, config, marks), head.select("path", "text"), config, info, info["is_shallow"], replayed, text_lines, marks)
    # a bounded log begins in the middle, so its replay can't end with the whole tree
    built["metadata"]["tree_differences"] = [r.asDict() for r in steps.check_tree(replayed, tree).orderBy("path").limit(report.LISTED_DIFFERENCES).collect()] if not bounds else []
    return built


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from lorelog.sources import history

    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("lorelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        built = analyse(spark, args)
        if args.json:
            json.dump(built, sys.stdout, indent=2, default=str)
        else:
            history.write_json(built, args.output)
        if args.html:
            history.write_html(built, args.html)
    except UserError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
