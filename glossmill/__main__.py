"""python -m glossmill: metrics of training logs as CSV on the standard output."""

from __future__ import annotations

import argparse
import csv
import sys


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="glossmill")
    where = p.add_argument_group("one source")
    for name in ("state-file", "state-pattern", "log-file", "log-pattern"):
        where.add_argument(f"--{name}")
    p.add_argument("--skip-lines", type=int, default=0)
    p.add_argument("--x", default="step")
    p.add_argument("--list", action="store_true", help="metrics and how often they were logged")
    p.add_argument("metrics", nargs="*", help="names or patterns")
    a = p.parse_args(argv)
    if not (a.state_file or a.state_pattern or a.log_file or a.log_pattern):
        p.error("a source is needed")
    if not (a.list or a.metrics):
        p.error("name a metric, or use --list")
    from pyspark.sql import SparkSession

    from .operators import runlog
    from .sources import files

    spark = SparkSession.builder.getOrCreate()
    log = files.load_runs(spark, a.state_file, a.state_pattern, a.log_file, a.log_pattern, a.skip_lines)
    if a.list:
        out = runlog.metric_counts(log).orderBy("metric")
    else:
        out = runlog.melt(log, runlog.expand(a.metrics, [c for c in log.columns if c not in runlog.AXES]), runlog.axis(log, a.x))
    to = csv.writer(sys.stdout)
    to.writerow(out.columns)
    to.writerows(out.toLocalIterator())


if __name__ == "__main__":
    main()
