"""Command line of the jobs: python -m rillstone.control.launch silver|gold|backfill --input PATH --output PATH ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rillstone.control.observe import with_retries
from rillstone.plans import jobs
from rillstone.sources import lake


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rillstone", description="Runs a job of the event layers.")
    kinds = top.add_subparsers(dest="job", required=True)
    for name, about in (("silver", "bronze to silver, invalid rows to dead letters"), ("gold", "silver to feature tables"), ("backfill", "user features as of each day")):
        p = kinds.add_parser(name, help=about)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--start", help="first date, YYYY-MM-DD")
        p.add_argument("--end", help="last date")
        p.add_argument("--attempts", type=int, default=1)
        if name == "silver":
            p.add_argument("--dead-letters", required=True)
            p.add_argument("--last-date", help="only what came after this partition")
            p.add_argument("--last-hour", type=int)
            p.add_argument("--salt", default="")
        if name == "gold":
            p.add_argument("--kinds", default=",".join(jobs.FEATURES), help="of " + ", ".join(jobs.FEATURES))
            p.add_argument("--date", help="the feature tables' date")
    return top


def launch(args: list[str], spark: SparkSession) -> object:
    """Runs what the arguments say, and gives what the job gives."""
    a = parser().parse_args(args)

    def run() -> object:
        if a.job == "silver":
            plan = jobs.SilverPlan(salt=a.salt)
            if a.last_date:
                return jobs.run_incremental(spark, plan, a.input, a.output, a.dead_letters, a.last_date, a.last_hour)
            return plan.run(lake.read_bronze(spark, a.input, start=a.start, end=a.end), a.output, a.dead_letters)
        silver = lake.read_silver(spark, a.input, start=a.start, end=a.end)
        if a.job == "gold":
            if bad := set(a.kinds.split(",")) - set(jobs.FEATURES):
                raise ValueError(f"no such features: {sorted(bad)}")
            return jobs.run_gold(silver, a.output, a.date, None if a.end is None else F.lit(a.end + " 23:59:59").cast("timestamp"), kinds=tuple(a.kinds.split(",")))
        if a.end is None:
            raise ValueError("a backfill needs --end")
        return jobs.backfill_incremental(lake.read_silver(spark, a.input), a.output, a.end, a.start)

    return with_retries(run, a.attempts - 1)


def main() -> None:
    import sys

    from rillstone.session import session

    launch(sys.argv[1:], session("rillstone"))


if __name__ == "__main__":
    main()
