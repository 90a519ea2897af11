"""``python -m millrace list | info NAME SF_DIR [--json] | run NAME SF_DIR [--out PATH] [--limit SECONDS]``."""

from __future__ import annotations

import argparse
import threading

from pyspark.sql import DataFrame

from millrace.plans import all_queries
from millrace.session import session


def plan_json(df: DataFrame) -> str:
    """The physical plan as JSON: a list of nodes, each with its number of children."""
    return df._jdf.queryExecution().executedPlan().toJSON()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    for name, help_ in (("info", "the physical plan"), ("run", "run and show or write the result")):
        p = commands.add_parser(name, help=help_)
        p.add_argument("query")
        p.add_argument("sf_dir")
        if name == "run":
            p.add_argument("--out", help="folder for Parquet output")
            p.add_argument("--limit", type=float, help="cancel after so many seconds")
        else:
            p.add_argument("--json", action="store_true", help="the physical plan as JSON")
    args = parser.parse_args(argv)
    found, _ = all_queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return
    if args.query not in found:
        parser.error(f"no query {args.query}; see list")
    spark = session()
    if args.command == "run" and args.limit:
        spark.sparkContext.setJobGroup(args.query, args.query, interruptOnCancel=True)
        timer = threading.Timer(args.limit, spark.sparkContext.cancelJobGroup, [args.query])
        timer.daemon = True
        timer.start()
    df = found[args.query](spark, args.sf_dir)
    if args.command == "info":
        if args.json:
            print(plan_json(df))
        else:
            df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
