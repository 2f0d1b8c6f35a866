"""python -m tidewater PROGRAM [-M DIR]... [--explain | --dot | --print] [--demand] [--run SCRIPT]

Checks a program and prints its strata and rules, its graph, or its source as parsed;
or runs a batch script over it and prints every declared relation, one row a line.
Exit status 1 and a positioned message for a rejected program.
"""

from __future__ import annotations

import argparse
import sys

from tidewater.lang.ast import DatalogError, unparse
from tidewater.lang.parser import load
from tidewater.plans.program import Program


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("program")
    p.add_argument("-M", dest="search", action="append", default=[], metavar="DIR", help="where else to look for imports")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--dot", action="store_true")
    p.add_argument("--print", dest="source", action="store_true")
    p.add_argument("--demand", action="store_true", help="evaluate only what the one bound query asks for")
    p.add_argument("--run", metavar="SCRIPT", help="a batch script; see tidewater.sources.batches")
    a = p.parse_args(argv)
    try:
        program = Program(load(a.program, tuple(a.search)))
        if a.demand:
            from tidewater.plans.demand import demand

            program = demand(program).program
        if a.source:
            print(unparse(program.module), end="")
        if a.dot:
            print(program.to_dot())
        if a.explain or not (a.source or a.dot or a.run):
            print(program.explain())
        if a.run:
            _run(program, a.run)
    except (DatalogError, OSError) as e:
        print(f"{a.program}: error: {e}", file=sys.stderr)
        return 1
    return 0


def _run(program: Program, script: str) -> None:
    from pyspark.sql import SparkSession

    from tidewater.plans.database import Database
    from tidewater.sources.batches import run_batches

    spark = SparkSession.builder.appName("tidewater").getOrCreate()
    db = Database(program, spark).init()
    with open(script, encoding="utf-8") as f:
        run_batches(f.read(), db)
    for key, rel in sorted(program.relations.items()):
        if rel.kind in ("local", "query"):
            rows = db.relation(key)
            for row in rows.orderBy(*rows.columns).toLocalIterator():
                print(f"{key.rpartition('/')[0]}\t{' '.join(map(str, row))}")


if __name__ == "__main__":
    sys.exit(main())
