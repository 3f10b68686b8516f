"""Command line: ``build`` an index from a manifest, ``query`` it."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from arborlake.config import MemoryBudget
from arborlake.functions.human import format_bytes, format_count, format_duration
from arborlake.operators.pricing import PriceTable, format_cost, monthly_cost
from arborlake.plans.build import build_index
from arborlake.sources.store import Index

log = logging.getLogger("arborlake")


class UsageError(Exception):
    """A command line that can't be run."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UsageError(message)


def _parser() -> argparse.ArgumentParser:
    top = _Parser(prog="arborlake", description=__doc__)
    commands = top.add_subparsers(dest="command", parser_class=_Parser)
    build = commands.add_parser("build")
    build.add_argument("--out", default="", help="directory of the index")
    build.add_argument("--s3-manifest", "--manifest", dest="manifest", default="", help="address of the inventory's manifest.json")
    build.add_argument("--root", default=None, help="where the inventory files lie, if not in the manifest's bucket")
    build.add_argument("--workers", type=int, default=0, help="cores (default: all)")
    build.add_argument("--max-depth", type=int, default=0, help="deepest prefix that is kept (0: no limit)")
    build.add_argument("--mem-budget", default="", help="memory, such as 4GiB (default: half)")
    query = commands.add_parser("query")
    query.add_argument("--index", default="", help="directory of the index")
    query.add_argument("--prefix", default="", help="prefix to look up")
    query.add_argument("--show-tiers", action="store_true")
    query.add_argument("--estimate-cost", action="store_true")
    query.add_argument("--price-table", default="", help="prices as JSON")
    for p in (build, query):
        p.add_argument("--verbose", action="store_true")
        p.add_argument("--pretty-logs", action="store_true")
    return top


def run(args: list[str], spark: SparkSession | None = None) -> None:
    """Runs a command; UsageError or the error of the work if it can't be done."""
    if not args:
        raise UsageError("commands: build, query")
    if args[0] not in ("build", "query"):
        raise UsageError(f"unknown command: {args[0]}")
    opts = _parser().parse_args(args)
    plain = "%(message)s" if opts.pretty_logs else "%(asctime)s %(levelname)s %(name)s %(message)s"
    logging.basicConfig(level=logging.DEBUG if opts.verbose else logging.INFO, format=plain, stream=sys.stderr)
    if opts.command == "build":
        for value, name in ((opts.out, "--out"), (opts.manifest, "--s3-manifest")):
            if not value:
                raise UsageError(f"{name} is required")
        budget = MemoryBudget.determine(opts.mem_budget)
        log.info("memory budget %s (%s)", format_bytes(budget.total), budget.source)
        spark = spark or SparkSession.builder.config(map=budget.spark_conf(opts.workers)).getOrCreate()
        done = build_index(spark, opts.manifest, opts.out, root=opts.root, max_depth=opts.max_depth)
        log.info("%s objects of %d files, %s prefixes, depth %d, in %s", format_count(done.objects), done.files, format_count(done.prefixes), done.max_depth, format_duration(int(done.seconds * 1e9)))
        return
    for value, name in ((opts.index, "--index"), (opts.prefix, "--prefix")):
        if not value:
            raise UsageError(f"{name} is required")
    spark = spark or SparkSession.builder.config(map=MemoryBudget.determine().spark_conf()).getOrCreate()
    index = Index.open(spark, opts.index)
    stats = index.stats(opts.prefix)
    if stats is None:
        raise LookupError(f"prefix not found: {opts.prefix}")
    print(f"Prefix: {opts.prefix}\nObjects: {stats[0]}\nBytes: {stats[1]}")
    if opts.show_tiers or opts.estimate_cost:
        _print_tiers(index, opts)


def _print_tiers(index: Index, opts: argparse.Namespace) -> None:
    if not index.has_tiers:
        print("\nNo tier data available (index was built without tier tracking)")
        return
    tiers = index.breakdown(opts.prefix)
    if not tiers:
        print("\nNo tier data at this prefix")
        return
    if opts.show_tiers:
        print("\nTier breakdown:")
        for name, count, size in tiers:
            print(f"  {name}: {count} objects, {size} bytes")
    if opts.estimate_cost:
        cost = monthly_cost(tiers, PriceTable.load(opts.price_table) if opts.price_table else None)
        print(f"\nEstimated monthly cost:\n  Total: {format_cost(cost.total)}/month")
        if opts.show_tiers:
            for name in sorted(cost.per_tier):
                print(f"  {name}: {format_cost(cost.per_tier[name])}/month")


def main() -> int:
    try:
        run(sys.argv[1:])
    except Exception as e:  # noqa: BLE001  a command line reports and ends
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
