"""Command line: run a report over landed tables, land tables, ingest receipts.

    python -m ledgerscope assignment-summary --tables ROOT --code SAL-0003 \\
        --start 2024-01-01 --end 2024-12-31 [--credit-start .. --credit-end ..] \\
        [--sort totalOutflow:A --sort email:D] (--out PATH [--format parquet|csv|json] | --preview N)
    python -m ledgerscope sales-person-summary --tables ROOT --start .. --end .. [...]
    python -m ledgerscope land --tables ROOT --out ROOT [--buckets N] [--rollups]
    python -m ledgerscope land-batch --fact transactions --batch PATH --out ROOT [--kind replace|add]
    python -m ledgerscope land-fixture --sf-dir /root/testdata/sf0.1 --out ROOT
    python -m ledgerscope ingest-receipts --source DIR --target DIR --checkpoint DIR

The session comes from ``SparkSession.builder.getOrCreate()`` (spark-submit
or the platform supplies master and resources).  On the assignment summary
``--end`` defaults to ``--as-of`` (today) and ``--start`` to the day of the
first transaction; the sales-person summary and ``--historic`` need both.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.config import size_for, tune
from ledgerscope.functions.dates import OMITTED, DateWindow, default_window, parse_date
from ledgerscope.plans.assignment import assignment_summary
from ledgerscope.plans.salesperson import sales_person_summary
from ledgerscope.sources.fixture import fixture_tables
from ledgerscope.sources.landing import KINDS, land_batch
from ledgerscope.sources.rollups import write_rollups
from ledgerscope.sources.tables import PARTITION_COLUMNS, Tables, read_parquet_tables, write_tables
from ledgerscope.streaming.receipts import ingest_receipts


def _sort(specs: list[str] | None) -> tuple[list[str] | None, list[str] | None]:
    if not specs:
        return None, None
    fields, dirs = [], []
    for spec in specs:
        name, _, direction = spec.partition(":")
        fields.append(name)
        dirs.append(direction or None)
    return fields, dirs


def _emit(df: DataFrame, args: argparse.Namespace) -> None:
    """Write the whole report, or print a preview of the rows asked for; the report runs once."""
    if not args.out:
        print(f"preview: at most {args.preview} rows")
        df.show(args.preview, truncate=False)
        return
    df.write.mode(args.mode).format(args.format).option("header", True).save(args.out)
    if args.preview:
        written = df.sparkSession.read.format(args.format).option("header", True).load(args.out)
        print(f"preview of {args.out}: at most {args.preview} rows")
        written.show(args.preview, truncate=False)


def _report_args(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tables", required=True, help="directory holding the seven landed tables")
    p.add_argument("--start", default=None)
    p.add_argument("--end", default=None)
    p.add_argument("--credit-start", default=None, help="credit window start (default: --start)")
    p.add_argument("--credit-end", default=None, help="credit window end (default: --end)")
    p.add_argument("--sort", action="append", help="FIELD[:A|D], repeatable; only A ascends")
    p.add_argument("--out", default=None)
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--mode", default="errorifexists")
    p.add_argument("--preview", type=int, default=0, help="print this many rows")
    p.add_argument(
        "--size-shuffles",
        action="store_true",
        help="size shuffle and scan partitions from the facts' stored bytes and the cluster's cores",
    )


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ledgerscope")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("assignment-summary")
    _report_args(a)
    a.add_argument("--code", required=True)
    a.add_argument("--as-of", default=None, help="today for the default window")
    a.add_argument("--historic", action="store_true", help="match balances by e-mail only")
    s = sub.add_parser("sales-person-summary")
    _report_args(s)
    c = sub.add_parser("land", help="copy tables into the landed layout")
    c.add_argument("--tables", required=True)
    c.add_argument("--out", required=True)
    f = sub.add_parser("land-fixture")
    f.add_argument("--sf-dir", required=True)
    f.add_argument("--out", required=True)
    for p in (c, f):
        p.add_argument("--buckets", type=int, default=0, help="key buckets of facts, balances, customers and businesses")
        p.add_argument("--rollups", action="store_true", help="also land monthly sums of the facts")
    b = sub.add_parser("land-batch", help="land new months or late rows of a fact")
    b.add_argument("--fact", required=True, choices=sorted(PARTITION_COLUMNS))
    b.add_argument("--batch", required=True, help="Parquet path of the batch")
    b.add_argument("--out", required=True, help="directory of the landed tables")
    b.add_argument("--kind", default="replace", choices=KINDS, help="the batch holds its months whole, or rows to add")
    b.add_argument("--buckets", type=int, default=None, help="key buckets, for the first batch of a fact")
    c.add_argument("--size-shuffles", action="store_true")
    r = sub.add_parser("ingest-receipts")
    r.add_argument("--source", required=True)
    r.add_argument("--target", required=True)
    r.add_argument("--checkpoint", required=True)
    r.add_argument("--multi-line", action="store_true", help="pretty-printed objects; each file is one task")
    r.add_argument("--max-files", type=int, default=None, help="most files in one batch")
    return parser


def _check(parser: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    if not args.out and args.preview <= 0:
        parser.error("give --out PATH for the report, or --preview N for some of its rows")
    if (args.command == "sales-person-summary" or getattr(args, "historic", False)) and not (args.start and args.end):
        parser.error("--start and --end are required here")


def _size(spark: SparkSession, root: str) -> None:
    facts = [os.path.join(root, t) for t in PARTITION_COLUMNS]
    size_for(spark, facts, spark.sparkContext.defaultParallelism)


def _land(spark: SparkSession, tables: Tables, args: argparse.Namespace) -> int:
    write_tables(tables, args.out, buckets=args.buckets)
    if args.rollups:
        write_rollups(read_parquet_tables(spark, args.out), args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command.endswith("summary"):
        _check(parser, args)

    spark = tune(SparkSession.builder.getOrCreate())
    if args.command == "land-fixture":
        return _land(spark, fixture_tables(spark, args.sf_dir), args)
    if args.command == "land-batch":
        months = land_batch(spark, spark.read.parquet(args.batch), args.fact, args.out, args.kind, args.buckets)
        print(f"landed {args.fact} of {', '.join(map(str, months)) or 'no month'}")
        return 0
    if args.command == "ingest-receipts":
        ingest_receipts(
            spark, args.source, args.target, args.checkpoint, multi_line=args.multi_line, max_files=args.max_files
        ).awaitTermination()
        return 0

    if args.size_shuffles:
        _size(spark, args.tables)
    tables = read_parquet_tables(spark, args.tables)
    if args.command == "land":
        return _land(spark, tables, args)
    fields, dirs = _sort(args.sort)
    if args.command == "assignment-summary":
        # Each bound has its own default, whatever the other options are.
        window = default_window(tables.transactions, args.start, args.end or OMITTED, args.as_of)
        match = "email" if args.historic else "holder"
    else:
        window = DateWindow.of(args.start, args.end)
    credit = DateWindow(parse_date(args.credit_start) or window.start, parse_date(args.credit_end) or window.end)
    if args.command == "assignment-summary":
        df = assignment_summary(tables, args.code, window, credit, fields, dirs, balance_match=match)
    else:
        df = sales_person_summary(tables, window, credit, fields, dirs)
    _emit(df, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
