"""python -m depdelver: dependencies of a delimited file or a Parquet table.

A cluster is spark-submit's business: ``spark-submit --master ... depdelver/__main__.py``.
"""

from __future__ import annotations

import argparse
import logging

from depdelver.config import STRATEGIES, FDConfig
from depdelver.operators.partitions import attribute_order
from depdelver.plans.discover import Metrics, discover_fds
from depdelver.session import command_session
from depdelver.sources.csv import CsvDescriptor, write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="depdelver", description=__doc__)
    p.add_argument("--input-name", required=True, help="file name without ending, and name of the relation")
    p.add_argument("--input-path", default=".")
    p.add_argument("--input-ending", default="csv", help="csv and the like, or parquet")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--charset", default="UTF-8")
    p.add_argument("--separator", default=",")
    p.add_argument("--quote", default='"')
    p.add_argument("--escape", default="\\")
    p.add_argument("--null-string", default="")
    p.add_argument("--strict-quotes", action="store_true")
    p.add_argument("--keep-leading-whitespace", action="store_true")
    p.add_argument("--skip-lines", type=int, default=0)
    p.add_argument("--fail-on-differing-lines", action="store_true")
    p.add_argument("--max-lhs-size", type=int, default=-1)
    p.add_argument("--row-limit", type=int, default=-1)
    p.add_argument("--null-unequals-null", action="store_true")
    p.add_argument("--max-candidates", type=int, help="lower the largest left-hand side when more are stored")
    p.add_argument("--pli-cache-prefix", type=int, default=FDConfig.pli_cache_prefix, help="attributes of the prefixes whose partitions are kept")
    p.add_argument("--strategy", choices=STRATEGIES, default="auto")
    p.add_argument("--workers", default="*", help="local threads, where no master is set")
    p.add_argument("--max-bytes", type=int, help="memory of candidates beyond which the largest are given up")
    p.add_argument("--results", help="folder to which results are appended when they are final, and from which a broken run goes on")
    p.add_argument("--output", help="folder for one text file a right-hand side; else lines are printed")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = command_session(a.workers)
    if a.input_ending == "parquet":
        df = spark.read.parquet(f"{a.input_path}/{a.input_name}.parquet")
    else:
        df = CsvDescriptor(
            name=a.input_name,
            path=a.input_path,
            ending=a.input_ending,
            header=not a.no_header,
            charset=a.charset,
            separator=a.separator,
            quote=a.quote,
            escape=a.escape,
            null_string=a.null_string,
            strict_quotes=a.strict_quotes,
            ignore_leading_whitespace=not a.keep_leading_whitespace,
            skip_lines=a.skip_lines,
            skip_differing_lines=not a.fail_on_differing_lines,
        ).read(spark)
    config = FDConfig(max_lhs_size=a.max_lhs_size, row_limit=a.row_limit, null_equals_null=not a.null_unequals_null, strategy=a.strategy, max_candidates=a.max_candidates, max_bytes=a.max_bytes, results=a.results, pli_cache_prefix=a.pli_cache_prefix, relation=a.input_name)
    metrics = Metrics()
    fds = discover_fds(df, config, metrics)
    order = attribute_order(df, df.columns, config.null_equals_null) if df.columns else []
    if a.output:
        write_text(fds, f"{a.output}/{a.input_name}", order)
    else:
        for row in fds.toLocalIterator():
            print(f"[{', '.join(sorted(row['lhs'], key=order.index))}] --> {row['rhs']}")
    print(f"{metrics.fds} dependencies in {metrics.milliseconds} ms")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
