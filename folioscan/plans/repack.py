"""Repack a dump into a sorted Parquet index; also a command.

python -m folioscan.plans.repack -b BASE -o OUT [-c] [-r] [--lang en]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscan.operators import redirect_counters, skip_redirects, write_index
from folioscan.sources import Fetcher, HttpFetcher, read_dump, resolve_dump


def repack(spark: SparkSession, dump: str, out: str, skip: bool = False, entities: str = "text", files: int | None = None) -> dict[str, int]:
    """Write the index of ``dump`` to ``out``; returns the counters, taken before the filter: ``redirectPages`` and ``revisions``, and ``distinctRedirectPages``, the pages themselves.

    The counters have a pass of their own, which extracts the page's header
    alone: a sort reads its input twice, to place its bounds, and would make an
    observation count twice too.
    """
    rows = read_dump(spark, dump, entities)
    write_index(skip_redirects(rows) if skip else rows, out, files=files)
    pages = F.count_distinct(F.when(F.col("page.is_redirect"), F.col("page.id"))).alias("distinctRedirectPages")
    return rows.agg(*redirect_counters(), pages).first().asDict()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repack", description="Repack a wiki dump into a sorted index.")
    p.add_argument("-b", "--basePath", required=True, help="folder that holds a folder of dumps for each language")
    p.add_argument("-o", "--outputPath", required=True, help="where the index goes")
    p.add_argument("-c", "--checkNew", action="store_true", help="look for a newer dump and fetch it")
    p.add_argument("-r", "--skipRedirect", action="store_true", help="leave out redirect pages")
    p.add_argument("--lang", default="en", help="language code of the dump")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, fetcher: Fetcher | None = None) -> int:
    """Exit status: 0 done or help, 1 wrong arguments or failure. Where no dump is there yet, one is fetched, asked for or not."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("repack").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        dump = resolve_dump(spark, args.basePath, args.lang, args.checkNew, fetcher or HttpFetcher())
        counters = repack(spark, dump, args.outputPath, args.skipRedirect)
    except Exception as e:
        print(f"repack failed: {e}", file=sys.stderr)
        return 1
    print("\n".join(f"{k}={v}" for k, v in sorted(counters.items())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
