"""python -m lumenary run --out DIR [--as-of DATE] [--pages PARQUET] [--models DIR] [URL ...]: a batch with a printed summary."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from lumenary import rules as R
from lumenary.operators import records
from lumenary.plans.engine import Engine
from lumenary.sources import readers


def main() -> None:
    p = argparse.ArgumentParser(prog="lumenary")
    p.add_argument("command", choices=["run"])
    p.add_argument("urls", nargs="*", default=R.DEFAULT_URLS)
    p.add_argument("--out", required=True)
    p.add_argument("--as-of", default=date.today().isoformat())
    p.add_argument("--pages")
    p.add_argument("--models", help="a folder that operators.records.fit_models has written")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.as_of, pages=readers.pages(spark, a.pages) if a.pages else None, out_dir=a.out,
                    models=records.Models.stored(spark, a.models) if a.models else None)
    urls = readers.url_list(spark, list(a.urls))
    results = engine.run(urls)
    combined, by_type = engine.write(results)
    engine.summary(urls, results).show(truncate=False)
    for path in filter(None, (combined, by_type)):
        print(path, spark.read.json(path).count(), "rows")


if __name__ == "__main__":
    main()
