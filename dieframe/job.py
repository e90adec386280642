"""python -m dieframe.job SOURCE STORE --line L1 --days 3: loads the last days of a long table into a store; the exit code says how it went."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from .functions.columns import temp_round5
from .streaming.days import run_days
from .streaming.load import Store


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="dieframe.job")
    args.add_argument("source", help="folder of long rows, best laid out by day")
    args.add_argument("store", help="the store's folder")
    args.add_argument("--line", required=True)
    args.add_argument("--days", type=int, default=1)
    args.add_argument("--today", type=date.fromisoformat)
    args.add_argument("--items", nargs="*")
    a = args.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    done = run_days(spark.read.parquet(a.source), Store(spark, a.store), a.line, a.days, a.today, lambda df: df.withColumn("temp", temp_round5("temp")), a.items)
    print(done.summary())
    return done.code


if __name__ == "__main__":
    sys.exit(main())
