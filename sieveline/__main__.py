"""python -m sieveline ROOT TASK [--budget N] [--pin PATH] [--exclude PATTERN]: evidence for a task, as markdown."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine


def main() -> None:
    args = argparse.ArgumentParser(prog="sieveline")
    args.add_argument("root")
    args.add_argument("task")
    args.add_argument("--budget", type=int, default=12_000)
    args.add_argument("--pin", action="append", default=[])
    args.add_argument("--exclude", action="append", default=[])
    given = args.parse_args()
    if set(given.pin) & set(given.exclude):
        args.error("a path is both pinned and excluded")
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    engine = Engine(spark)
    engine.index_folder(given.root)
    requests = spark.createDataFrame([(1, given.task)], "request_id long, task string")
    for row in engine.markdown(engine.select(requests, given.budget, given.pin, given.exclude)).collect():
        print(row["markdown"])


if __name__ == "__main__":
    main()
