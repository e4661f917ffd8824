"""What the jobs share: configuration files, sessions of the command line, and the log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def from_mapping(kind: type, values: dict):
    """A configuration from a mapping; an unknown or missing name is an error."""
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**values)


def read_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A Parquet table's columns as SQL expressions of what it has."""
    return spark.read.parquet(path).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def command(kind: type, run: Callable[[SparkSession, object], dict], name: str, argv: list[str] | None = None) -> dict:
    """Runs a job from a JSON file of settings, of which --set NAME=VALUE replaces single ones; the session begins and ends here."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("config", help="a JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="replace a setting; VALUE is JSON, or else a string")
    args = parser.parse_args(argv)
    with open(args.config, encoding="utf-8") as f:
        values = json.load(f)
    for pair in args.set:
        key, _, value = pair.partition("=")
        try:
            values[key] = json.loads(value)
        except ValueError:
            values[key] = value
    logging.basicConfig(level=os.environ.get("LOG_LEVEL", "INFO"), format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        report = run(spark, from_mapping(kind, values))
        print(json.dumps(report, sort_keys=True))
        return report
    finally:
        spark.stop()
