"""What the jobs share: config files, logging, and a session for the command line only."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
log = logging.getLogger("tapeworks.jobs")


def from_values(kind: type, values: dict):
    """A config of a dataclass; an unknown name is an error."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def main(kind: type, run: Callable, file: str, description: str) -> None:
    """The command line: a config file, then settings that replace its own. Makes and stops the session."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=file, help=f"a JSON file of settings (default {os.path.basename(file)})")
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=str)
    given = vars(parser.parse_args())
    with open(given.pop("config")) as f:
        values = json.load(f)
    for name, text in given.items():
        if text is not None:
            was = next(f.default for f in fields(kind) if f.name == name)
            values[name] = type(was)(text) if isinstance(was, int | float) else json.loads(text) if isinstance(was, tuple) else text
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(os.path.basename(file).removesuffix(".json")).getOrCreate()
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(HERE))
    try:
        run(spark, from_values(kind, values))
    finally:
        spark.stop()


def read_or_empty(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A job's own output, which may not have been written yet; the schema is given, so no file decides on it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Done:
    """What a run read and wrote; also logged."""

    read: int
    wrote: int
    parts: int
    path: str

    def told(self, job: str, more: str = "") -> Done:
        log.info("%s: read %d rows, wrote %d rows in %d partitions to %s%s", job, self.read, self.wrote, self.parts, self.path, more)
        return self
