"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession


def config_of(job: str, given: str | None = None) -> dict:
    """The settings of a job: its own file beside it, with those of a given file on top."""
    out: dict = {}
    for path in (os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{job}.json"), given):
        if path:
            with open(path, encoding="utf-8") as f:
                out |= json.load(f)
    return out


def command_line(job: str, run, paths: list[str]) -> None:
    """Parse ``--config`` and a ``--path`` for each of ``paths``, open a session, run, and stop it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=(run.__doc__ or "").strip().split("\n")[0])
    parser.add_argument("--config", help="JSON file whose settings replace those of the job's own")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    got = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, *(got[p] for p in paths), config_of(job, got["config"]))
    finally:
        spark.stop()
