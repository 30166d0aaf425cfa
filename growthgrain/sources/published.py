"""Folders of result tables that are published as a whole.

Each writing goes to a folder of its own below ``versions``; a manifest, one file for each
complete writing, names the tables that count. Until it is written, readers see the tables
of the writing before, so one that fails half way changes nothing for them.
"""

import datetime as dt
from collections.abc import Callable, Iterable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

VERSIONS, MANIFEST = "versions", "manifest"


def publish(
    spark: SparkSession, folder: str, write: Callable[[str], Iterable[str]]
) -> dict[str, str]:
    """Where each table lies that ``write`` wrote below the folder it was given; it returns
    their names. The manifest names them once all are there."""
    now = dt.datetime.now(dt.timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"
    names = list(write(f"{folder}/{VERSIONS}/{version}"))
    rows = [(version, name, f"{VERSIONS}/{version}/{name}") for name in names]
    manifest = spark.createDataFrame(rows, "version string, name string, path string")
    manifest.coalesce(1).write.mode("append").parquet(f"{folder}/{MANIFEST}")
    return {name: f"{folder}/{path}" for _, name, path in rows}


def published(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where each table of the last complete writing lies; nothing if there is none."""
    try:
        manifest = spark.read.parquet(f"{folder}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    last = manifest.agg({"version": "max"}).first()[0]
    rows = manifest.where(manifest.version == last).collect()
    return {row["name"]: f"{folder}/{row['path']}" for row in rows}
