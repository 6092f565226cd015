"""Where the policy lives: an append-only teach/unteach log, and published versions of it.

Teaching only appends a row, so two writers cannot overwrite each other; the current policy is
derived from the log.  A published version is a new folder that readers see whole or not at all.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions.patterns import GLOBAL_SCOPE
from maskweave.functions.text import ascii_lower
from maskweave.operators import policy as P


def _append(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], P.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def teach(
    spark: SparkSession,
    path: str,
    term: str,
    label: str,
    scope: str = GLOBAL_SCOPE,
    whole_word: bool = False,
    known_scopes: DataFrame | None = None,
) -> None:
    """Append a teach event.  With scopes configured, an unknown one is refused: the term would
    protect nobody.  Labels must be ASCII, or their placeholders could never be restored."""
    if not label.isascii():
        raise ValueError("a label must be ASCII")
    if known_scopes is not None and scope.lower() != GLOBAL_SCOPE:
        key = ascii_lower(F.lit(scope))
        if not known_scopes.where(ascii_lower("scope") == key).take(1):
            raise ValueError(f"unknown scope {scope!r}: not 'global' and not configured")
    _append(spark, path, (time.time_ns(), "teach", term, label, scope, whole_word))


def unteach(spark: SparkSession, path: str, term: str, scope: str | None = None) -> None:
    """Append an unteach event for one scope, or for all of them."""
    _append(spark, path, (time.time_ns(), "unteach", term, None, scope, None))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(P.LOG_SCHEMA).parquet(path)


def current(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """The policy as the log says now, on top of a stored policy if there is one.

    A log nobody has written to yet is empty.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        log = read_log(spark, path)
    else:
        log = spark.createDataFrame([], P.LOG_SCHEMA)
    return P.policy_state(log, base)


def publish(policy: DataFrame, path: str, version: int) -> None:
    """Write one immutable version; publishing the same number twice is an error."""
    policy.write.mode("errorifexists").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(policy, version) of the newest complete version; an empty policy when there is none."""
    known = versions(spark, path)
    if not known:
        return P.empty_policy(spark), 0
    newest = known[-1]
    return spark.read.schema(P.POLICY_SCHEMA).parquet(f"{path}/version={newest}"), newest
