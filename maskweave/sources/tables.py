"""Reading text tables, JSON lines, policy stores and gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.operators import policy as policy_ops
from maskweave.session import spread


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A parquet table, pruned to ``columns`` at the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_table(
    spark: SparkSession, folder: str, name: str, key: list[str], *columns: str
) -> DataFrame:
    """A table for per-row text work, spread over all cores when it is small."""
    return spread(table(spark, folder, name, *columns), *key)


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels: (uid, task_name, text, entities)."""
    return spark.read.parquet(path).select("uid", "task_name", "text", "entities")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON-lines file as a ``value`` column."""
    return spark.read.text(path)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id, text, error) of each line: blank lines vanish, a bad line keeps its error, a
    missing id stays null and a missing text is empty.  The id is a variant: a number stays a number."""
    schema = "id variant, text string, __bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    rows = lines.where(F.trim(F.col(value)) != "").withColumn(
        "__p", F.from_json(F.col(value), schema, options)
    )
    bad: Column = F.col("__p").isNull() | F.col("__p.__bad").isNotNull()
    return rows.select(
        *[c for c in lines.columns if c != value],
        F.when(~bad, F.col("__p.id")).alias("id"),
        F.when(~bad, F.coalesce("__p.text", F.lit(""))).alias("text"),
        F.when(bad, F.lit("unreadable line")).alias("error"),
    )


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """Policy store of the form {"deny": [...], "allow": [...]}.

    No file means an empty policy.  A file that cannot be read as one is an error.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return policy_ops.empty_policy(spark)
    stores = (
        spark.read.schema(policy_ops.STORE_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return policy_ops.policy_from_stores(stores)
