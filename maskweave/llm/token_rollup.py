"""Token totals kept up to date by deltas.

A batch is a set of signed changes: inserts count for, deletes count against, a revised count is
the old one against and the new one for.  Committing a batch sums its changes by source, language
and tokenizer version and writes the sums under the batch's id, replacing what a former attempt of
the same batch may have left, so a batch counts once however often it is committed.  Totals are
the sums over all batches; ``compact`` folds the batches so far into one snapshot that names them,
and a batch that is already folded is not counted again.

Totals are additive, so every step sums on the map side first and a source that holds a third of
all rows is no hot group.

Defined results: null sources, languages and versions are groups of their own; a null text has no
token; a null id changes like any other row (changes carry their own counts, ids are not looked
up); repeated rows count each; a batch without rows counts as committed;
groups whose totals all return to zero are not reported; texts are counted whole; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.session import staged

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
CHANGE_SCHEMA = (
    "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"
)


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add rows of (source, lang, tokenizer, n_tokens, n_chars)."""
    return _signed(counted, 1)


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take such rows away again."""
    return _signed(counted, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace the counts ``before`` by the counts ``after``."""
    return deletes(before).unionByName(inserts(after))


def _signed(counted: DataFrame, sign: int) -> DataFrame:
    return counted.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.lit(sign).cast("bigint").alias("n_docs"),
        (F.lit(sign) * F.coalesce(F.col("n_tokens"), F.lit(0))).cast("bigint").alias("n_tokens"),
        (F.lit(sign) * F.coalesce(F.col("n_chars"), F.lit(0))).cast("bigint").alias("n_chars"),
    )


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])


class Ledger:
    """Committed batches and snapshots in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Write the batch's sums; a second commit of the same batch replaces the first.

        A batch that a snapshot has folded can be committed again with the same sums only, which changes
        nothing; other sums raise ValueError: commit the difference as a batch of its own
        (``revisions``).
        """
        self.commit_all(changes.withColumn("batch", F.lit(batch).cast("bigint")), [batch])

    def commit_all(self, changes: DataFrame, batches: list[int]) -> None:
        """Commit several batches in one pass over changes that carry a ``batch`` column."""
        # A zero row for each batch, so that a batch without changes is committed as well.
        marks = self.spark.range(1).select(
            F.explode(F.array(*[F.lit(b).cast("bigint") for b in batches])).alias("batch"),
            *[F.lit(None).cast("string").alias(k) for k in KEYS],
            *[F.lit(0).cast("bigint").alias(c) for c in SUMS],
        )
        rows = changes.select("batch", *KEYS, *SUMS).where(F.col("batch").isin(batches))
        sums = rows.unionByName(marks).groupBy("batch", *KEYS).agg(
            *[F.sum(c).cast("bigint").alias(c) for c in SUMS]
        )
        again = sorted(set(self._snapshot()[1]) & set(batches))
        if again:
            sums = staged(sums, "ledger-sums")
            columns = ["batch", *KEYS, *SUMS]
            new = sums.where(F.col("batch").isin(again)).select(columns)
            old = self._read("batches", CHANGE_SCHEMA + ", batch bigint").where(F.col("batch").isin(again)).select(columns)
            if not (new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()):
                raise ValueError(f"of the folded batches {again} one is committed with other sums")
            sums = sums.where(~F.col("batch").isin(again))
            batches = [b for b in batches if b not in again]
            if not batches:
                return
        # One file and one folder per batch: sums are few, whatever the batch held.
        (
            sums.repartition("batch")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(f"{self.path}/batches")
        )

    def batch(self, batch: int) -> DataFrame:
        """The committed sums of one batch, read once so that they can be committed again."""
        rows = self._read("batches", CHANGE_SCHEMA + ", batch bigint").where(F.col("batch") == batch)
        return staged(rows.select(*KEYS, *SUMS), "ledger-batch")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars) over everything committed."""
        base, folded = self._snapshot()
        batches = self._read("batches", CHANGE_SCHEMA + ", batch bigint")
        fresh = batches.where(~F.col("batch").isin(folded)) if folded else batches
        total = _summed(base.unionByName(fresh.select(*KEYS, *SUMS)))
        return total.where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold all batches into a new snapshot; batches already named by one stay folded."""
        _, folded = self._snapshot()
        known = self._read("batches", CHANGE_SCHEMA + ", batch bigint")
        ids = sorted({r["batch"] for r in known.select("batch").distinct().collect()} | set(folded))
        version = self._version() + 1
        nothing = [F.lit(None).cast("string").alias(k) for k in KEYS] + [
            F.lit(0).cast("bigint").alias(c) for c in SUMS
        ]
        # A row of zeros carries the names of the folded batches even if all totals are zero.
        total = self.totals().unionByName(self.spark.range(1).select(*nothing))
        total.withColumn("folded", F.array(*[F.lit(i).cast("bigint") for i in ids])).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/snapshots/version={version}")

    def _read(self, what: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        if not there:
            return self.spark.range(0).selectExpr(
                *[f"CAST(NULL AS {c.split(' ', 1)[1]}) AS {c.split(' ', 1)[0]}" for c in schema.split(", ")]
            )
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def _version(self) -> int:
        rows = self._read("snapshots", CHANGE_SCHEMA + ", folded array<bigint>, version bigint")
        return rows.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def _snapshot(self) -> tuple[DataFrame, list[int]]:
        rows = self._read("snapshots", CHANGE_SCHEMA + ", folded array<bigint>, version bigint")
        rows = rows.where(F.col("version") == self._version())
        first = rows.select("folded").first()
        return rows.select(*KEYS, *SUMS), list(first["folded"]) if first else []
