"""Continuous redaction: policy reload, span cache, repeat suppression, suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import maskweave
from maskweave.functions.patterns import SUGGESTION_LIMIT
from maskweave.operators import delta as DL
from maskweave.operators import model as M
from maskweave.operators import vault as V
from maskweave.operators.model import DetectorPlugin
from maskweave.operators.policy import compact, policy_version
from maskweave.operators.span_cache import SpanCache
from maskweave.session import scratch, staged
from maskweave.sources import policy_store as PS


def without_repeats(
    segments: DataFrame, ts: str, within: str, policy_version: str | Column | None = None, scope: str | None = None
) -> DataFrame:
    """Pass each distinct text once per time span; state is bounded by the watermark.

    With ``policy_version`` (a value, or a column of the rows) a text passes once for each version:
    what a former policy let through is looked at again after a term has been taught.
    """
    version = F.lit(policy_version) if isinstance(policy_version, str) else policy_version
    seen_by = F.lit(None).cast("string") if version is None else version.cast("string")
    return (
        DL.with_hash(segments, scope=scope)
        .withColumn("policy_version", seen_by)
        .withWatermark(ts, within)
        .dropDuplicatesWithinWatermark(["seg_hash", "policy_version"])
        .drop("policy_version")
    )


def redacted_stream(segments: DataFrame, policy: DataFrame) -> DataFrame:
    """Stateless redaction under a fixed policy: each segment is its own conversation."""
    return V.redact_rows(maskweave.detect_rows(segments, policy, ["seg_no"])).drop("spans", "vault")


QUEUE_SCHEMA = (
    "scope string, term string, last_seen struct<batch:bigint,conv_id:bigint,seg_no:bigint,start:bigint>"
)


@dataclass
class RedactionJob:
    """One micro-batch at a time: newest policy, cached spans, redacted output.

    Folders below ``root``: ``cache`` (offsets by text hash, per policy version, see ``SpanCache``),
    ``redacted``, ``vault`` and ``suggestions``.  Each batch writes its own partition of each and
    overwrites it when replayed, so a restart after a lost executor or driver repeats nothing.
    A batch reads only the cache buckets of its own texts, and the cache keeps the newest
    ``keep_versions`` policy versions.

    ``request`` names the column of the request id: every request is a vault of its own, so a
    conversation may come any number of times in a batch or over batches.  Without one the
    placeholders are numbered within a micro-batch of a conversation, and a name that later
    stands for another value is not restored.  With ``log_path`` the teach/unteach log there is
    read on top of the newest published version for every batch, so a term taught now hides from
    the next batch on.  With ``seal_key`` vault values are encrypted.

    ``plugin`` adds a detector of one's own.  Texts it fails on are redacted by the other layers and are not
    cached; ``failures`` counts them for each batch.
    """

    policy_path: str
    root: str
    scope: str | None = None
    request: str | None = None
    log_path: str | None = None
    seal_key: bytes | None = None
    plugin: DetectorPlugin | None = None
    keep_versions: int = 2

    @property
    def vault_key(self) -> list[str]:
        return [*([self.request] if self.request else []), "conv_id"]

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """What earlier batches wrote; empty before the first one."""
        try:
            return spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{schema}, batch bigint")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # What is staged on the way holds private values: it goes when the batch is written.
        with scratch(batch.sparkSession):
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, version = PS.latest(spark, self.policy_path)
        if self.log_path:
            newest = PS.current(spark, self.log_path, newest)
        policy = compact(newest)
        if self.log_path:
            version = f"{version}-{policy_version(policy).first()[0][:16]}"
        name = f"v{version}"
        cache = SpanCache(spark, f"{self.root}/cache")
        cache.compact(name, batch_id)
        extra = [self.scope] if self.scope else []
        segments = DL.with_hash(batch, scope=self.scope)
        # Read by two steps: what is known, and what the segments get.
        known = staged(cache.known(name, batch_id, segments), "known-spans")
        texts = segments.groupBy("seg_hash").agg(
            F.coalesce(F.any_value("text"), F.lit("")).alias("text"),
            *[F.any_value(c).alias(c) for c in extra],
            F.min(F.struct("conv_id", "seg_no")).alias("place"),
        )
        fresh = texts.join(known.select("seg_hash"), "seg_hash", "left_anti")
        rows = maskweave.detect_rows(fresh, policy, ["seg_hash"], scope=self.scope, plugin=self.plugin)
        failed = F.col("failed") if self.plugin is not None else F.lit(False)
        # Read by four steps below; detection runs once.
        found = staged(rows.select("seg_hash", *extra, "place", "spans", failed.alias("failed")), "found-spans")
        new = DL.cache_rows(found, "").drop("policy_version")
        # A text the plug-in failed on is tried again when it comes again.
        good = found.where(~F.col("failed"))
        cache.append(name, batch_id, DL.cache_rows(good, "").drop("policy_version"))
        self._write(M.detector_failures(found), "failures", batch_id)
        self._suggest(found, policy, batch_id)
        self._forget_versions(cache, name, batch_id)

        spans_by_hash = known.unionByName(new)
        key = self.vault_key
        rows = segments.join(spans_by_hash, "seg_hash").select(
            *key, "seg_no", "text", F.explode("spans").alias("s")
        )
        spans = rows.select(
            *key,
            "seg_no",
            F.col("s.start").alias("start"),
            F.col("s.end").alias("end"),
            F.col("s.label").alias("label"),
            F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"),
        )
        texts = batch.select(*key, "seg_no", F.coalesce("text", F.lit("")).alias("text"))
        red, vault = V.redact_conversations(texts, spans, key)
        self._write(red.drop("text"), "redacted", batch_id)
        if self.seal_key is not None:
            vault = V.seal(vault, "real", self.seal_key, [*key, "inner"])
        placed = vault.withColumn(V.VAULT_BUCKET, V.vault_bucket(F.col("conv_id")))
        rows = placed.repartition(V.VAULT_BUCKET).write.mode("overwrite").partitionBy(V.VAULT_BUCKET)
        rows.parquet(f"{self.root}/vault/batch={batch_id}")

    def _forget_versions(self, cache: SpanCache, name: str, batch_id: int) -> None:
        """Keep the cache of the versions last used; a log of them is kept beside it."""
        spark = cache.spark
        rows = self._read(spark, "versions", "name string, used bigint").where(F.col("batch") == batch_id - 1)
        used = {r["name"]: r["used"] for r in rows.collect()} | {name: batch_id}
        newest = sorted(used, key=used.get)[-self.keep_versions :]
        log = spark.createDataFrame([(n, used[n]) for n in newest], "name string, used bigint")
        self._write(log.coalesce(1), "versions", batch_id)
        if set(used) - set(newest):
            cache.keep_versions(newest)

    def _suggest(self, found: DataFrame, policy: DataFrame, batch_id: int) -> None:
        """Carry the queue on: texts scanned in this batch, after what the last batch left."""
        scope = F.col(self.scope) if self.scope else F.lit(None).cast("string")
        rows = found.select(
            "seg_hash", "place.conv_id", "place.seg_no", scope.alias("who"),
            F.explode("spans").alias("s"),
        ).select("seg_hash", "conv_id", "seg_no", "who", "s.start", "s.source", "s.value")
        new = DL.suggestions(rows, policy, "who", ("conv_id", "seg_no")).select(
            "scope",
            "term",
            F.struct(
                F.lit(batch_id).cast("bigint").alias("batch"),
                F.col("last_seen.place.conv_id").alias("conv_id"),
                F.col("last_seen.place.seg_no").alias("seg_no"),
                F.col("last_seen.start").alias("start"),
            ).alias("last_seen"),
        )
        old = self._read(found.sparkSession, "suggestions", QUEUE_SCHEMA)
        queue = old.where(F.col("batch") == batch_id - 1).drop("batch")
        self._write(merge_suggestions(queue, new), "suggestions", batch_id)


def merge_suggestions(old: DataFrame, new: DataFrame, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Queue after one more batch: newest sighting per (scope, term), the most recent kept."""
    return (
        old.unionByName(new)
        .groupBy("scope", "term")
        .agg(F.max("last_seen").alias("last_seen"))
        .orderBy(F.col("last_seen").desc(), "scope", "term")
        .limit(limit)
    )
