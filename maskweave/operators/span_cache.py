"""A span cache on disk: offsets by text hash, for each policy version, in buckets and runs.

A batch appends one *run* below the version's folder, partitioned by a prefix of the hash, so that a
later batch lists few folders and reads only the buckets its own texts fall into.  Runs are merged in
levels: when a level has ``FAN`` runs side by side they become one of the next level.  After n
batches at most FAN runs a level and log(n) levels are left, and each row has been written
once a level, whatever n is.  Runs carry the batches they cover in their name and count only when
complete, so a batch that is run again after a crash overwrites its own run and nothing else.
Versions that no job uses any more are deleted whole.

Rows hold hashes, offsets and labels, never a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
FAN = 16
ROW = "seg_hash string, spans array<struct<start:bigint,end:bigint,label:string>>"


def bucket(seg_hash: Column) -> Column:
    """A number below ``BUCKETS`` from the first characters of a hex hash."""
    return (F.conv(F.substring(seg_hash, 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


@dataclass
class SpanCache:
    """The cache below ``root``, as one writer sees it; any number may read."""

    spark: SparkSession
    root: str
    fan: int = FAN

    # --- folders ---------------------------------------------------------------------------

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        if not fs.exists(path):
            return []
        return [s.getPath().getName() for s in fs.listStatus(path)]

    def _version(self, version: str) -> str:
        return f"{self.root}/policy_version={version}"

    def _run(self, version: str, level: int, number: int) -> str:
        return f"{self._version(version)}/run={level}-{number}"

    def versions(self) -> list[str]:
        names = self._names(self.root)
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("policy_version="))

    def runs(self, version: str, before: int) -> list[tuple[int, int]]:
        """Complete runs, the highest levels first, that together hold the batches below ``before``."""
        found = {}
        for name in self._names(self._version(version)):
            if name.startswith("run="):
                level, number = map(int, name[4:].split("-"))
                found.setdefault(level, set()).add(number)
        chosen, covered = [], set()
        for level in sorted(found, reverse=True):
            width = self.fan**level
            for number in sorted(found[level]):
                inside = range(number * width, (number + 1) * width)
                below = level == 0 and number < before or inside.stop <= before
                if below and inside.start not in covered and self._complete(version, level, number):
                    chosen.append((level, number))
                    covered.update(inside)
        return chosen

    def _complete(self, version: str, level: int, number: int) -> bool:
        return self._fs().exists(self._path(f"{self._run(version, level, number)}/_SUCCESS"))

    # --- reading ---------------------------------------------------------------------------

    def rows(self, version: str, before: int, buckets: list[int] | None = None) -> DataFrame:
        """(seg_hash, spans, run, bucket) of the batches below ``before``, in some buckets or in all."""
        out = self._read(version, self.runs(version, before))
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def _read(self, version: str, runs: list[tuple[int, int]]) -> DataFrame:
        schema = f"{ROW}, run string, bucket int"
        if not runs:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self._version(version))
        return reader.parquet(*[self._run(version, *r) for r in runs])

    def run(self, version: str, batch: int) -> DataFrame:
        """(seg_hash, spans) that one batch wrote."""
        return self._read(version, [(0, batch)]).select("seg_hash", "spans")

    def known(self, version: str, before: int, hashes: DataFrame) -> DataFrame:
        """One row for each of ``hashes`` (a column seg_hash) that is cached.  Only the buckets of
        these hashes are read."""
        wanted = [r[0] for r in hashes.select(bucket(F.col("seg_hash"))).distinct().collect()]
        rows = self.rows(version, before, sorted(wanted)).select("seg_hash", "spans")
        return rows.join(hashes.select("seg_hash").distinct(), "seg_hash", "left_semi").dropDuplicates(["seg_hash"])

    # --- writing ---------------------------------------------------------------------------

    def append(self, version: str, batch: int, rows: DataFrame) -> None:
        """Write what a batch found: (seg_hash, spans), one row a hash."""
        self._write(rows, self._run(version, 0, batch))

    def compact(self, version: str, before: int) -> int:
        """Merge every full group of runs of batches below ``before``; the number of runs written.

        Children go once their parent is complete.  Call it between batches: nothing may still
        be reading the runs it merges.
        """
        written, level = 0, 0
        while self.fan ** (level + 1) <= before:
            width = self.fan ** (level + 1)
            here = {n for lv, n in self._all(version) if lv == level}
            for parent in sorted({n // self.fan for n in here}):
                if (parent + 1) * width > before:
                    continue
                children = [n for n in sorted(here) if n // self.fan == parent]
                if not self._complete(version, level + 1, parent):
                    runs = [(level, n) for n in children if self._complete(version, level, n)]
                    rows = self._read(version, runs).dropDuplicates(["seg_hash"])
                    self._write(rows, self._run(version, level + 1, parent))
                    written += 1
                for n in children:
                    self._fs().delete(self._path(self._run(version, level, n)), True)
            level += 1
        return written

    def _all(self, version: str) -> list[tuple[int, int]]:
        names = [n for n in self._names(self._version(version)) if n.startswith("run=")]
        return [tuple(map(int, n[4:].split("-"))) for n in names]

    def _write(self, rows: DataFrame, path: str) -> None:
        placed = rows.select("seg_hash", "spans", bucket(F.col("seg_hash")).alias("bucket"))
        # One file a bucket, sorted, so that its row groups have narrow ranges of hashes.
        placed.repartition("bucket").sortWithinPartitions("bucket", "seg_hash").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(path)

    def keep_versions(self, used: list[str]) -> None:
        """Delete the cache of all other versions."""
        for version in self.versions():
            if version not in used:
                self._fs().delete(self._path(self._version(version)), True)
