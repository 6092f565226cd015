"""Streaming restore: chunks of replies in, text without cut placeholders out.

Order matters per stream, but micro-batches and files arrive in any order.  The processor keeps
the number of the next chunk and parks chunks that came early.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskweave.operators.vault import VAULT_BUCKET, restore_by_join, vault_bucket
from maskweave.streaming.carry import advance

KEY = ["conv_id", "stream_id", "field"]
CHUNK_SCHEMA = (
    "conv_id bigint, stream_id string, field string, chunk_no bigint, text string, is_end boolean"
)
OUT_SCHEMA = (
    "conv_id bigint, stream_id string, field string, chunk_no bigint, piece int, emitted string, note string"
)
# How long a stream may be silent before what it holds goes out, and how long its state is kept
# after that: long enough to know redelivered chunks again.
IDLE_MS = 60_000
TTL_MS = 6 * 60 * 60 * 1000


class CarryProcessor(StatefulProcessor):
    """Holds back partial placeholders of one (conversation, stream, field).

    Three kinds of disorder are told apart.  A chunk that comes early waits for those before it.  A
    chunk whose number has been given out is a redelivery and is dropped.  One that never comes is
    passed over when the stream has been silent for ``idle_ms``: the next chunk carries the note
    ``after_gap``, and should the missing one turn up after all, it is given out alone, noted ``late``.

    State lives for ``ttl_ms`` after its last use, so a finished stream leaves nothing behind.
    """

    def __init__(self, idle_ms: int | None = IDLE_MS, ttl_ms: int | None = TTL_MS):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "text string", self.ttl_ms)
        self.next_no = handle.getValueState("next_no", "no bigint", self.ttl_ms)
        self.early = handle.getMapState("early", "no bigint", "text string, is_end boolean", self.ttl_ms)
        # Numbers passed over, as ranges: first to one after the last.
        self.missing = handle.getMapState("missing", "first bigint", "stop bigint", self.ttl_ms)

    def _rows(self, key, rows: list[tuple[int, int, str, str | None]]) -> Iterator[pd.DataFrame]:
        if rows:
            columns = [*KEY, "chunk_no", "piece", "emitted", "note"]
            yield pd.DataFrame([(*key, *row) for row in rows], columns=columns)

    def _found_late(self, no: int) -> bool:
        """Whether the number was passed over; it is not any more."""
        for (first,), (stop,) in list(self.missing.iterator()):
            if first <= no < stop:
                self.missing.removeKey((first,))
                for a, b in ((first, no), (no + 1, stop)):
                    if a < b:
                        self.missing.updateValue((a,), (b,))
                return True
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        want = self.next_no.get()[0] if self.next_no.exists() else 0
        held = self.pending.get()[0] if self.pending.exists() else ""
        out = []
        for batch in rows:
            for no, text, is_end in zip(batch["chunk_no"], batch["text"], batch["is_end"]):
                if int(no) >= want:
                    self.early.updateValue((int(no),), (text or "", bool(is_end)))
                elif self._found_late(int(no)):
                    out.append((int(no), 0, text or "", "late"))
        while self.early.containsKey((want,)):
            text, is_end = self.early.getValue((want,))
            self.early.removeKey((want,))
            ready, held = advance(held, text)
            if is_end:
                ready, held = ready + held, ""
            out.append((want, 0, ready, None))
            want += 1
        self.next_no.update((want,))
        self.pending.update((held,))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if held or list(self.early.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The stream fell silent: what is held goes out as a second piece of the last chunk, and chunks
        parked behind one that never came follow in order, with nothing held back across the gap."""
        held = self.pending.get()[0] if self.pending.exists() else ""
        want = self.next_no.get()[0] if self.next_no.exists() else 0
        out = [(want - 1, 1, held, None)] if held else []
        held = ""
        for no in sorted(k[0] for k in self.early.keys()):
            text, is_end = self.early.getValue((no,))
            self.early.removeKey((no,))
            gap = no != want
            if gap:
                self.missing.updateValue((want,), (no,))
                if held:
                    out[-1] = (*out[-1][:2], out[-1][2] + held, out[-1][3])
                    held = ""
            ready, held = advance(held, text)
            if is_end:
                ready, held = ready + held, ""
            out.append((no, 0, ready, "after_gap" if gap else None))
            want = no + 1
        if held:
            out[-1] = (*out[-1][:2], out[-1][2] + held, out[-1][3])
        self.pending.update(("",))
        self.next_no.update((want,))
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def carried(chunks: DataFrame, idle_ms: int | None = IDLE_MS, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Stateful pass over a chunk stream (``CHUNK_SCHEMA``); needs the RocksDB state store.

    (chunk_no, piece) is unique in a stream.  Without ``idle_ms`` a chunk that never comes parks its
    stream, without ``ttl_ms`` state stays for ever.
    """
    timed = idle_ms is not None or ttl_ms is not None
    return chunks.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=CarryProcessor(idle_ms, ttl_ms),
        outputStructType=OUT_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime" if timed else "None",
    )


def write_restored(
    chunks: DataFrame, vault_path: str, out_path: str, checkpoint: str, idle_ms: int | None = IDLE_MS,
    request: str | None = None, ttl_ms: int | None = TTL_MS, **trigger,
):
    """Start the restore query: per micro-batch the emitted texts meet the vault table.

    Each batch writes its own folder and overwrites it when replayed, so output is exactly once.
    With ``request``, the vault's request column, a stream belongs to the request its
    ``stream_id`` names, and only that request's vault is used.  Of a vault in buckets, as the
    redaction job writes it, a batch reads those of its conversations.

    A run that ends with what is available (the default trigger) has no clock: it neither passes over
    missing chunks nor forgets streams, and with a clock it would wait for its timers and never end.
    Use one kind of trigger for a checkpoint.
    """
    trigger = trigger or {"availableNow": True}
    if "processingTime" not in trigger:
        idle_ms = ttl_ms = None

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        vault = batch.sparkSession.read.parquet(vault_path)
        if VAULT_BUCKET in vault.columns:
            wanted = [r[0] for r in batch.select(vault_bucket(F.col("conv_id"))).distinct().collect()]
            vault = vault.where(F.col(VAULT_BUCKET).isin(wanted)).drop(VAULT_BUCKET)
        key = ["conv_id"]
        if request:
            vault = vault.withColumnRenamed(request, "stream_id")
            key = ["stream_id", "conv_id"]
        parts = [c for c in ("stream_id", "field", "chunk_no", "piece") if c not in key]
        rows = batch.withColumn("__seg", F.struct(*parts))
        done = restore_by_join(rows, vault, key, "__seg", "emitted").drop("__seg", "emitted")
        done.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        carried(chunks, idle_ms, ttl_ms)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(one_batch)
        .start()
    )

