"""Delivery of a stream through an outbox: in order per key, stopping at the first failure, and going on from there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Send = Callable[[str, str], None]


class _Queue:
    """What one key has not delivered yet, oldest first."""

    def __init__(self, send: Send, key: str, attempts: int) -> None:
        self.send, self.key, self.attempts = send, key, attempts
        self.waiting: list[tuple[int, str]] = []

    def _delivered(self, payload: str, attempts: int) -> bool:
        for _ in range(attempts):
            try:
                self.send(self.key, payload)
            except Exception:  # noqa: BLE001, S112  any error of a transport means that it is down
                continue
            return True
        return False

    def drain(self) -> bool:
        """Deliver what waits, one attempt each, up to the first failure; whether nothing waits any more."""
        sent = 0
        while sent < len(self.waiting) and self._delivered(self.waiting[sent][1], 1):
            sent += 1
        del self.waiting[:sent]
        return not self.waiting

    def emit(self, seq: int, payload: str) -> None:
        """Deliver a new record behind what waits; it waits itself if that, or each of its attempts, fails."""
        if not (self.drain() and self._delivered(payload, self.attempts)):
            self.waiting.append((seq, payload))


def _deliver(frames: Iterator[pd.DataFrame], send: Send, attempts: int) -> Iterator[pd.DataFrame]:
    """Rows (key, old, seq, payload), sorted so that a key's queued ones come first, to those that still wait."""
    queue: _Queue | None = None
    drained = False

    def left() -> pd.DataFrame:
        if not drained:
            queue.drain()
        return pd.DataFrame([(queue.key, *row) for row in queue.waiting], columns=["key", "seq", "payload"])

    for pdf in frames:
        for key, old, seq, payload in zip(pdf["key"], pdf["old"], pdf["seq"], pdf["payload"], strict=True):
            if queue is None or key != queue.key:
                if queue is not None:
                    yield left()
                queue, drained = _Queue(send, key, attempts), False
            if old:
                queue.waiting.append((seq, payload))
            else:
                queue.emit(seq, payload)
                drained = True
    if queue is not None:
        yield left()


class Outbox:
    """A foreachBatch sink whose undelivered rows wait in a table, one version per batch.

    send(key, payload) delivers one record and raises if it cannot; it runs in tasks and must be serializable. Each batch
    reads the version before it, puts its records behind what waits, and delivers key by key in order of seq: what waits
    first, with one attempt each, then each new record with several. The first failure of a key ends its turn, and
    the rest of the key waits for the next batch; other keys go on. A version is written as a whole and replaced if
    the batch runs again, so a batch that fails halfway starts from the same queue. Records can arrive twice then, which
    their ids tell; they are never lost or reordered. A null key or payload is an error.

    Order holds within a key, so a key's rows go through one task, which streams them and holds what waits of one key.
    """

    def __init__(self, path: str, send: Send, key: str, seq: str, payload: str, attempts: int = 2) -> None:
        self.path, self.send, self.attempts = path.rstrip("/"), send, max(attempts, 1)
        self.columns = (key, seq, payload)

    def waiting(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Rows (key, seq, payload) that the last version, or the last one before a batch, holds."""
        empty = spark.createDataFrame([], "key string, seq long, payload string")
        last = self._last(spark, before)
        return empty if last is None else spark.read.schema(empty.schema).parquet(last)

    def _last(self, spark: SparkSession, before: int | None) -> str | None:
        """Path of the last version; the log of versions is one small row per batch."""
        try:
            log = spark.read.schema("batch long, path string, at timestamp").json(f"{self.path}/log")
        except Exception as e:  # noqa: BLE001  no batch has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        row = (log if before is None else log.where(F.col("batch") < before)).orderBy(F.desc("batch"), F.desc("at")).first()
        return row["path"] if row else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key, seq, payload = self.columns
        new = batch.select(F.col(key).cast("string").alias("key"), F.lit(False).alias("old"), F.col(seq).cast("long").alias("seq"), F.col(payload).cast("string").alias("payload"))
        old = self.waiting(spark, batch_id).select("key", F.lit(True).alias("old"), "seq", "payload")
        rows = old.unionByName(new)
        rows = rows.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} of a record is null"))).otherwise(F.col(c)).alias(c) for c in ("key", "old", "seq", "payload")])
        dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("old"), "seq")
        send, attempts = self.send, self.attempts
        left = dealt.mapInPandas(lambda frames: _deliver(frames, send, attempts), "key string, seq long, payload string")
        version = f"{self.path}/batch={batch_id}-{uuid.uuid4().hex}"
        left.write.parquet(version)
        spark.range(1).select(F.lit(batch_id).alias("batch"), F.lit(version).alias("path"), F.current_timestamp().alias("at")).write.mode("append").json(f"{self.path}/log")
