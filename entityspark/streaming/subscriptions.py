"""Published views: delta messages for subscribers, and the client's copy that they keep up to date."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import ranked
from ..plans.schedule import Priority, skip_subscription


def delta_message(delta: DataFrame, now: DataFrame, before: DataFrame | None, key: str, components: list[str], versioned: tuple[str, ...] = ()) -> DataFrame:
    """(op, key, components, changed): Added rows carry all components, Modified the changed ones (versioned ones
    always), Removed none. Only the delta's rows of the states are read."""
    touched = delta.select(key)
    n = now.join(touched, key, "left_semi").select(key, *components)
    x = delta.join(n, key, "left")
    if before is not None:
        old = before.join(touched, key, "left_semi").select(key, *[F.col(c).alias(f"__{c}") for c in components])
        x = x.join(old, key, "left")
    dirty = lambda c: F.lit(True) if c in versioned or before is None else ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    sent = {c: (F.col("kind") == "Added") | ((F.col("kind") == "Modified") & dirty(c)) for c in components}
    names = F.array_compact(F.array(*[F.when(sent[c], F.lit(c)) for c in components]))
    return x.select(F.col("kind").alias("op"), key, *[F.when(sent[c], F.col(c)).alias(c) for c in components], names.alias("changed"))


def initial_sync(view: DataFrame, key: str, batch: int) -> DataFrame:
    """The view's rows with the number of the batch in which a new subscriber gets them, in the keys' order."""
    return ranked(view.select(key), [key], "__at", 0, "sync").select(key, F.floor(F.col("__at") / batch).cast("int").alias("batch"))


def sync_events(view: DataFrame, key: str, batch: int, resync: bool = False) -> DataFrame:
    """(batch, event, key): the messages of a first sync, in the order of batches: a Resync if the client must forget what
    it has, the rows as Added, and one SyncComplete after the last batch (batch 0 of an empty view)."""
    rows = initial_sync(view, key, batch).select("batch", F.lit("Added").alias("event"), key)
    nothing = F.lit(None).cast(dict(view.dtypes)[key]).alias(key)
    out = rows.unionByName(rows.agg((F.coalesce(F.max("batch") + 1, F.lit(0))).cast("int").alias("batch")).select("batch", F.lit("SyncComplete").alias("event"), nothing))
    if resync:
        out = view.sparkSession.range(1).select(F.lit(-1).alias("batch"), F.lit("Resync").alias("event"), nothing).unionByName(out)
    return out


def materialize_client(messages: DataFrame, key: str, tick: str, components: list[str]) -> DataFrame:
    """A client's state after all messages: the last value of each component of each key that is still there.

    In a tick Added comes before Modified before Removed; what an entity had before it was last added is forgotten.
    """
    rank = F.when(F.col("op") == "Added", 0).when(F.col("op") == "Modified", 1).otherwise(2)
    m = messages.withColumn("__at", F.col(tick) * 3 + rank)
    last = m.groupBy(key).agg(F.max("__at").alias("__end"), F.max(F.when(F.col("op") == "Removed", F.col("__at"))).alias("__gone"), F.max(F.when(F.col("op") == "Added", F.col("__at"))).alias("__born"))
    alive = last.where(F.col("__gone").isNull() | (F.col("__born") > F.col("__gone"))).select(key, "__born")
    live = m.join(alive, key).where(F.col("__at") >= F.coalesce("__born", F.lit(0)))
    value = lambda c: F.max_by(c, F.when(F.array_contains("changed", c), F.col("__at"))).alias(c)
    return live.groupBy(key).agg(*map(value, components))


@dataclass
class PublishedView:
    """A view that clients subscribe to: one for all, or one made for each client by a factory."""

    name: str
    view: Callable[[str | None], DataFrame]
    priority: Priority = Priority.NORMAL
    shared: bool = True
    subscribers: set[str] = field(default_factory=set)

    def frame(self, client: str) -> DataFrame:
        return self.view(None if self.shared else client)

    def due(self, level: int, tick: int) -> bool:
        return not skip_subscription(self.priority, level, tick)


def transition(old: set[str], new: set[str]) -> tuple[set[str], set[str]]:
    """(views to sync, views to drop) when a client's subscriptions change."""
    return new - old, old - new


def frame_bytes(tick: int, rows: list[dict]) -> bytes:
    """A length-framed message: the body's length and JSON."""
    body = json.dumps({"tick": tick, "rows": rows}, separators=(",", ":"), default=str).encode()
    return struct.pack("<I", len(body)) + body


def read_frames(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(json.loads(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def sink(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of delta rows: a folder for each batch, overwritten by a retry, so each counts once."""
    return lambda batch, batch_id: batch.withColumn("view", F.lit(name)).write.mode("overwrite").parquet(f"{path}/tick={batch_id}")
