"""Views over change streams, kept by Structured Streaming's state, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_view(changes: DataFrame, key: str, order: str, inside: Column) -> DataFrame:
    """(key, order, kind) of a view over a stream of changes (key, order, op, ...): a key's state is whether it is in
    the view and the last order seen; older changes that come late are ignored.

    One row of state a key, in the state store; changes of a batch are taken in order, for which a key's rows of one
    micro-batch are held at a time.
    """
    kind = dict(changes.dtypes)[key]

    def step(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        was, last = state.get if state.exists else (False, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for at, now in zip(rows["at"].tolist(), rows["inside"].tolist()):
            if last is not None and at < last:
                continue
            if was or now:
                out.append((k[0], at, "Modified" if was and now else "Added" if now else "Removed"))
            was, last = bool(now), at
        state.update((was, last))
        yield pd.DataFrame(out, columns=["key", "at", "kind"])

    rows = changes.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.coalesce((F.col("op") != "delete") & inside, F.lit(False)).alias("inside"))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at long, kind string", "was boolean, last long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnsRenamed({"key": key, "at": order})


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` in windows of event time; `late` is how long a window stays open for late rows."""
    e = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, to a table in a folder that driver and executors share, and read that."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
