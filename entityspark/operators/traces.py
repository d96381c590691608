"""Roll-ups of trace events (ts, dur, name, system, span_id, tick), and statistics of a selected range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import PLACE, RANGE, before, lagged, nth, ranged, ranked


def assign_ticks(events: DataFrame, starts: DataFrame, ts: str = "ts") -> DataFrame:
    """events with `tick`: the number of the last start at or before each, 0 before the first.

    An as-of join by a union and a running maximum, within ranges of time; what a range needs of those before it is the
    maximum of one row each.
    """
    marks = starts.select(F.col(ts), F.col("tick").cast("int").alias("tick"), F.lit(0).alias("__e"))
    rows = events.select(F.col(ts), F.lit(None).cast("int").alias("tick"), F.lit(1).alias("__e"), F.struct(*events.columns).alias("__row"))
    kept = ranged(rows.unionByName(marks, allowMissingColumns=True), [ts, "__e"], "ticks")
    top = kept.groupBy(RANGE).agg(F.max("tick").alias("__m"))
    carry = top.select(RANGE, F.coalesce(before(top, F.max("__m")), F.lit(0)).alias("__carry"))
    w = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumn("__t", F.coalesce(F.max("tick").over(w), F.lit(0))).join(F.broadcast(carry), RANGE)
    return out.where("__e = 1").select("__row.*", F.greatest("__t", "__carry").alias("tick"))


def fold_spans(kickoffs: DataFrame, completions: DataFrame, span: str = "span_id") -> DataFrame:
    """Kickoffs with the duration of their completion, and `folded`; completions without a kickoff stay apart."""
    done = completions.select(span, F.col("dur").alias("__done"))
    return kickoffs.join(done, span, "left").withColumn("folded", F.col("__done").isNotNull()).withColumn("dur", F.coalesce("__done", "dur")).drop("__done")


def per_tick(events: DataFrame) -> DataFrame:
    """One row a tick: first time, duration, events, longest system, and a bit for each of the systems below 64."""
    bit = F.when(F.col("system") < 64, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("system").cast("int")))
    return events.groupBy("tick").agg(
        F.min("ts").alias("start"), (F.max("ts") - F.min("ts")).alias("duration"), F.count("*").alias("events"), F.max("dur").alias("max_system"), F.coalesce(F.bit_or(bit), F.lit(0)).alias("active")
    )


def per_system(events: DataFrame) -> DataFrame:
    return events.groupBy("system").agg(F.count("*").alias("invocations"), F.sum("dur").alias("total"))


def nth_of(sorted_by: str, fraction: float, groups: list[str], rows: DataFrame) -> DataFrame:
    """For each group the element at min(floor(fraction * n), n - 1) of its sorted values, exactly."""
    return nth(rows, sorted_by, fraction, groups)


def intervals(ticks: DataFrame, tick: str = "tick", start: str = "start", into: str = "interval_us") -> DataFrame:
    """ticks with the time since the start of the tick before."""
    return lagged(ticks, tick, start, "__before").withColumn(into, F.col(start) - F.col("__before")).drop("__before")


def number_starts(starts: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct starts with their tick, from 1 on."""
    return ranked(starts.select(ts).distinct(), [ts], "tick", 1, "starts")


def tier_budget(spans: DataFrame, tier: Column) -> DataFrame:
    """The spans and their cost of each tier."""
    return spans.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("dur").alias("cost"))


def top_spans(spans: DataFrame, k: int = 20) -> DataFrame:
    """The k names with the longest spans, ties by name: spans and total time of each."""
    x = spans.groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("total"), F.max("dur").alias("max"))
    return x.orderBy(F.desc("max"), "name").limit(k)


def overall(ticks: DataFrame) -> DataFrame:
    """One row over ticks: start, end, longest tick and system, 95th percentile by position, totals."""
    p95 = nth_of("duration", 0.95, [], ticks.select("duration")).select(F.col("p").alias("p95"))
    total = ticks.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("end"), F.max("duration").alias("max_tick"), F.max("max_system").alias("max_system"), F.sum("events").alias("events"), F.count("*").alias("ticks"))
    return total.crossJoin(F.broadcast(p95))  # one row each


def clipped(start: Column, end: Column, low, high) -> Column:
    """The part of a span inside [low, high), null if there is none."""
    d = F.least(end, F.lit(high)) - F.greatest(start, F.lit(low))
    return F.when((end > low) & (start < high) & (d > 0), d)


def span_statistics(spans: DataFrame, low, high) -> DataFrame:
    """For each name the spans' parts inside a range: count, min, mean, max, 95th by position, total and the worst span."""
    x = spans.select("name", "span_id", clipped(F.col("ts"), F.col("ts") + F.col("dur"), low, high).alias("part")).where("part is not null")
    p95 = nth_of("part", 0.95, ["name"], x.select("name", "part")).withColumnRenamed("p", "p95")
    worst = F.max(F.struct("part", (-F.col("span_id")).alias("s")))
    agg = x.groupBy("name").agg(F.count("*").alias("n"), F.min("part").alias("min"), F.round(F.avg("part"), 4).alias("mean"), F.max("part").alias("max"), F.sum("part").alias("total"), worst.alias("w"))
    return agg.join(p95, "name").select("name", "n", "min", "mean", "max", "p95", "total", (-F.col("w.s")).alias("worst"))


def tick_statistics(ticks: DataFrame, low, high) -> DataFrame:
    """Of the ticks that meet a range: their number, and least, mean, 95th and greatest duration."""
    hit = ticks.where((F.col("start") + F.col("duration") > low) & (F.col("start") < high)).select("duration")
    p95 = nth_of("duration", 0.95, [], hit).select(F.col("p").alias("p95"))
    return hit.agg(F.count("*").alias("n"), F.min("duration").alias("min"), F.round(F.avg("duration"), 4).alias("mean"), F.max("duration").alias("max")).crossJoin(F.broadcast(p95))


def top_systems(events: DataFrame, low, high, k: int = 5) -> DataFrame:
    x = events.select("system", clipped(F.col("ts"), F.col("ts") + F.col("dur"), low, high).alias("part")).where("part is not null")
    return x.groupBy("system").agg(F.count("*").alias("n"), F.sum("part").alias("total")).orderBy(F.desc("total"), "system").limit(k)


def pause_total(pauses: DataFrame, low, high) -> DataFrame:
    p = clipped(F.col("ts"), F.col("ts") + F.col("dur"), low, high)
    return pauses.agg(F.count(p).alias("n"), F.coalesce(F.sum(p), F.lit(0)).alias("total"))


def gauge_series(samples: DataFrame, gauge: str, at: str, value: str) -> DataFrame:
    """Wide to long is the table itself; each gauge's series with its change since the sample before."""
    w = Window.partitionBy(gauge).orderBy(at)
    return samples.select(gauge, at, value, (F.col(value) - F.lag(value).over(w)).alias("change"))


def split_capacities(samples: DataFrame, gauge: str, at: str, value: str, capacity_of: dict) -> tuple[DataFrame, DataFrame]:
    """(series without capacities, (gauge, capacity)): a gauge that tells another one's capacity is no series of its own;
    its last value above 0 is the capacity of that gauge. capacity_of: the gauge for each gauge of capacity."""
    known = list(capacity_of)
    last = samples.where(F.col(gauge).isin(known) & (F.col(value) > 0)).groupBy(gauge).agg(F.max_by(value, F.struct(at, value)).alias("capacity"))
    of = F.create_map(*[F.lit(x) for pair in capacity_of.items() for x in pair])
    return samples.where(~F.col(gauge).isin(known)), last.select(of[F.col(gauge)].alias(gauge), "capacity")


def last_ticks(ticks: DataFrame, n: int) -> DataFrame:
    """The ring of the last n ticks."""
    return ticks.orderBy(F.desc("tick")).limit(n)
