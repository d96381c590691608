"""Column statistics: distinct counts, equal-width histograms, most common values, and their one-pass rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dnf import FieldStatistics
from .checkpoints import written

BUCKETS, COMMON, LOG_K = 100, 100, 12


def distinct_sketch(df: DataFrame, *columns: str, log_k: int = LOG_K) -> DataFrame:
    """A mergeable HyperLogLog sketch of each column."""
    return df.agg(*[F.hll_sketch_agg(c, F.lit(log_k)).alias(c) for c in columns])


def distinct_estimate(sketches: DataFrame, *columns: str) -> DataFrame:
    """Sketches of many parts united, and their estimates."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def bucket_of(x: Column, low: Column, high: Column, buckets: int = BUCKETS) -> Column:
    """Equal widths; the last bucket takes the rest, and all goes to the first if there is one value only.

    Whole numbers have whole widths, of 1 at least; fractions have fractional ones.
    """
    whole = F.greatest(F.lit(1.0), F.floor((high - low) / buckets).cast("double"))
    return F.when(low == high, F.lit(0)).otherwise(F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((x - low) / whole)))).cast("int")


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the filled buckets: one row of bounds, broadcast, then a count that combines before the shuffle."""
    bounds = df.agg(F.min(column).cast("double").alias("__low"), F.max(column).cast("double").alias("__high"))
    both = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("__x")).crossJoin(F.broadcast(bounds))
    return both.groupBy(bucket_of(F.col("__x"), F.col("__low"), F.col("__high"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str, k: int = COMMON, scale: float = 1.0) -> DataFrame:
    """(value, n) of the k commonest values, ties by value; counts of a sample are scaled up, to 1 at least."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "value").limit(k)
    return top if scale == 1.0 else top.withColumn("n", F.greatest(F.lit(1), F.floor(F.col("n") * scale)).cast("long"))


@dataclass
class Rebuilt:
    """Statistics of many fields from one pass: summary (field, n, low, high, n_distinct, n_estimate, commonest,
    commonest_n), histogram (field, bucket, n) and common (field, value, n)."""

    summary: DataFrame
    histogram: DataFrame
    common: DataFrame


def rebuild(df: DataFrame, columns: list[str], k: int = COMMON, buckets: int = BUCKETS, fraction: float = 1.0, seed: int = 1, log_k: int = LOG_K) -> Rebuilt:
    """Statistics of numeric columns; fraction: the part of the rows to sample, whose counts are scaled up to all.

    The rows become (field, value, n) counts, which combine before the shuffle, and are written once; all else works on
    these. Whole numbers are counted as such, not as doubles, so neighbours beyond 2^53 stay apart.
    """
    kinds = dict(df.dtypes)
    whole = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint")
    entry = lambda c: F.struct(F.lit(c).alias("field"), (F.col(c) if whole(c) else F.lit(None)).cast("long").alias("whole"), (F.lit(None) if whole(c) else F.col(c)).cast("double").alias("part"))
    some = df if fraction >= 1 else df.sample(fraction=fraction, seed=seed)
    long = some.select(F.explode(F.array(*map(entry, columns))).alias("x")).select("x.*").where("whole is not null or part is not null")
    counts = written(long.groupBy("field", "whole", "part").agg(F.count("*").alias("n")), "field-counts")
    value = F.coalesce("part", F.col("whole").cast("double"))
    up = lambda n: n if fraction >= 1 else F.greatest(F.lit(1), F.floor(n / F.lit(fraction))).cast("long")
    best = F.max(F.struct("n", (-F.coalesce("whole", F.lit(0))).alias("w"), (-F.coalesce("part", F.lit(0.0))).alias("p")))
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("whole", "part"), F.lit(log_k)))
    summary = counts.groupBy("field").agg(F.sum("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n_distinct"), sketch.alias("n_estimate"), best.alias("b"), F.max(F.col("whole").isNotNull()).alias("is_whole"))
    commonest = F.when(F.col("is_whole"), (-F.col("b.w")).cast("double")).otherwise(-F.col("b.p"))
    summary = summary.select("field", up(F.col("n")).alias("n"), "low", "high", "n_distinct", "n_estimate", commonest.alias("commonest"), up(F.col("b.n")).alias("commonest_n"))
    edges = F.broadcast(counts.groupBy("field").agg(F.min(value).alias("__low"), F.max(value).alias("__high")))  # a row a field
    filled = counts.join(edges, "field").groupBy("field", bucket_of(value, F.col("__low"), F.col("__high"), buckets).alias("bucket")).agg(up(F.sum("n")).alias("n"))
    parts = [counts.where(F.col("field") == c).orderBy(F.desc("n"), "whole", "part").limit(k).select("field", value.alias("value"), up(F.col("n")).alias("n")) for c in columns]
    return Rebuilt(summary, filled, reduce(DataFrame.unionByName, parts))


def field_statistics(df: DataFrame, column: str, buckets: int = BUCKETS, k: int = COMMON) -> FieldStatistics:
    """The driver's copy for estimates: at most `buckets` + k rows come to it."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    width = (float(high) - float(low)) / buckets if n and high > low else 1.0
    at = F.least(F.lit(buckets - 1), F.floor((F.col(column).cast("double") - float(low or 0)) / width)).cast("int")
    counts = {r["b"]: r["n"] for r in df.where(F.col(column).isNotNull()).groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect()} if n else {}
    common = {r["value"]: r["n"] for r in most_common(df, column, k).collect()}
    return FieldStatistics(float(low or 0), float(high or 0), n, tuple(counts.get(b, 0) for b in range(buckets)), common)


@dataclass
class RebuildPolicy:
    """When statistics are due, and how much to sample. The reference points of the policy."""

    mutations: int = 1000
    least_rows: int = 100
    sample_above: int = 10_000

    def due(self, mutated: int, rows: int) -> bool:
        return mutated >= self.mutations and rows >= self.least_rows

    def fraction(self, rows: int) -> float:
        return min(1.0, self.sample_above / rows) if rows else 1.0


@dataclass
class Keeper:
    """Statistics of tables that are rebuilt when the policy says so: mutations are counted, and a poll looks at them."""

    policy: RebuildPolicy = field(default_factory=RebuildPolicy)
    mutated: dict[str, int] = field(default_factory=dict)
    known: dict[str, Rebuilt] = field(default_factory=dict)

    def note(self, table: str, n: int = 1) -> None:
        self.mutated[table] = self.mutated.get(table, 0) + n

    def poll(self, tables: dict[str, tuple[Callable[[], DataFrame], list[str]]]) -> list[str]:
        """Rebuild what is due, of tables (rows, columns) by name; the names of those rebuilt."""
        done = []
        for name, (rows, columns) in sorted(tables.items()):
            if self.mutated.get(name, 0) < self.policy.mutations:
                continue
            df = rows()
            n = df.count()
            if self.policy.due(self.mutated[name], n):
                self.known[name] = rebuild(df, columns, fraction=self.policy.fraction(n))
                self.mutated[name] = 0
                done.append(name)
        return done


def zone_map(df: DataFrame, key: str, columns: list[str], size: int = 64) -> DataFrame:
    """Least and greatest value of each column in runs of `size` keys."""
    return df.groupBy(F.floor(F.col(key) / size).cast("long").alias("cluster")).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
