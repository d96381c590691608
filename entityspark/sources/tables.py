"""Tables in and out: files of any format Spark reads, trace tables, and entity stores as folders of archetypes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import World
from ..schema import Component, Registry

FORMATS = ("parquet", "orc", "csv", "json", "text")
TRACE = "ts long, dur long, name string, system int, span_id long, tick int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    r = spark.read.options(**options)
    return (r.schema(schema) if schema else r).format(format).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None, mode: str = "overwrite", **options) -> None:
    w = df.write.mode(mode).options(**options).format(format)
    (w.partitionBy(*by) if by else w).save(path)


def save_world(world: World, path: str, cluster_by: dict[str, str] | None = None) -> None:
    """A folder for each archetype; rows are ordered by a column where one is named, so that file statistics prune."""
    for name, df in world.tables.items():
        if cluster_by and name in cluster_by:
            df = df.repartitionByRange(cluster_by[name]).sortWithinPartitions(cluster_by[name])
        df.write.mode("overwrite").parquet(f"{path}/archetype={world.registry.archetypes[name].id}")


def load_world(spark: SparkSession, registry: Registry, path: str) -> World:
    from pyspark.errors import AnalysisException

    tables = {}
    for a in registry.archetypes.values():
        try:
            tables[a.name] = spark.read.parquet(f"{path}/archetype={a.id}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return World(registry, tables)


def write_trace(events: DataFrame, path: str, ticks_per_chunk: int = 256) -> None:
    """Trace events in chunks of ticks, in order of time: a reader of a range of ticks opens its chunks only."""
    chunked = events.withColumn("chunk", F.floor(F.col("tick") / ticks_per_chunk).cast("int"))
    chunked.repartition("chunk").sortWithinPartitions("chunk", "ts").write.mode("overwrite").partitionBy("chunk").parquet(path)


def read_trace(spark: SparkSession, path: str, low_tick: int | None = None, high_tick: int | None = None, ticks_per_chunk: int = 256) -> DataFrame:
    df = spark.read.schema(TRACE + ", chunk int").parquet(path)
    if low_tick is not None:
        df = df.where((F.col("chunk") >= low_tick // ticks_per_chunk) & (F.col("tick") >= low_tick))
    if high_tick is not None:
        df = df.where((F.col("chunk") <= high_tick // ticks_per_chunk) & (F.col("tick") <= high_tick))
    return df.drop("chunk")


def chunk_manifest(events: DataFrame, ticks_per_chunk: int = 256) -> DataFrame:
    return events.groupBy(F.floor(F.col("tick") / ticks_per_chunk).cast("int").alias("chunk")).agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.count("*").alias("events"))


def schema_json(component: Component) -> str:
    fields = [{"id": f.id, "name": f.name, "type": f.type, "size": f.size, "index": f.index, "references": f.references} for f in component.fields]
    return json.dumps({"component": component.name, "revision": component.revision, "mode": component.mode, "fields": fields}, indent=1)


def schema_csv(component: Component) -> str:
    rows = ["id,name,type,size,index,references"]
    return "\n".join(rows + [f"{f.id},{f.name},{f.type},{f.size},{f.index or ''},{f.references or ''}" for f in component.fields])
