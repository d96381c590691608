"""Tables that describe a store: sizes, archetypes, one entity, version chains and schema changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Component, assign_ids, compare
from .entities import World


def archetypes(world: World) -> DataFrame:
    """Archetypes with their components and entity counts."""
    spark = next(iter(world.tables.values())).sparkSession
    known = world.registry.archetype_frame(spark).select("archetype", "archetype_id", F.concat_ws(",", "components").alias("components"))
    return known.join(world.counts(), "archetype")


def component_counts(world: World) -> DataFrame:
    """Entities that have, and have enabled, each component."""
    r, parts = world.registry, None
    for name, df in world.tables.items():
        for c in r.slots(name):
            n = df.agg(F.count("*").alias("n"), F.count(F.when(F.col("enabled").bitwiseAND(r.bit(name, c)) != 0, 1)).alias("enabled")).withColumn("component", F.lit(c))
            parts = n if parts is None else parts.unionByName(n)
    return parts.groupBy("component").agg(F.sum("n").alias("n"), F.sum("enabled").alias("enabled"))


def entity_info(world: World, id_: int) -> DataFrame:
    """(archetype, component, enabled, value as JSON) of one entity."""
    r = world.registry
    name = next(a.name for a in r.archetypes.values() if a.id == id_ & 0xFFF)
    row = world.tables[name].where(F.col("entity_id") == id_)
    item = lambda c: F.struct(F.lit(c).alias("component"), (F.col("enabled").bitwiseAND(r.bit(name, c)) != 0).alias("enabled"), F.to_json(c).alias("value"))
    return row.select("entity_id", F.lit(name).alias("archetype"), F.explode(F.array(*[item(c) for c in r.slots(name)])).alias("x")).select("entity_id", "archetype", "x.*")


def schema_diff(spark: SparkSession, old: Component, new: Component) -> DataFrame:
    rows = [(c.kind, c.field, c.field_id, c.level, c.old, c.new) for c in compare(old, new)]
    return spark.createDataFrame(rows, "kind string, field string, field_id int, level string, old string, new string")


def schema_history(spark: SparkSession, revisions: list[Component]) -> DataFrame:
    """The changes of each revision against the one before, fields keeping their ids from one to the next."""
    known: list[Component] = []
    for r in revisions:
        known.append(assign_ids(r, known[-1] if known else None))
    rows = [(b.name, a.revision, b.revision, c.kind, c.field, c.level) for a, b in zip(known, known[1:]) for c in compare(a, b)]
    return spark.createDataFrame(rows, "component string, from_revision int, to_revision int, kind string, field string, level string")
