"""An entity reading of the star-schema tables: parties, which are customers and suppliers, and parts in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import entity_id
from ..operators.entities import World
from ..schema import Field, Registry
from .register import Tables

PARTY, CUSTOMER, SUPPLIER, PART = 1, 2, 3, 4

REGISTRY = (
    Registry()
    .component("Nation", Field("key", "Int", index="unique"), Field("region", "Int", index="multi"))
    .component("Account", Field("balance", "Double", index="multi"), Field("nation", "Int", index="multi", references="Nation", on_parent_delete="delete"))
    .component("Segment", Field("segment", "String64", index="multi"))
    .component("Place", Field("x", "Double"), Field("y", "Double"), Field("category", "Int"))
    .archetype("Party", PARTY, "Account")
    .archetype("Customer", CUSTOMER, "Segment", parent="Party")
    .archetype("Supplier", SUPPLIER, parent="Party")
    .archetype("Part", PART, "Place")
)


def place_x():
    return F.col("p_size") * 20.0


def place_y():
    return F.round((F.col("p_retailprice") - 900) * 10)


def world(t: Tables) -> World:
    """Accounts are enabled from a balance of 0 on, segments unless they are BUILDING."""
    c, s, p = t.customer, t.supplier, t.part
    account = lambda b, n: F.struct(F.col(b).alias("balance"), F.col(n).alias("nation")).alias("Account")
    on = lambda b: F.when(F.col(b) >= 0, 1).otherwise(0)
    return World(
        REGISTRY,
        {
            "Customer": c.select(
                entity_id("c_custkey", CUSTOMER).alias("entity_id"),
                (on("c_acctbal") + F.when(F.col("c_mktsegment") != "BUILDING", 2).otherwise(0)).alias("enabled"),
                account("c_acctbal", "c_nationkey"),
                F.struct(F.col("c_mktsegment").alias("segment")).alias("Segment"),
            ),
            "Supplier": s.select(entity_id("s_suppkey", SUPPLIER).alias("entity_id"), on("s_acctbal").alias("enabled"), account("s_acctbal", "s_nationkey")),
            "Part": p.select(
                entity_id("p_partkey", PART).alias("entity_id"),
                F.lit(1).alias("enabled"),
                F.struct(place_x().alias("x"), place_y().alias("y"), (F.col("p_partkey") % 8).cast("int").alias("category")).alias("Place"),
            ),
        },
    )


#: The same entities in SQL.
CUSTOMERS = "SELECT (c_custkey * 4096 + 2)::BIGINT AS entity_id, 2 AS archetype_id, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment FROM customer"
SUPPLIERS = "SELECT (s_suppkey * 4096 + 3)::BIGINT AS entity_id, 3 AS archetype_id, s_acctbal AS balance, s_nationkey AS nation, NULL AS segment FROM supplier"
PARTIES = f"({CUSTOMERS} UNION ALL {SUPPLIERS})"
PARTS = "(SELECT (p_partkey * 4096 + 4)::BIGINT AS entity_id, 4 AS archetype_id, p_size * 20.0::DOUBLE AS x, round((p_retailprice - 900) * 10) AS y, (p_partkey % 8)::INTEGER AS category FROM part)"
EVERY = f"(SELECT entity_id, archetype_id FROM {PARTIES} UNION ALL SELECT entity_id, archetype_id FROM {PARTS})"
