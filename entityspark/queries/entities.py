"""Scans, predicates, joins, counts and order over entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.entities import Navigation, World
from ..plans.dnf import branch_bitmap, field, flipped
from ..schema import Field, Registry
from ..streaming.ticks import in_tier
from .register import Tables, query
from .world import CUSTOMER, CUSTOMERS, EVERY, PARTIES, SUPPLIERS, REGISTRY, world

IDS = "entity_id, archetype_id"


@query(f"SELECT {IDS} FROM {PARTIES}")
def poly_scan(t: Tables):
    return world(t).query("Party").execute()


@query(f"SELECT {IDS} FROM ({SUPPLIERS})")
def exact_scan(t: Tables):
    return world(t).query_exact("Supplier").execute()


@query(f"SELECT {IDS} FROM {EVERY}")
def broad_scan(t: Tables):
    return world(t).query_all().execute()


@query(f"SELECT {IDS} FROM ({CUSTOMERS}) WHERE (entity_id // 4096) % 7 <> 0 UNION ALL SELECT ((s_suppkey + 10000000) * 4096 + 2)::BIGINT, 2 FROM supplier WHERE (s_suppkey + 10000000) % 7 <> 0")
def pending_scan(t: Tables):
    w = world(t)
    new = w.tables["Supplier"].withColumn("entity_id", F.col("entity_id") + 10_000_000 * 4096 - 1).withColumn("Segment", F.struct(F.lit("NEW").alias("segment")))
    gone = w.with_pending({"Customer": new}).query_exact("Customer").execute().where(F.floor(F.col("entity_id") / 4096) % 7 == 0)
    return w.with_pending({"Customer": new}, gone).query_exact("Customer").execute()


@query(f"SELECT archetype_id, count(*) AS n, round(sum(balance), 2) AS balance FROM {PARTIES} GROUP BY archetype_id")
def cluster_chunks(t: Tables):
    """Arrow batches of a span of entities through a function, whose partial results add up."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def work(batches):
        for b in batches:
            cents = pc.round(pc.multiply(pc.struct_field(b.column(3), "balance"), 100.0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([1] * b.num_rows, pa.int64()), pc.cast(cents, pa.int64())], ["archetype_id", "n", "cents"])

    w = world(t)
    rows = w.tables["Customer"].select("entity_id", F.lit(CUSTOMER).alias("archetype_id"), "enabled", "Account").unionByName(w.tables["Supplier"].select("entity_id", F.lit(3).alias("archetype_id"), "enabled", "Account"))
    parts = rows.mapInArrow(work, "archetype_id int, n long, cents long")
    return parts.groupBy("archetype_id").agg(F.sum("n").alias("n"), F.round(F.sum("cents") / 100, 2).alias("balance"))


@query("SELECT (s_suppkey * 4096 + 3)::BIGINT AS entity_id, s_acctbal AS balance FROM supplier WHERE s_suppkey = 7 AND s_acctbal >= 0 UNION ALL SELECT (s_suppkey * 4096 + 3)::BIGINT, NULL FROM supplier WHERE s_suppkey = 7 AND s_acctbal < 0")
def open_entity(t: Tables):
    return world(t).open(7 * 4096 + 3).select("entity_id", F.col("Account")["balance"].alias("balance"))


@query(f"SELECT entity_id, archetype_id, CASE WHEN balance >= 0 THEN balance END AS balance, CASE WHEN segment <> 'BUILDING' THEN segment END AS segment FROM {PARTIES}")
def component_read(t: Tables):
    """Components are null where they are absent or disabled."""
    r = world(t).query("Party").read("Account", "Segment")
    return r.select("entity_id", "archetype_id", F.col("Account")["balance"].alias("balance"), F.col("Segment")["segment"].alias("segment"))


@query("SELECT (c_custkey * 4096 + 2 + c_custkey % 2)::BIGINT AS entity_id, (c_custkey % 2 = 0 OR c_custkey IN (SELECT s_suppkey FROM supplier)) AS alive FROM customer")
def liveness(t: Tables):
    ids = t.customer.select((F.col("c_custkey") * 4096 + CUSTOMER + F.col("c_custkey") % 2).alias("entity_id"))
    return world(t).alive(ids)


@query(f"SELECT {IDS} FROM ({CUSTOMERS})")
def with_component(t: Tables):
    return world(t).query("Party").with_("Account", "Segment").execute()


@query(f"SELECT {IDS} FROM ({SUPPLIERS})")
def without_component(t: Tables):
    return world(t).query("Party").without("Segment").execute()


@query(f"SELECT {IDS} FROM ({SUPPLIERS})")
def exclude_subtree(t: Tables):
    return world(t).query("Party").exclude("Customer").execute()


@query(f"SELECT {IDS} FROM {PARTIES} WHERE balance >= 0 AND segment <> 'BUILDING'")
def enabled_both(t: Tables):
    return world(t).query("Party").enabled("Account").enabled("Segment").execute()


@query(f"SELECT {IDS} FROM {PARTIES} WHERE coalesce(segment, 'BUILDING') = 'BUILDING'")
def disabled_or_absent(t: Tables):
    return world(t).query("Party").disabled("Segment").execute()


@query(f"SELECT {IDS} FROM ({CUSTOMERS}) WHERE segment <> 'BUILDING' AND length(segment) % 2 = 1")
def where_opaque(t: Tables):
    """Any Python function of a component, in Arrow batches."""

    @F.pandas_udf(T.BooleanType())
    def odd(s: pd.DataFrame) -> pd.Series:
        return s["segment"].str.len() % 2 == 1

    return world(t).query("Party").where_opaque("Segment", odd).execute()


balance, nation, segment = field("Account.balance"), field("Account.nation"), field("Segment.segment")


@query(f"SELECT {IDS} FROM {PARTIES} WHERE balance > 5000.0 AND nation <> 3")
def where_field(t: Tables):
    return world(t).query("Party").where_field((balance > 5000.0) & (nation != 3)).execute()


@query(f"SELECT {IDS} FROM {PARTIES} WHERE (balance >= 9000.0 OR nation = 7) AND NOT (balance < 0.0 OR nation > 20)")
def where_dnf(t: Tables):
    return world(t).query("Party").where_field(((balance >= 9000.0) | (nation == 7)) & ~((balance < 0.0) | (nation > 20))).execute()


@query(f"SELECT {IDS} FROM {PARTIES} WHERE 1000.0 < balance AND 12 >= nation")
def where_flipped(t: Tables):
    """Constants on the left, and two conditions given apart."""
    return world(t).query("Party").where_field(flipped(1000.0, "<", balance)).where_field(flipped(12, ">=", nation)).execute()


@query(f"SELECT {IDS} FROM {PARTIES} WHERE (balance > 8000.0 AND segment = 'MACHINERY') OR nation = 5")
def where_two_components(t: Tables):
    """A branch over a component that an archetype lacks is false for it."""
    return world(t).query("Party").where_field(((balance > 8000.0) & (segment == "MACHINERY")) | (nation == 5)).execute()


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal END AS b FROM customer)
SELECT c_custkey, NOT isnan(b) AND b > 100 AS gt, isnan(b) OR b <> 100 AS ne, NOT isnan(b) AND b <= 100 AS le, NOT isnan(b) AND b = b AS eq_self FROM x""")
def nan_comparisons(t: Tables):
    from ..functions.scalars import compare

    x = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("b"))
    b = F.col("b")
    return x.select("c_custkey", compare(b, ">", 100.0).alias("gt"), compare(b, "!=", 100.0).alias("ne"), compare(b, "<=", 100.0).alias("le"), compare(b, "==", b).alias("eq_self"))


@query(f"SELECT entity_id, (CASE WHEN balance >= 9000 THEN 1 ELSE 0 END + CASE WHEN nation >= 20 THEN 2 ELSE 0 END)::INTEGER AS bits FROM {PARTIES} WHERE balance >= 9000 OR nation >= 20")
def or_branch_bitmap(t: Tables):
    """Which branches of an OR hold, for views that tell them apart."""
    w = world(t)
    rows = w.tables["Customer"].drop("Segment").unionByName(w.tables["Supplier"])
    return rows.select("entity_id", branch_bitmap((balance >= 9000.0) | (nation >= 20)).alias("bits")).where("bits <> 0")


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 4 END & 5) <> 0")
def tier_filter(t: Tables):
    tier = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") > 0, 2).otherwise(4)
    return in_tier(t.customer, tier, 5).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def fk_navigation(t: Tables):
    """Sources whose reference leads to a target with a property: a semi-join, filters below it."""
    nav = Navigation(t.orders, t.customer, "o_custkey", "c_custkey").where(F.col("o_totalprice") > 1000, F.col("c_mktsegment") == "MACHINERY")
    return nav.execute().select("o_orderkey")


@query("SELECT count(*) AS n, count(*) > 0 AS \"any\" FROM lineitem WHERE l_quantity < 10 AND l_orderkey <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def fk_count_any(t: Tables):
    nav = Navigation(t.lineitem, t.orders, "l_orderkey", "o_orderkey").where(F.col("l_quantity") < 10, F.col("o_orderstatus") == "F")
    return nav.execute().agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any"))


@query("SELECT 'Account.balance' AS link, 'Account.balance is not a foreign key' AS problem UNION ALL SELECT 'Account.nation', 'Account.nation refers to Nation, not Segment' UNION ALL SELECT 'Account.nation to Nation', ''")
def fk_validation(t: Tables):
    rows = []
    for link, args in (("Account.balance", ("Account", "balance", "Nation")), ("Account.nation", ("Account", "nation", "Segment")), ("Account.nation to Nation", ("Account", "nation", "Nation"))):
        try:
            REGISTRY.check_reference(*args)
            rows.append((link, ""))
        except ValueError as e:
            rows.append((link, str(e)))
    return t.spark.createDataFrame(rows, "link string, problem string")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def fk_reverse(t: Tables):
    """All sources of some targets."""
    return Navigation(t.orders, t.customer, "o_custkey", "c_custkey").sources_of(t.customer.where("c_nationkey = 4")).select("o_orderkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def slot_join(t: Tables):
    """Components of one entity from their tables, by its key."""
    c = t.customer.where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return c.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT 'old only' AS side, s_suppkey AS k FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT 'new only', c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set_transition(t: Tables):
    """What a client must drop and sync when its set changes: an anti-join each way."""
    old, new = t.supplier.select(F.col("s_suppkey").alias("k")), t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    side = lambda a, b, name: a.join(b, "k", "left_anti").select(F.lit(name).alias("side"), "k")
    return side(old, new, "old only").union(side(new, old, "new only"))


@query(f"SELECT count(*) AS n FROM {PARTIES} WHERE balance > 2500")
def count_entities(t: Tables):
    return world(t).query("Party").where_field(balance > 2500.0).count_frame()


@query(f"SELECT count(*) > 0 AS \"any\" FROM {PARTIES} WHERE balance > 9999.5")
def any_entity(t: Tables):
    return world(t).query("Party").where_field(balance > 9999.5).any_frame()


@query(
    "SELECT 'Party' AS archetype, 0::BIGINT AS exact, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS polymorphic UNION ALL SELECT 'Customer', count(*), count(*) FROM customer "
    "UNION ALL SELECT 'Supplier', count(*), count(*) FROM supplier UNION ALL SELECT 'Part', count(*), count(*) FROM part"
)
def archetype_counts(t: Tables):
    return world(t).counts()


@query(f"SELECT {IDS} FROM (SELECT *, row_number() OVER (ORDER BY balance DESC NULLS LAST, entity_id) AS r FROM {PARTIES}) WHERE r > 20 AND r <= 70")
def order_skip_take(t: Tables):
    return world(t).query("Party").order_by("Account", "balance", descending=True).skip(20).take(50).execute()


@query(f"SELECT {IDS} FROM (SELECT *, row_number() OVER (ORDER BY nation, entity_id) AS r FROM {PARTIES} WHERE balance > 0) WHERE r <= 100")
def order_with_ties(t: Tables):
    return world(t).query("Party").where_field(balance > 0.0).order_by("Account", "nation").take(100).execute()


@query(f"SELECT {IDS} FROM (SELECT *, row_number() OVER (ORDER BY entity_id DESC) AS r FROM {PARTIES}) WHERE r <= 25")
def order_by_key(t: Tables):
    return world(t).query("Party").order_by_key(descending=True).take(25).execute()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(t: Tables):
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.orders.select("o_custkey")).distinct()


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, count(DISTINCT c_acctbal) AS d FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def grouping_sets(t: Tables):
    c = t.customer
    return c.groupingSets([[c.c_mktsegment, c.c_nationkey], [c.c_mktsegment], []], c.c_mktsegment, c.c_nationkey).agg(F.count("*").alias("n"), F.countDistinct("c_acctbal").alias("d"))


@query("""
SELECT o_orderkey, (row_number() OVER w)::INTEGER AS rn, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS q,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)""")
def window_functions(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    d = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.row_number().over(w).alias("rn"),
        F.rank().over(w).alias("rk"),
        F.dense_rank().over(w).alias("dr"),
        F.ntile(4).over(d).alias("q"),
        F.lag("o_orderkey").over(d).alias("prev"),
        F.count("*").over(d.rowsBetween(-2, 0)).alias("recent"),
    )


@query(f"SELECT * FROM (VALUES ('customer', 1), ('no such key', 0), ('no such archetype', 0)) AS v(asked, found)")
def try_open(t: Tables):
    """What is there is opened; what isn't gives nothing and raises nothing."""
    w = world(t)
    first = t.customer.agg(F.min("c_custkey")).first()[0]
    ids = {"customer": first * 4096 + CUSTOMER, "no such key": 987_654_321 * 4096 + CUSTOMER, "no such archetype": 4096 + 77}
    got = {name: w.try_open(i) for name, i in ids.items()}
    return t.spark.createDataFrame([(name, 0 if df is None else df.count()) for name, df in got.items()], "asked string, found int")


@query(f"SELECT entity_id, balance AS key FROM {PARTIES} WHERE balance >= 0 AND balance BETWEEN 100 AND 2500")
def index_handle(t: Tables):
    """An index by its field, over all archetypes that have it; disabled components aren't in it."""
    return world(t).index("Account", "balance").range(100, 2500)


#: Line items as bodies: boxes of their own.
BODIES = "(SELECT (l_orderkey * 10 + l_linenumber)::BIGINT * 4096 + 9 AS entity_id, l_quantity AS x0, l_extendedprice AS y0, l_quantity + 1.5 AS x1, l_extendedprice + 900 AS y1 FROM lineitem)"


def bodies(t: Tables) -> World:
    registry = Registry().component("Body", *[Field(n, "Double") for n in ("x0", "y0", "x1", "y1")]).archetype("Thing", 9, "Body")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    rows = t.lineitem.select((key * 4096 + 9).alias("entity_id"), F.lit(1).alias("enabled"), F.struct(q.alias("x0"), p.alias("y0"), (q + 1.5).alias("x1"), (p + 900).alias("y1")).alias("Body"))
    return World(registry, {"Thing": rows})


@query(f"""
WITH s AS (SELECT *, greatest((x0 - 0.5) / 1.0, (y0 - 1000) / 800.0) AS tn, least((x1 - 0.5) / 1.0, (y1 - 1000) / 800.0) AS tf FROM {BODIES}),
h AS (SELECT entity_id, greatest(tn, 0) AS entry FROM s WHERE tn <= tf AND tf >= 0 AND greatest(tn, 0) <= 45)
SELECT entity_id, 9 AS archetype_id FROM (SELECT *, row_number() OVER (ORDER BY entry, entity_id) AS r FROM h) WHERE r > 3 AND r <= 40""")
def ray_front_to_back(t: Tables):
    """The boxes that a ray meets within a length, in the order in which it enters them."""
    bounds, at, way = ("x0", "y0", "x1", "y1"), (0.5, 1000.0), (1.0, 800.0)
    return bodies(t).query("Thing").where_ray("Body", bounds, at, way, 45).front_to_back("Body", bounds, at, way).skip(3).take(37).execute()
