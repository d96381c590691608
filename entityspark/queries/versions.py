"""Versioned reads, writes, conflicts, constraints and index access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from .register import Tables, query

#: Orders as versioned entities: born on the day of the order, finished ones die up to 89 days later.
HISTORY = "(SELECT o_orderkey, o_custkey, o_totalprice, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS born, CASE WHEN o_orderstatus = 'F' THEN date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + o_orderkey % 90 ELSE 0 END::BIGINT AS died FROM orders)"
SEEN = "(born = 0 OR born <= {t}) AND (died = 0 OR died > {t})"
#: Events as versions of a value of each user, in order of their id; removals end it.
CHAIN = "(SELECT user_id, event_id AS tsn, value, event_type <> 'purchase' AS active FROM events)"


def history(t: Tables):
    born = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", born.alias("born"), F.when(F.col("o_orderstatus") == "F", born + F.col("o_orderkey") % 90).otherwise(0).cast("long").alias("died"))


def chain(t: Tables):
    return t.events.select("user_id", F.col("event_id").alias("tsn"), "value", (F.col("event_type") != "purchase").alias("active"))


@query(f"SELECT o_orderkey, o_totalprice FROM {HISTORY} WHERE {SEEN.format(t=9500)}")
def snapshot_at(t: Tables):
    return store.PointInTime({"orders": history(t)}, 9000).advance(9500)["orders"].select("o_orderkey", "o_totalprice")


@query(
    f"SELECT k, CASE WHEN o_orderkey IS NULL THEN 'NotFound' WHEN {SEEN.format(t=9500)} THEN 'Success' WHEN died <> 0 AND died <= 9500 THEN 'Deleted' ELSE 'SnapshotInvisible' END AS status "
    f"FROM (SELECT unnest([1, 2, 3, 4, 5, -1]) AS k) LEFT JOIN {HISTORY} ON o_orderkey = k"
)
def read_status(t: Tables):
    h, out = history(t), None
    for k in (1, 2, 3, 4, 5, -1):
        one = store.read_status(h, "o_orderkey", k, 9500).select(F.lit(k).alias("k"), "status")
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT user_id, tsn, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tsn DESC) AS r FROM {CHAIN} WHERE tsn <= 5000) WHERE r = 1 AND active")
def temporal_index(t: Tables):
    """Each chain's value as of a snapshot."""
    return store.latest(chain(t), ["user_id"], 5000).select("user_id", "tsn", "value")


@query(f"SELECT user_id, tsn, (row_number() OVER w)::INTEGER AS version, lead(tsn) OVER w AS replaced FROM {CHAIN} WHERE user_id = 7 WINDOW w AS (PARTITION BY user_id ORDER BY tsn)")
def revisions(t: Tables):
    return store.version_chain(chain(t), "user_id", 7).select("user_id", "tsn", "version", "replaced")


@query("SELECT count(*) AS chains, sum(n)::BIGINT AS versions, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def chain_statistics(t: Tables):
    return store.chain_statistics(chain(t), "user_id")


@query("SELECT ((s_suppkey + 5000000 - 1) * 4096 + 3)::BIGINT AS entity_id, s_name, 77::BIGINT AS born, 0::BIGINT AS died FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)".replace("s_suppkey + 5000000 - 1", "r + 5000000 - 1"))
def spawn_batch(t: Tables):
    """New ids are dense and in order, without a single-task sort."""
    return store.spawn(t.supplier, 3, 5_000_000, ["s_suppkey"], 77).select("entity_id", "s_name", "born", "died")


@query("""
WITH c AS (SELECT user_id AS c_custkey, value AS c_acctbal, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 3 = 0)
SELECT c_custkey, c_acctbal FROM c WHERE r = 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)""")
def upsert_latest(t: Tables):
    changes = t.events.where("event_id % 3 = 0").select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), "event_id")
    return store.upsert(t.customer.select("c_custkey", "c_acctbal"), changes, ["c_custkey"], "event_id")


@query(f"SELECT o_orderkey, CASE WHEN died = 0 AND o_custkey % 11 = 0 THEN 9999 ELSE died END::BIGINT AS died FROM {HISTORY}")
def destroy_batch(t: Tables):
    h = history(t)
    gone = h.where("o_custkey % 11 = 0").select("o_orderkey")
    return store.destroy(h, gone, "o_orderkey", 9999).select("o_orderkey", "died")


@query("""
SELECT (r_regionkey * 16)::BIGINT AS id, 0 AS depth FROM region WHERE r_regionkey = 2
UNION ALL SELECT n_nationkey * 16 + 1, 1 FROM nation WHERE n_regionkey = 2
UNION ALL SELECT c_custkey * 16 + 2, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
UNION ALL SELECT o_orderkey * 16 + 3, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def cascade_delete(t: Tables):
    """A deleted region takes its nations, their customers and their orders along; ids carry their kind."""
    from ..operators.checkpoints import ensure

    ensure(t.spark)
    id_ = lambda key, kind: (F.col(key) * 16 + kind).cast("long")
    links = [
        (t.nation.select(id_("n_nationkey", 1).alias("i"), id_("n_regionkey", 0).alias("p")), "i", "p"),
        (t.customer.select(id_("c_custkey", 2).alias("i"), id_("c_nationkey", 1).alias("p")), "i", "p"),
        (t.orders.select(id_("o_orderkey", 3).alias("i"), id_("o_custkey", 2).alias("p")), "i", "p"),
    ]
    return store.cascade(t.region.where("r_regionkey = 2").select(id_("r_regionkey", 0).alias("id")), links, most=None)


@query("SELECT c_custkey, ((CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END + 2) & ~(CASE WHEN c_nationkey = 3 THEN 2 ELSE 0 END))::INTEGER AS enabled FROM customer")
def enable_disable(t: Tables):
    c = t.customer.withColumn("enabled", F.when(F.col("c_acctbal") >= 0, 1).otherwise(0))
    return store.set_enabled(store.set_enabled(c, 2, True), 2, False, F.col("c_nationkey") == 3).select("c_custkey", "enabled")


def _images(t: Tables):
    base = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal")
    now = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    mine = base.withColumn("c_acctbal", F.col("c_acctbal") - 50)
    return base, now, mine


@query("SELECT c_custkey, c_acctbal - 50 AS c_acctbal, c_custkey % 3 = 0 AS conflict FROM customer WHERE c_custkey % 2 = 0")
def commit_last_writer(t: Tables):
    return store.merge_conflicts(*_images(t), ["c_custkey"], ["c_acctbal"])


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 50 ELSE c_acctbal - 50 END, 2) AS c_acctbal, c_custkey % 3 = 0 AS conflict FROM customer WHERE c_custkey % 2 = 0")
def commit_with_handler(t: Tables):
    """Both changes add up: what stands, plus what this transaction changed."""
    out = store.merge_conflicts(*_images(t), ["c_custkey"], ["c_acctbal"], lambda base, now, mine: now + (mine - base))
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_violation(t: Tables):
    return store.unique_violations(t.orders, "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def index_range(t: Tables):
    return store.index_range(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 50000, 60000, tie="o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 30")
def index_range_descending(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return store.index_range(rows, "l_quantity", None, 30, descending=True, tie="k").drop("k")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 17")
def index_point(t: Tables):
    return store.index_point(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 17)


@query("SELECT min(o_totalprice) AS min_key, max(o_totalprice) AS max_key FROM orders")
def index_bounds(t: Tables):
    return store.index_bounds(t.orders, "o_totalprice")


@query(f"SELECT o_orderkey AS pk, o_custkey AS key, o_totalprice FROM {HISTORY} WHERE o_custkey BETWEEN 100 AND 120 AND {SEEN.format(t=9500)}")
def index_stream(t: Tables):
    """(pk, key, component) of an index range at a snapshot."""
    h = store.snapshot(history(t), 9500)
    return store.index_range(h, "o_custkey", 100, 120, tie="o_orderkey").select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("key"), "o_totalprice")


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS at, l_linenumber AS value FROM lineitem UNION ALL SELECT l_orderkey, count(*), 99 FROM lineitem GROUP BY l_orderkey")
def collections(t: Tables):
    """Lists of values in a field: gathered, appended to, taken apart."""
    lists = store.collect_values(t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("v")), "l_orderkey", "v", "xs")
    return store.elements(store.append(lists, "xs", 99), "l_orderkey", "xs", "value").withColumn("at", F.col("at").cast("long"))
