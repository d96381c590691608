"""Statistics, traces, scalars and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import diagnostics, statistics, traces
from ..schema import Component, Field, Migrations, assign_ids, compare, evolve, level, migrate_rows, validate
from ..sources import shell
from ..sources.tables import chunk_manifest, schema_json
from .register import Tables, query
from .world import CUSTOMERS, REGISTRY, SUPPLIERS, world


@query("SELECT TRUE AS l_orderkey, TRUE AS l_partkey")
def approx_distinct(t: Tables):
    """Mergeable sketches of parts, united: each within 5 % of the true number."""
    parts = t.lineitem.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_orderkey", F.lit(12)).alias("l_orderkey"), F.hll_sketch_agg("l_partkey", F.lit(12)).alias("l_partkey"))
    names = ("l_orderkey", "l_partkey")
    true = t.lineitem.agg(*[F.count_distinct(c).alias(f"true_{c}") for c in names])
    both = statistics.distinct_estimate(parts, *names).crossJoin(F.broadcast(true))  # one row each
    return both.select(*[(F.abs(F.col(c) - F.col(f"true_{c}")) <= 0.05 * F.col(f"true_{c}")).alias(c) for c in names])


@query("SELECT least(99, floor((o_totalprice - lo) / greatest(1.0, floor((hi - lo) / 100))))::INTEGER AS bucket, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def histogram(t: Tables):
    return statistics.histogram(t.orders, "o_totalprice")


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def most_common(t: Tables):
    return statistics.most_common(t.lineitem, "l_quantity", 20)


@query("""
WITH v AS (SELECT 'l_quantity' AS field, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem),
c AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM v GROUP BY 1, 2)
SELECT field, sum(n)::BIGINT AS n, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, count(*) AS n_distinct, TRUE AS near, max(CASE WHEN r = 1 THEN value END)::DOUBLE AS commonest, max(CASE WHEN r = 1 THEN n END) AS commonest_n FROM c GROUP BY field""")
def statistics_rebuild(t: Tables):
    """Of each field in one pass, the sketch's estimate within 5 % of the number of values."""
    s_ = statistics.rebuild(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"]).summary
    return s_.withColumn("near", F.abs(F.col("n_estimate") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct")).drop("n_estimate")


FIELDS = "(SELECT 'l_extendedprice' AS field, l_extendedprice::DOUBLE AS value FROM lineitem UNION ALL SELECT 'l_orderkey', l_orderkey::DOUBLE FROM lineitem)"


@query(f"""
WITH e AS (SELECT field, min(value) AS lo, max(value) AS hi FROM {FIELDS} GROUP BY field)
SELECT field, least(99, floor((value - lo) / greatest(1.0, floor((hi - lo) / 100))))::INTEGER AS bucket, count(*) AS n FROM {FIELDS} JOIN e USING (field) GROUP BY 1, 2""")
def statistics_histograms(t: Tables):
    """The rebuild's 100 buckets of each field."""
    return statistics.rebuild(t.lineitem, ["l_extendedprice", "l_orderkey"]).histogram


@query(f"SELECT field, value, n FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM {FIELDS} GROUP BY 1, 2) WHERE r <= 100")
def statistics_common(t: Tables):
    """The rebuild's 100 commonest values of each field."""
    return statistics.rebuild(t.lineitem, ["l_extendedprice", "l_orderkey"]).common


@query("SELECT * FROM (VALUES ('few changes', FALSE), ('few rows', FALSE), ('due', TRUE), ('just rebuilt', FALSE)) AS v(\"case\", rebuilt)")
def statistics_policy(t: Tables):
    """When statistics are rebuilt: after 1000 mutations, of tables with 100 rows or more."""
    keeper = statistics.Keeper()
    tables = {"orders": (lambda: t.orders, ["o_totalprice"]), "nation": (lambda: t.nation, ["n_nationkey"])}
    keeper.note("orders", 999)
    rows = [("few changes", "orders" in keeper.poll(tables))]
    keeper.note("nation", 5000)
    rows.append(("few rows", "nation" in keeper.poll(tables)))
    keeper.note("orders")
    rows += [("due", "orders" in keeper.poll(tables)), ("just rebuilt", "orders" in keeper.poll(tables))]
    return t.spark.createDataFrame(rows, "`case` string, rebuilt boolean")


@query("SELECT op, v::DOUBLE AS value, TRUE AS near, CASE op WHEN '==' THEN count(*) FILTER (WHERE l_quantity = v) WHEN '!=' THEN count(*) FILTER (WHERE l_quantity <> v) WHEN '>' THEN count(*) FILTER (WHERE l_quantity > v) WHEN '>=' THEN count(*) FILTER (WHERE l_quantity >= v) WHEN '<' THEN count(*) FILTER (WHERE l_quantity < v) ELSE count(*) FILTER (WHERE l_quantity <= v) END AS actual FROM lineitem, (VALUES ('=='), ('!='), ('>'), ('>='), ('<'), ('<=')) AS o(op), (VALUES (5), (25), (50)) AS w(v) GROUP BY op, v")
def selectivity_estimates(t: Tables):
    """Estimates from a histogram and common values: within 5 % of all rows of the true counts."""
    st = statistics.field_statistics(t.lineitem, "l_quantity")
    rows = [(op, float(v), st.estimate(op, float(v))) for op in ("==", "!=", ">", ">=", "<", "<=") for v in (5, 25, 50)]
    name = lambda op, v: F.lit(f"{op}{v}")
    counts = F.create_map(*[x for op, v, _ in rows for x in (name(op, v), F.count(F.when(s.compare(F.col("l_quantity"), op, v), 1)))])
    true = t.lineitem.agg(counts.alias("m"))
    e = t.spark.createDataFrame(rows, "op string, value double, estimate long")
    n = t.lineitem.count()
    both = e.crossJoin(F.broadcast(true)).select("op", "value", "estimate", F.col("m")[F.concat("op", F.col("value").cast("string"))].alias("actual"))
    return both.select("op", "value", (F.abs(F.col("estimate") - F.col("actual")) <= 0.05 * n).alias("near"), "actual")


@query("SELECT (o_orderkey // 64)::BIGINT AS cluster, count(*) AS n, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey FROM orders GROUP BY 1")
def zone_map(t: Tables):
    return statistics.zone_map(t.orders, "o_orderkey", ["o_totalprice", "o_custkey"])


#: Events as a trace: whole units of time, a tick an hour.
SPANS = "(SELECT event_id AS span_id, epoch_us(ts) AS ts, (value * 1000000)::BIGINT AS dur, event_type AS name, (user_id % 80)::INTEGER AS system, (epoch_us(ts) // 3600000000)::INTEGER AS tick FROM events)"
EDGES = "(SELECT min(epoch_us(ts)) + 100000000000 AS lo, min(epoch_us(ts)) + 500000000000 AS hi FROM events)"
PART = "CASE WHEN ts + dur > lo AND ts < hi THEN least(ts + dur, hi) - greatest(ts, lo) END"


def spans(t: Tables):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select(F.col("event_id").alias("span_id"), us.alias("ts"), F.round(F.col("value") * 1000000).cast("long").alias("dur"), F.col("event_type").alias("name"), (F.col("user_id") % 80).cast("int").alias("system"), F.floor(us / 3600000000).cast("int").alias("tick"))


def selected(t: Tables) -> tuple[int, int]:
    first = t.events.agg(F.unix_micros(F.min("ts").cast("timestamp"))).first()[0]
    return first + 100_000_000_000, first + 500_000_000_000


@query(f"SELECT tick, min(ts) AS start, max(ts) - min(ts) AS duration, count(*) AS events, max(dur) AS max_system, coalesce(bit_or(CASE WHEN system < 64 AND system <> 63 THEN (1::BIGINT << system) WHEN system = 63 THEN -9223372036854775808 END), 0)::BIGINT AS active FROM {SPANS} GROUP BY tick")
def tick_rollup(t: Tables):
    return traces.per_tick(spans(t))


@query(f"SELECT system, count(*) AS invocations, sum(dur)::BIGINT AS total FROM {SPANS} GROUP BY system")
def system_rollup(t: Tables):
    return traces.per_system(spans(t))


TICKS = f"(SELECT tick, min(ts) AS start, max(ts) - min(ts) AS duration, count(*) AS events, max(dur) AS max_system FROM {SPANS} GROUP BY tick)"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY duration) - 1 AS i, count(*) OVER () AS c FROM {TICKS})
SELECT min(start) AS start, max(start + duration) AS "end", max(duration) AS max_tick, max(max_system) AS max_system, sum(events)::BIGINT AS events, count(*) AS ticks, max(CASE WHEN i = least(floor(c * 0.95), c - 1) THEN duration END) AS p95 FROM r""")
def global_rollup(t: Tables):
    return traces.overall(traces.per_tick(spans(t)))


@query(f"""
WITH p AS (SELECT name, span_id, {PART} AS part FROM {SPANS}, {EDGES}), q AS (SELECT * FROM p WHERE part > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part) - 1 AS i, count(*) OVER (PARTITION BY name) AS c, row_number() OVER (PARTITION BY name ORDER BY part DESC, span_id) AS w FROM q)
SELECT name, count(*) AS n, min(part) AS min, round(avg(part), 4) AS mean, max(part) AS max, max(CASE WHEN i = least(floor(c * 0.95), c - 1) THEN part END) AS p95, sum(part)::BIGINT AS total, max(CASE WHEN w = 1 THEN span_id END) AS worst FROM r GROUP BY name""")
def span_statistics(t: Tables):
    return traces.span_statistics(spans(t), *selected(t))


@query(f"""
WITH h AS (SELECT duration FROM {TICKS}, {EDGES} WHERE start + duration > lo AND start < hi), r AS (SELECT *, row_number() OVER (ORDER BY duration) - 1 AS i, count(*) OVER () AS c FROM h)
SELECT count(*) AS n, min(duration) AS min, round(avg(duration), 4) AS mean, max(duration) AS max, max(CASE WHEN i = least(floor(c * 0.95), c - 1) THEN duration END) AS p95 FROM r""")
def tick_statistics(t: Tables):
    return traces.tick_statistics(traces.per_tick(spans(t)), *selected(t))


@query(f"SELECT system, count(*) AS n, sum(part)::BIGINT AS total FROM (SELECT system, {PART} AS part FROM {SPANS}, {EDGES}) WHERE part > 0 GROUP BY system ORDER BY total DESC, system LIMIT 5")
def top_systems(t: Tables):
    return traces.top_systems(spans(t), *selected(t))


@query(f"SELECT name, n, total FROM (SELECT name, count(*) AS n, sum(dur)::BIGINT AS total, max(dur) AS m FROM {SPANS} GROUP BY name) ORDER BY m DESC, name LIMIT 20")
def top_spans(t: Tables):
    return traces.top_spans(spans(t)).select("name", "n", "total")


@query(f"SELECT count(part) AS n, coalesce(sum(part), 0)::BIGINT AS total FROM (SELECT CASE WHEN {PART} > 0 THEN {PART} END AS part FROM {SPANS}, {EDGES} WHERE name = 'purchase')")
def pause_total(t: Tables):
    return traces.pause_total(spans(t).where("name = 'purchase'"), *selected(t))


@query(f"SELECT system, span_id, dur, dur - lag(dur) OVER (PARTITION BY system ORDER BY span_id) AS change FROM {SPANS}")
def gauge_series(t: Tables):
    return traces.gauge_series(spans(t), "system", "span_id", "dur")


@query(f"""
WITH g AS (SELECT * FROM {SPANS} WHERE system < 6), c AS (SELECT CASE system WHEN 4 THEN 0 ELSE 1 END AS system, max_by(dur, span_id) AS capacity FROM g WHERE system IN (4, 5) AND dur > 0 GROUP BY 1)
SELECT g.system, g.span_id, g.dur, c.capacity FROM g LEFT JOIN c USING (system) WHERE system NOT IN (4, 5)""")
def gauge_capacities(t: Tables):
    """Gauges 4 and 5 tell the capacities of 0 and 1: their last values, beside the series of the others."""
    g = spans(t).where("system < 6").select("system", "span_id", "dur")
    series, capacities = traces.split_capacities(g, "system", "span_id", "dur", {4: 0, 5: 1})
    return series.join(capacities, "system", "left")


@query(f"SELECT (system % 4)::INTEGER AS tier, count(*) AS n, sum(dur)::BIGINT AS cost FROM {SPANS} GROUP BY 1")
def tier_budget(t: Tables):
    return traces.tier_budget(spans(t), F.col("system") % 4)


@query(f"SELECT tick, duration, events FROM {TICKS} ORDER BY tick DESC LIMIT 32")
def telemetry_ring(t: Tables):
    return traces.last_ticks(traces.per_tick(spans(t)), 32).select("tick", "duration", "events")


@query(f"SELECT tick, start, start - lag(start) OVER (ORDER BY tick) AS interval_us FROM {TICKS}")
def tick_interval(t: Tables):
    """Time since the tick before."""
    return traces.intervals(traces.per_tick(spans(t)).select("tick", "start"))


@query(f"SELECT e.span_id, max(m.tick)::INTEGER AS tick FROM {SPANS} e LEFT JOIN (SELECT 0 AS tick, -1::BIGINT AS ts UNION ALL SELECT (row_number() OVER (ORDER BY ts))::INTEGER, ts FROM (SELECT DISTINCT ts FROM {SPANS} WHERE span_id % 97 = 5)) m ON m.ts <= e.ts GROUP BY e.span_id")
def tick_assignment(t: Tables):
    """Which tick each event falls in: an as-of join with the ticks' starts."""
    e = spans(t)
    starts = traces.number_starts(e.where("span_id % 97 = 5"))
    return traces.assign_ticks(e.drop("tick"), starts).select("span_id", "tick")


@query(f"SELECT k.span_id, coalesce(c.dur, k.dur) AS dur, c.dur IS NOT NULL AS folded FROM (SELECT * FROM {SPANS} WHERE span_id % 2 = 0) k LEFT JOIN (SELECT span_id - 1 AS span_id, dur FROM {SPANS} WHERE span_id % 2 = 1 AND span_id % 3 = 0) c ON k.span_id = c.span_id")
def span_fold(t: Tables):
    e = spans(t)
    return traces.fold_spans(e.where("span_id % 2 = 0"), e.where("span_id % 2 = 1 and span_id % 3 = 0").withColumn("span_id", F.col("span_id") - 1)).select("span_id", "dur", "folded")


@query(f"SELECT (tick // 256)::INTEGER AS chunk, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS events FROM {SPANS} GROUP BY 1")
def trace_chunks(t: Tables):
    return chunk_manifest(spans(t))


@query("SELECT p_partkey AS key, 4 AS archetype, (p_partkey * 4096 + 4)::BIGINT AS id FROM part")
def entity_ids(t: Tables):
    x = t.part.select(s.entity_id("p_partkey", 4).alias("id"))
    return x.select(s.entity_key("id").alias("key"), s.archetype_of("id").alias("archetype"), "id")


@query("SELECT event_id, (epoch_us(ts) * 10) >> 10 AS packed, (((epoch_us(ts) * 10) >> 10) << 10) + 621355968000000000 AS ticks, epoch_us(ts) - ((((epoch_us(ts) * 10) >> 10) << 10) // 10) BETWEEN 0 AND 103 AS near, ((event_id * 1000 * 10) >> 10) AS span FROM events")
def packed_times(t: Tables):
    ts = F.col("ts").cast("timestamp")
    p = s.pack_time(ts)
    return t.events.select("event_id", p.alias("packed"), s.to_ticks(p).alias("ticks"), (F.unix_micros(ts) - F.unix_micros(s.unpack_time(p))).between(0, 103).alias("near"), s.pack_span(F.col("event_id") * 1000, 32).alias("span"))


@query("SELECT o_orderkey, 'sl:' || o_orderkey AS as_long, 'st:' || o_orderstatus AS as_text, CASE WHEN o_totalprice > 100000 THEN 'bo:1' ELSE 'bo:0' END AS as_bool, o_orderkey AS back, 'String' AS kind, NULL::BIGINT AS wrong FROM orders")
def variants(t: Tables):
    x = t.orders.select("o_orderkey", s.variant("o_orderkey", "Long").alias("as_long"), s.variant("o_orderstatus", "String").alias("as_text"), s.variant(F.col("o_totalprice") > 100000, "Boolean").alias("as_bool"))
    return x.withColumn("back", s.variant_as("as_long", "Long")).withColumn("kind", s.variant_type("as_text")).withColumn("wrong", s.variant_as("as_text", "Long"))


@query("SELECT p_partkey, left(p_name || p_type || p_brand || p_name || p_type, 63) AS cut FROM part")
def fixed_text(t: Tables):
    return t.part.select("p_partkey", s.fixed_text(F.concat("p_name", "p_type", "p_brand", "p_name", "p_type")).alias("cut"))


OLD = assign_ids(Component("Price", (Field("key", "Long"), Field("amount", "Float"), Field("size", "Int", index="multi"), Field("gone", "String64"))))
NEW = Component("Price", (Field("key", "Long"), Field("price", "Double", previous_name="amount"), Field("size", "Long"), Field("extra", "Int", index="unique")), revision=2)

LAST = Component("Price", tuple(f for f in assign_ids(NEW, OLD).fields if f.name != "extra"), revision=3)


@query("SELECT p_partkey AS key, p_retailprice::FLOAT::DOUBLE AS price, p_size::BIGINT AS size, 5 AS extra FROM part")
def schema_evolution(t: Tables):
    """Renamed, widened, dropped and added fields in one projection."""
    old = t.part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").cast("float").alias("amount"), F.col("p_size").alias("size"), F.col("p_name").alias("gone"))
    return evolve(old, OLD, NEW, {"extra": 5})


@query(
    "SELECT * FROM (VALUES ('Renamed', 'price', 1, 'InformationOnly', 'amount', 'price'), ('TypeWidened', 'price', 1, 'CompatibleWidening', 'Float', 'Double'), ('SizeChanged', 'price', 1, 'Compatible', '4', '8'), "
    "('OffsetChanged', 'size', 2, 'Compatible', '12', '16'), ('TypeWidened', 'size', 2, 'CompatibleWidening', 'Int', 'Long'), ('SizeChanged', 'size', 2, 'Compatible', '4', '8'), ('IndexRemoved', 'size', 2, 'Compatible', 'multi', NULL), "
    "('Removed', 'gone', 3, 'Compatible', 'String64', NULL), ('Added', 'extra', 4, 'Compatible', NULL, 'Int')) AS v(kind, field, field_id, level, old, \"new\")"
)
def schema_diff(t: Tables):
    return diagnostics.schema_diff(t.spark, OLD, NEW)


@query(
    "SELECT * FROM (VALUES ('Price', 1, 2, 'Renamed', 'price', 'InformationOnly'), ('Price', 1, 2, 'TypeWidened', 'price', 'CompatibleWidening'), ('Price', 1, 2, 'SizeChanged', 'price', 'Compatible'), ('Price', 1, 2, 'OffsetChanged', 'size', 'Compatible'), "
    "('Price', 1, 2, 'TypeWidened', 'size', 'CompatibleWidening'), ('Price', 1, 2, 'SizeChanged', 'size', 'Compatible'), ('Price', 1, 2, 'IndexRemoved', 'size', 'Compatible'), ('Price', 1, 2, 'Removed', 'gone', 'Compatible'), ('Price', 1, 2, 'Added', 'extra', 'Compatible'), "
    "('Price', 2, 3, 'Removed', 'extra', 'Compatible')) AS v(component, from_revision, to_revision, kind, field, level)"
)
def schema_history(t: Tables):
    """The changes of each revision against the one before."""
    return diagnostics.schema_history(t.spark, [OLD, NEW, LAST])


@query("SELECT * FROM (VALUES ('same', 'Identical', 'open'), ('widened', 'CompatibleWidening', 'project'), ('narrowed', 'Breaking', 'refuse'), ('narrowed with a migration', 'Breaking', 'migrate 2 to 4 to 5')) AS v(\"case\", level, action)")
def schema_validate(t: Tables):
    """What opening a store of one revision with another would do, told from the schemas alone."""
    narrow = Component("Price", tuple(Field(f.name, "Int" if f.name == "size" else f.type, index=f.index) for f in NEW.fields), revision=5)
    m = Migrations()
    m.register("Price", 2, 4, lambda df: df)
    m.register("Price", 4, 5, lambda df: df)
    new = assign_ids(NEW, OLD)
    cases = {"same": (OLD, OLD, None), "widened": (OLD, NEW, None), "narrowed": (new, narrow, None), "narrowed with a migration": (new, narrow, m)}
    return t.spark.createDataFrame([(name, *validate(*c)) for name, c in cases.items()], "`case` string, level string, action string")


PAIRS = "Byte>Short Byte>Int Byte>Long Short>Int Short>Long Int>Long UByte>UShort UByte>UInt UByte>ULong UShort>UInt UShort>ULong UInt>ULong UByte>Short UByte>Int UByte>Long UShort>Int UShort>Long UInt>Long Float>Double".split()
WIDE = "QuaternionF>QuaternionD Point2F>Point2D Point3F>Point3D Point4F>Point4D String64>String1024".split()


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', 'CompatibleWidening', '100{'.0' if p == 'Float>Double' else ''}')" for p in PAIRS) + ", " + ", ".join(f"('{p}', 'CompatibleWidening', '{'text' if p[0] == 'S' else '1.0,2.0,3.0,4.0'[: 4 * (2 if '2' in p else 3 if '3' in p else 4) - 1]}')" for p in WIDE) + ") AS v(pair, level, value)")
def widening_casts(t: Tables):
    """A value through every lossless widening."""
    out = None
    for pair in PAIRS + WIDE:
        a, b = pair.split(">")
        old, new = assign_ids(Component("C", (Field("v", a),))), Component("C", (Field("v", b),), revision=2)
        kind = old["v"].spark_type
        parts = [f.name for f in getattr(kind, "fields", [])]
        value = F.struct(*[F.lit(float(i + 1)).alias(n) for i, n in enumerate(parts)]) if parts else F.lit("text" if a.startswith("String") else 100)
        got = evolve(t.spark.range(1).select(value.cast(kind).alias("v")), old, new).select(F.col("v"))
        text = F.concat_ws(",", *[F.col("v")[n].cast("string") for n in parts]) if parts else F.col("v").cast("string")
        row = got.select(F.lit(pair).alias("pair"), F.lit(level(compare(old, new))).alias("level"), text.alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal * 100) END::BIGINT AS cents, CASE WHEN c_acctbal < 0 THEN 'ValueError: owes' END AS error FROM customer")
def schema_migration(t: Tables):
    """A Python migration; rows that fail keep their reason."""

    def step(row: dict) -> dict:
        if row["c_acctbal"] < 0:
            raise ValueError("owes")
        return {"c_custkey": row["c_custkey"], "cents": int(round(row["c_acctbal"] * 100))}

    return migrate_rows(t.customer.select("c_custkey", "c_acctbal"), step, "c_custkey long, cents long")


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS v FROM customer")
def migration_chain(t: Tables):
    """Revision 1 to 4 by the shortest chain of steps."""
    m = Migrations()
    m.register("V", 1, 2, lambda df: df.withColumn("v", F.col("v") * 2))
    m.register("V", 2, 4, lambda df: df.withColumn("v", F.col("v") + 1))
    m.register("V", 2, 3, lambda df: df.withColumn("v", F.col("v") * 100))
    m.register("V", 3, 4, lambda df: df)
    return m.migrate(t.customer.select("c_custkey", F.col("c_acctbal").alias("v")), "V", 1, 4)


@query("SELECT * FROM (VALUES ('Account', 1, 'balance', 'Double', 8, 'multi', NULL), ('Account', 1, 'nation', 'Int', 4, 'multi', 'Nation'), ('Nation', 1, 'key', 'Int', 4, 'unique', NULL), ('Nation', 1, 'region', 'Int', 4, 'multi', NULL)) AS v(component, revision, field, type, size, \"index\", \"references\")")
def schema_export(t: Tables):
    """The exported JSON, read again."""
    import json

    rows = [json.loads(schema_json(REGISTRY.components[c])) for c in ("Account", "Nation")]
    each = [(r["component"], r["revision"], f["name"], f["type"], f["size"], f["index"], f["references"]) for r in rows for f in r["fields"]]
    return t.spark.createDataFrame(each, "component string, revision int, field string, type string, size int, index string, references string")


@query("SELECT * FROM (VALUES ('Account', 'balance', 'Double', 'multi', NULL), ('Account', 'nation', 'Int', 'multi', 'Nation'), ('Nation', 'key', 'Int', 'unique', NULL), ('Nation', 'region', 'Int', 'multi', NULL)) AS v(component, field, type, \"index\", \"references\")")
def schema_fields(t: Tables):
    return REGISTRY.field_frame(t.spark).where(F.col("component").isin("Account", "Nation")).select("component", "field", "type", "index", "references")


@query(
    "SELECT 'Account' AS component, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) + (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS enabled "
    "UNION ALL SELECT 'Segment', count(*), count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') FROM customer UNION ALL SELECT 'Place', count(*), count(*) FROM part"
)
def store_statistics(t: Tables):
    return diagnostics.component_counts(world(t))


@query(
    "SELECT 'Party' AS archetype, 1 AS archetype_id, 'Account' AS components, 0::BIGINT AS exact, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS polymorphic UNION ALL SELECT 'Customer', 2, 'Account,Segment', count(*), count(*) FROM customer "
    "UNION ALL SELECT 'Supplier', 3, 'Account', count(*), count(*) FROM supplier UNION ALL SELECT 'Part', 4, 'Place', count(*), count(*) FROM part"
)
def list_archetypes(t: Tables):
    return diagnostics.archetypes(world(t))


@query("""SELECT (c_custkey * 4096 + 2)::BIGINT AS entity_id, 'Customer' AS archetype, 'Account' AS component, c_acctbal >= 0 AS enabled, '{"balance":' || c_acctbal || ',"nation":' || c_nationkey || '}' AS value FROM customer WHERE c_custkey = 9 UNION ALL SELECT (c_custkey * 4096 + 2)::BIGINT, 'Customer', 'Segment', c_mktsegment <> 'BUILDING', '{"segment":"' || c_mktsegment || '"}' FROM customer WHERE c_custkey = 9""")
def entity_info(t: Tables):
    return diagnostics.entity_info(world(t), 9 * 4096 + 2)


@query("SELECT '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}' AS line FROM supplier")
def format_json(t: Tables):
    return shell.as_json(t.supplier.select("s_suppkey", "s_name"))


@query("SELECT n_nationkey || ',' || n_name AS line FROM nation")
def format_csv(t: Tables):
    return shell.as_csv(t.nation.select("n_nationkey", "n_name"))


@query(f"SELECT entity_id, balance FROM ({SUPPLIERS}) WHERE entity_id NOT IN (3 * 4096 + 3, 5 * 4096 + 3) UNION ALL SELECT 3 * 4096 + 3, 12.5 UNION ALL SELECT 900000::BIGINT * 4096 + 3, 1.0")
def shell_crud(t: Tables):
    """Create, update and delete by literals, then commit."""
    sh = shell.Shell(world(t), 900_000)
    sh.create("Supplier", Account="{ balance: 1.0, nation = 2 }")
    sh.update(3 * 4096 + 3, "Account", "{balance: 12.5}")
    sh.delete(5 * 4096 + 3)
    return sh.commit().tables["Supplier"].select("entity_id", F.col("Account")["balance"].alias("balance"))
