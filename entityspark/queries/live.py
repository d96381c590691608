"""Views, change logs, ticks, schedules, subscriptions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkpoints, views
from ..operators.entities import Navigation
from ..plans.dnf import field
from ..plans.overload import LEVELS, Overload
from ..plans.schedule import Priority, ScheduleError, Skip, System, derive, order, skip_reason, skip_subscription
from ..streaming import live, subscriptions, ticks
from .register import Tables, query

#: A state after changes: every seventh price up by half, every 50th order gone, and new orders.
AFTER = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 1.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 50 <> 0 UNION ALL SELECT o_orderkey + 90000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 40 = 0)"
BEFORE = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"


def before(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


def after(t: Tables):
    o = before(t)
    up = o.where("o_orderkey % 50 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice")))
    return up.union(o.where("o_orderkey % 40 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 90_000_000))


def changes(t: Tables):
    """Only what changed, with the operation."""
    new = after(t).where("o_orderkey % 7 = 0 or o_orderkey >= 90000000").withColumn("op", F.lit("write"))
    return new.unionByName(before(t).where("o_orderkey % 50 = 0").withColumn("op", F.lit("delete")))


DIFF = """
WITH a AS (SELECT o_orderkey FROM {b} WHERE o_totalprice > 100000), b AS (SELECT o_orderkey FROM {a} WHERE o_totalprice > 100000)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'Added' ELSE 'Removed' END AS kind FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL""".format(a=AFTER, b=BEFORE)


@query(DIFF)
def pull_view(t: Tables):
    """Query again and compare."""
    v = views.View("o_orderkey", lambda rows: rows.where("o_totalprice > 100000"))
    v.refresh(before(t))
    return v.refresh(after(t))


CHANGED = f"""
WITH c AS (SELECT o_orderkey, o_totalprice, FALSE AS gone FROM {AFTER} WHERE o_orderkey % 7 = 0 OR o_orderkey >= 90000000 UNION ALL SELECT o_orderkey, NULL, TRUE FROM orders WHERE o_orderkey % 50 = 0),
x AS (SELECT c.o_orderkey, coalesce(b.o_totalprice > 100000, FALSE) AS was, NOT gone AND c.o_totalprice > 100000 AS now FROM c LEFT JOIN {BEFORE} b ON b.o_orderkey = c.o_orderkey)
SELECT o_orderkey, CASE WHEN was AND now THEN 'Modified' WHEN now THEN 'Added' ELSE 'Removed' END AS kind FROM x WHERE was OR now"""


@query(CHANGED)
def incremental_view(t: Tables):
    """The same view from the changed rows alone."""
    v = views.View("o_orderkey", lambda rows: rows.where("o_totalprice > 100000"))
    v.refresh(before(t))
    return v.apply(changes(t))


@query(CHANGED)
def boundary_crossings(t: Tables):
    """A change feed with both images against the view's condition."""
    feed = changes(t).join(before(t).select("o_orderkey", F.col("o_totalprice").alias("old")), "o_orderkey", "left")
    return views.crossings(feed, "o_orderkey", F.col("old") > 100000, (F.col("op") == "write") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "kind")


OR_BITS = "(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END + CASE WHEN o_custkey < 300 THEN 2 ELSE 0 END)"


OR_SQL = f"""
WITH a AS (SELECT o_orderkey, {OR_BITS} AS m FROM {BEFORE} WHERE {OR_BITS} <> 0), b AS (SELECT o_orderkey, {OR_BITS} AS m FROM {AFTER} WHERE {OR_BITS} <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.m IS NULL THEN 'Added' WHEN b.m IS NULL THEN 'Removed' ELSE 'Modified' END AS kind FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.m IS NULL OR b.m IS NULL OR a.m <> b.m"""


@query(OR_SQL)
def or_view(t: Tables):
    """A view over an OR keeps which branches hold; a change of branch is a modification."""
    v = views.View("o_orderkey", (field("o_totalprice") > 100000) | (field("o_custkey") < 300))
    v.refresh(before(t))
    return v.refresh(after(t))


@query(OR_SQL)
def or_view_incremental(t: Tables):
    """The same from the changed rows alone: the bits of a changed entity before and after decide."""
    v = views.View("o_orderkey", (field("o_totalprice") > 100000) | (field("o_custkey") < 300))
    v.refresh(before(t))
    return v.apply(changes(t))


@query(DIFF)
def view_overflow(t: Tables):
    """More changes than a view's buffer holds: they are dropped, and the flush queries again."""
    v = views.View("o_orderkey", lambda rows: rows.where("o_totalprice > 100000"))
    v.refresh(before(t))
    buffer = views.DeltaBuffer(v, capacity=100)
    buffer.push(changes(t))
    return buffer.flush(after(t))


@query(CHANGED)
def view_buffer(t: Tables):
    """Two pushes within the buffer give the net change of both."""
    v = views.View("o_orderkey", lambda rows: rows.where("o_totalprice > 100000"))
    v.refresh(before(t))
    buffer = views.DeltaBuffer(v, capacity=1 << 30)
    c = changes(t)
    buffer.push(c.where("o_orderkey % 2 = 0"))
    buffer.push(c.where("o_orderkey % 2 = 1"))
    return buffer.flush(after(t))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0 UNION SELECT o_orderkey FROM orders WHERE o_custkey <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0)")
def navigation_affected(t: Tables):
    o = t.orders
    return views.affected_sources(o.where("o_orderkey % 97 = 0"), t.customer.where("c_custkey % 13 = 0"), o, "o_orderkey", "o_custkey", "c_custkey")


@query("SELECT o_orderkey, CASE WHEN c_acctbal + 2000 > 5000 THEN 'Added' END AS kind FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 13 = 0 AND c_custkey <> 0 AND c_acctbal <= 5000 AND c_acctbal + 2000 > 5000")
def navigation_view(t: Tables):
    """A change of targets reaches the view through the affected sources only."""
    c = t.customer.select("c_custkey", "c_acctbal")
    new = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 13 == 0, F.col("c_acctbal") + 2000).otherwise(F.col("c_acctbal")))
    keys = views.affected_sources(t.orders.where("false"), c.where("c_custkey % 13 = 0"), t.orders, "o_orderkey", "o_custkey", "c_custkey")
    some = t.orders.join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")
    of = lambda target: Navigation(some, target, "o_custkey", "c_custkey").where(None, F.col("c_acctbal") > 5000).execute()
    return views.diff(of(c), of(new), "o_orderkey")


#: Runs of changes of users from the events: the first kind is Added or Modified, then what follows.
KINDS = "CASE event_type WHEN 'purchase' THEN 'Removed' WHEN 'signup' THEN 'Added' ELSE 'Modified' END"


@query(f"""
WITH d AS (SELECT user_id, event_id, {KINDS} AS kind FROM events),
n AS (SELECT user_id, arg_min(kind, event_id) AS f, arg_max(kind, event_id) AS l FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN f = 'Added' THEN 'Added' WHEN l = 'Removed' THEN 'Removed' ELSE 'Modified' END AS kind FROM n WHERE NOT (f = 'Added' AND l = 'Removed')""")
def delta_compaction(t: Tables):
    kind = F.when(F.col("event_type") == "purchase", "Removed").when(F.col("event_type") == "signup", "Added").otherwise("Modified")
    return views.compact(t.events.select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id")


LOG = f"""
SELECT o_orderkey, 'o_totalprice' AS field, o_totalprice::VARCHAR AS before, (o_totalprice * 1.5)::VARCHAR AS after, 5::BIGINT AS tsn, 'update' AS op FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 50 <> 0 AND o_totalprice <> 0
UNION ALL SELECT o_orderkey, unnest(['o_custkey', 'o_totalprice']), unnest([o_custkey::VARCHAR, o_totalprice::VARCHAR]), NULL, 5, 'delete' FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey + 90000000, unnest(['o_custkey', 'o_totalprice']), NULL, unnest([o_custkey::VARCHAR, o_totalprice::VARCHAR]), 5, 'create' FROM orders WHERE o_orderkey % 40 = 0"""


@query(LOG)
def change_log(t: Tables):
    return views.change_log(before(t), after(t), "o_orderkey", ["o_custkey", "o_totalprice"], 5)


@query(f"SELECT * FROM ({LOG}) WHERE field = 'o_custkey' OR op <> 'update'")
def view_registry(t: Tables):
    """What a view over one field must see of the log."""
    log = views.change_log(before(t), after(t), "o_orderkey", ["o_custkey", "o_totalprice"], 5)
    return views.field_changes(log, ["o_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderkey IN (SELECT event_id FROM events WHERE event_type IN ('purchase', 'click'))")
def change_filter(t: Tables):
    """The view's entities of which a component changed in the last tick."""
    log = t.events.select(F.col("event_id").alias("entity_id"), F.col("event_type").alias("component"))
    v = t.orders.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("entity_id"))
    return ticks.changed_in(v, log, ["purchase", "click"]).select(F.col("entity_id").alias("o_orderkey"))


@query("SELECT p_partkey, p_partkey % 6 AS turn FROM part WHERE p_partkey % 6 = 3")
def cell_amortisation(t: Tables):
    return ticks.cell_turn(t.part, F.col("p_partkey"), 6, 9).select("p_partkey", (F.col("p_partkey") % 6).alias("turn"))


@query("SELECT p_partkey, p_size % 2 AS phase FROM part WHERE (p_partkey + p_size) % 2 = 1")
def checkerboard(t: Tables):
    return ticks.checkerboard(t.part, "p_partkey", "p_size", 1).select("p_partkey", (F.col("p_size") % 2).alias("phase"))


@query("SELECT 'spend' AS system, 0 AS tick, 'RUN' AS outcome UNION ALL SELECT 'rank', 0, 'RUN' UNION ALL SELECT 'report', 0, 'DEPENDENCY_FAILED' UNION ALL SELECT 'seldom', 0, 'RUN' UNION ALL SELECT 'seldom', 1, 'THROTTLED' UNION ALL SELECT 'spend', 1, 'RUN' UNION ALL SELECT 'rank', 1, 'RUN' UNION ALL SELECT 'report', 1, 'DEPENDENCY_FAILED' UNION ALL SELECT 'idle', 0, 'EMPTY_INPUT' UNION ALL SELECT 'idle', 1, 'EMPTY_INPUT' UNION ALL SELECT 'never', 0, 'RUN_IF_FALSE' UNION ALL SELECT 'never', 1, 'RUN_IF_FALSE' UNION ALL SELECT 'broken', 0, 'Failed' UNION ALL SELECT 'broken', 1, 'Failed' UNION ALL SELECT 'after broken', 0, 'DEPENDENCY_FAILED' UNION ALL SELECT 'after broken', 1, 'DEPENDENCY_FAILED'")
def tick_loop(t: Tables):
    """Two ticks of a schedule: systems in order of their access, and why others were skipped; the output phase waits for
    all of update, so a failure there stops it."""

    def spend(ctx):
        return {"spent": ctx.input.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))}

    def rank(ctx):
        return {"top": ctx.state["spent"].orderBy(F.desc("total")).limit(3)}

    def broken(ctx):
        raise RuntimeError("broken")

    systems = [
        System("rank", rank, reads_fresh=frozenset(["Spent"])),
        System("spend", spend, kind="query", view=lambda s: s["orders"], writes=frozenset(["Spent"])),
        System("report", lambda ctx: {}, phase="output"),
        System("seldom", lambda ctx: {}, divisor=2),
        System("idle", lambda ctx: {}, kind="query", view=lambda s: s["orders"].where("false")),
        System("never", lambda ctx: {}, run_if=lambda ctx: False),
        System("broken", broken),
        System("after broken", lambda ctx: {}, after=("broken",)),
    ]
    rt = ticks.Runtime(systems, ["update", "output"])
    state = {"orders": t.orders}
    rt.run(state, load=0.9)
    rt.run(state, load=0.9)
    return rt.telemetry_frame(t.spark).select("system", "tick", "outcome")


@query("SELECT * FROM (VALUES ('load', 0, 'RUN'), ('check', 0, 'RUN'), ('spread', 0, 'RUN'), ('even', 0, 'RUN'), ('odd', 0, 'RUN')) AS v(system, tick, outcome)")
def system_kinds(t: Tables):
    """A compound system runs as its parts, in their order; a pipeline over cells runs one colour after the other."""
    seen = []

    def colour(ctx):
        seen.append(ctx.input.select(F.pmod(F.col("cx") + F.col("cy"), F.lit(2)).alias("c")).distinct().collect())
        return {}

    parts = [System("load", lambda ctx: {"loaded": t.part.limit(1)}, writes=frozenset(["P"])), System("check", lambda ctx: {"ok": ctx.state["loaded"]}, reads_fresh=frozenset(["P"]))]
    systems = [
        System("both", kind="compound", parts=parts),
        System("spread", colour, kind="pipeline", view=lambda s: s["cells"], checkerboard=True, after=("check",)),
    ]
    rt = ticks.Runtime(systems, ["update"])
    rt.run({"cells": t.part.select(F.col("p_partkey").alias("cx"), F.col("p_size").alias("cy"))}, load=0.5)
    done = rt.telemetry_frame(t.spark).select("system", "tick", "outcome")
    names = {0: "even", 1: "odd"}
    return done.union(t.spark.createDataFrame([(names[r[0]["c"]], 0, "RUN") for r in seen if len(r) == 1], done.schema))


@query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3)) AS v(system, layer)")
def schedule_layers(t: Tables):
    """Order from declared access: a writer before fresh readers, snapshot readers before it, phases in turn."""
    systems = [
        System("c", reads_fresh=frozenset(["X"])),
        System("b", writes=frozenset(["X"])),
        System("a", reads_snapshot=frozenset(["X"])),
        System("d", phase="output"),
    ]
    layers = order(derive(systems, ["update", "output"]))
    return t.spark.createDataFrame([(n, k) for k, names in enumerate(layers) for n in names], "system string, layer int")


@query("SELECT * FROM (VALUES ('two writers', TRUE), ('two writers in order', FALSE), ('reader beside writer', TRUE), ('exclusive beside others', TRUE), ('cycle', TRUE), ('events', FALSE)) AS v(\"case\", conflict)")
def schedule_conflicts(t: Tables):
    x = frozenset(["X"])
    cases = {
        "two writers": [System("a", writes=x), System("b", writes=x)],
        "two writers in order": [System("a", writes=x), System("b", writes=x, after=("a",))],
        "reader beside writer": [System("a", writes=x), System("b", reads=x)],
        "exclusive beside others": [System("a", exclusive=True), System("b")],
        "cycle": [System("a", after=("b",)), System("b", after=("a",))],
        "events": [System("a", produces=x), System("b", consumes=x)],
    }
    rows = []
    for name, systems in cases.items():
        try:
            order(derive(systems, ["update"]))
            rows.append((name, False))
        except ScheduleError:
            rows.append((name, True))
    return t.spark.createDataFrame(rows, "`case` string, conflict boolean")


@query("SELECT * FROM (VALUES ('LOW', 0, 10), ('LOW', 1, 0), ('LOW', 2, 0), ('NORMAL', 0, 10), ('NORMAL', 1, 4), ('NORMAL', 2, 4), ('CRITICAL', 0, 10), ('CRITICAL', 1, 10), ('CRITICAL', 2, 10)) AS v(priority, level, runs)")
def load_shedding(t: Tables):
    """How often systems of each priority run in ten ticks at each level."""
    rows = []
    for p in (Priority.LOW, Priority.NORMAL, Priority.CRITICAL):
        s = System("s", priority=p, can_shed=True, throttled_divisor=3)
        for level in (0, 1, 2):
            rows.append((p.name, level, sum(skip_reason(s, k, level, False, True, False) is Skip.RUN for k in range(10))))
    return t.spark.createDataFrame(rows, "priority string, level int, runs int")


@query("SELECT * FROM (VALUES ('LOW', 0, 12), ('LOW', 1, 6), ('LOW', 2, 3), ('NORMAL', 0, 12), ('NORMAL', 1, 12), ('NORMAL', 2, 6), ('CRITICAL', 0, 12), ('CRITICAL', 1, 12), ('CRITICAL', 2, 12)) AS v(priority, level, sent)")
def priority_throttling(t: Tables):
    rows = [(p.name, level, sum(not skip_subscription(p, level, k) for k in range(12))) for p in (Priority.LOW, Priority.NORMAL, Priority.CRITICAL) for level in (0, 1, 2)]
    return t.spark.createDataFrame(rows, "priority string, level int, sent int")


@query("SELECT * FROM (VALUES (5, 1, 1), (10, 2, 1), (15, 3, 2), (20, 3, 3), (25, 3, 4), (30, 3, 6), (35, 4, 6), (55, 3, 6), (75, 3, 4), (95, 3, 3), (115, 3, 2), (135, 2, 1), (155, 1, 1), (175, 0, 1)) AS v(after_ticks, level, multiplier)")
def overload_levels(t: Tables):
    """35 ticks of overrun, then 140 with time to spare: each step that the machine takes."""
    o, rows, was = Overload(), [], (0, 1)
    for k in range(1, 176):
        o.update(1.5 if k <= 35 else 0.3)
        if (o.level, o.multiplier) != was:
            was = (o.level, o.multiplier)
            rows.append((k, *was))
    assert len(LEVELS) == 5
    return t.spark.createDataFrame(rows, "after_ticks int, level int, multiplier int")


@query("SELECT count(*) AS n, TRUE AS full_raises FROM orders WHERE o_totalprice > 200000")
def event_queue(t: Tables):
    n = t.orders.count()
    q = ticks.EventQueue("o_orderkey long", capacity=n)
    q.push(t.orders.where("o_totalprice > 200000").select("o_orderkey"))
    got = q.drain()
    q.push(t.orders.select("o_orderkey"))
    try:
        q.push(t.orders.limit(1).select("o_orderkey"))
        full = False
    except ticks.QueueFull:
        full = True
    return got.agg(F.count("*").alias("n"), F.lit(full).alias("full_raises"))


@query("SELECT user_id, streak::INTEGER AS streak FROM (SELECT user_id, event_id, big, row_number() OVER (PARTITION BY user_id, big, s ORDER BY event_id) AS streak, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, big ORDER BY event_id) AS s FROM (SELECT *, value > 50 AS big FROM events))) WHERE last = 1")
def streaks(t: Tables):
    """How long the present run of high or low values is."""
    x = views.latest_streak(t.events, ["user_id"], "event_id", F.col("value") > 50)
    return x.groupBy("user_id").agg(F.max_by("streak", "event_id").alias("streak"))


MESSAGES = f"""
WITH d AS (SELECT * FROM ({CHANGED})), n AS (SELECT * FROM {AFTER}), b AS (SELECT * FROM {BEFORE})
SELECT d.kind AS op, d.o_orderkey, CASE WHEN d.kind = 'Added' THEN n.o_custkey END AS o_custkey, CASE WHEN d.kind = 'Added' OR (d.kind = 'Modified' AND n.o_totalprice <> b.o_totalprice) THEN n.o_totalprice END AS o_totalprice,
  CASE WHEN d.kind = 'Added' THEN 'o_custkey,o_totalprice' WHEN d.kind = 'Modified' AND n.o_totalprice <> b.o_totalprice THEN 'o_totalprice' ELSE '' END AS changed
FROM d LEFT JOIN n ON n.o_orderkey = d.o_orderkey LEFT JOIN b ON b.o_orderkey = d.o_orderkey"""


@query(MESSAGES)
def delta_messages(t: Tables):
    """Added with all components, Modified with the changed ones, Removed with none."""
    m = subscriptions.delta_message(incremental_view(t), after(t), before(t), "o_orderkey", ["o_custkey", "o_totalprice"])
    return m.withColumn("changed", F.array_join("changed", ","))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'purchase' AND user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS l FROM events GROUP BY user_id) WHERE l = 'purchase') AND event_id > coalesce((SELECT max(event_id) FROM events e WHERE e.user_id = events.user_id AND event_type = 'purchase'), -1) GROUP BY user_id")
def client_state(t: Tables):
    """A client's copy from messages: a purchase removes a user, the next other event adds the user again."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.withColumn("gone", F.col("event_type") == "purchase")
    e = e.withColumn("fresh", F.coalesce(F.lag("gone").over(w), F.lit(True)))
    op = F.when(F.col("gone"), "Removed").when(F.col("fresh"), "Added").otherwise("Modified")
    m = e.select("user_id", F.col("event_id").alias("tick"), op.alias("op"), "value", F.when(F.col("gone"), F.array().cast("array<string>")).otherwise(F.array(F.lit("value"))).alias("changed"))
    return subscriptions.materialize_client(m, "user_id", "tick", ["value"])


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::INTEGER AS batch FROM orders WHERE o_totalprice > 150000")
def initial_sync(t: Tables):
    return subscriptions.initial_sync(t.orders.where("o_totalprice > 150000"), "o_orderkey", 1000)


@query("SELECT -1 AS batch, 'Resync' AS event, NULL::BIGINT AS o_orderkey UNION ALL SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 700)::INTEGER, 'Added', o_orderkey FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT ((count(*) + 699) // 700)::INTEGER, 'SyncComplete', NULL FROM orders WHERE o_totalprice > 150000")
def resync(t: Tables):
    """A client that must start anew: what it has goes, the rows come in batches, and the end is told."""
    return subscriptions.sync_events(t.orders.where("o_totalprice > 150000"), "o_orderkey", 700, resync=True)


@query("SELECT o_orderkey, 'client ' || (o_custkey % 3) AS client FROM orders WHERE o_custkey % 3 < 2 AND o_totalprice > 200000")
def view_per_client(t: Tables):
    """One view made for each of two clients."""
    v = subscriptions.PublishedView("orders", lambda c: t.orders.where(f"o_totalprice > 200000 and o_custkey % 3 = {c}"), shared=False)
    of = lambda c: v.frame(c).select("o_orderkey", F.lit(f"client {c}").alias("client"))
    return of("0").union(of("1"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables):
    return live.tumbling(t.events, "ts", "1 hour", ["event_type"])


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - p < INTERVAL '6 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2) GROUP BY user_id")
def session_windows(t: Tables):
    x = live.sessions(t.events, "ts", "6 hours", ["user_id"])
    return x.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query(f"SELECT count(*) AS changes, count(*) FILTER (WHERE kind = 'Added') AS added, count(*) FILTER (WHERE kind = 'Removed') AS removed FROM (SELECT CASE WHEN was AND now THEN 'Modified' WHEN now THEN 'Added' WHEN was THEN 'Removed' END AS kind FROM (SELECT value > 50 AND event_type <> 'purchase' AS now, coalesce(lag(value > 50 AND event_type <> 'purchase') OVER (PARTITION BY user_id ORDER BY event_id), FALSE) AS was FROM events)) WHERE kind IS NOT NULL")
def streaming_view(t: Tables):
    """A live view over the change stream of the events: a file a micro-batch, so states are read back."""
    folder = checkpoints.path(t.spark, "stream")
    n = t.events.agg(F.max("event_id")).first()[0] or 0
    for k in range(4):  # a stream takes files in the order of their times
        t.events.where(F.floor(F.col("event_id") * 4 / (n + 1)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = live.change_stream(t.spark, f"{folder}/in", ", ".join(f"{c} {k}" for c, k in t.events.dtypes))
    rows = stream.withColumn("op", F.when(F.col("event_type") == "purchase", "delete").otherwise("write"))
    out = live.live_view(rows, "user_id", "event_id", F.col("value") > 50)
    got = live.drain(out, f"{folder}/out")
    return got.agg(F.count("*").alias("changes"), F.count(F.when(F.col("kind") == "Added", 1)).alias("added"), F.count(F.when(F.col("kind") == "Removed", 1)).alias("removed"))
