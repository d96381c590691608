"""Driver-side rules, and properties of Column expressions against plain Python."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entityspark.functions import scalars as s
from entityspark.functions.geometry import Box
from entityspark.operators import spatial, store, views
from entityspark.plans import dnf
from entityspark.plans.overload import Overload
from entityspark.plans.schedule import ScheduleError, System, derive, order
from entityspark.schema import WIDENINGS, Archetype, Component, Field, Migrations, Registry, assign_ids, compare, level
from entityspark.sources.shell import as_table, parse_literal
from entityspark.streaming import subscriptions


def test_registry():
    r = Registry().component("A", Field("x", "Int")).component("B", Field("y", "Int", index="multi", references="A")).archetype("P", 1, "A").archetype("Q", 2, "B", parent="P").archetype("R", 3, parent="Q")
    assert r.slots("R") == ("A", "B") and r.subtree("P") == {"P", "Q", "R"} and r.having("B") == {"Q", "R"} and r.bit("Q", "B") == 2
    assert r.check_reference("B", "y", "A").name == "y"
    for bad in (lambda: r.archetype("P", 9), lambda: r.archetype("S", 3), lambda: r.archetype("S", 4096), lambda: r.archetype("S", 5, "A", parent="P"), lambda: r.check_reference("B", "y", "B")):
        with pytest.raises(ValueError):
            bad()
    assert isinstance(r.archetypes["P"], Archetype)


def test_field_ids_and_changes():
    old = assign_ids(Component("C", (Field("a", "Int"), Field("b", "Float"), Field("c", "Long", index="unique"))))
    new = Component("C", (Field("z", "Short"), Field("a", "Long"), Field("bb", "Double", previous_name="b"), Field("c", "Int", index="multi")))
    kinds = {(c.kind, c.field) for c in compare(old, new)}
    assert {("Added", "z"), ("TypeWidened", "a"), ("Renamed", "bb"), ("TypeWidened", "bb"), ("TypeChanged", "c"), ("IndexTypeChanged", "c")} <= kinds
    assert level(compare(old, new)) == "Breaking" and level([]) == "Identical" and level(compare(old, old)) == "Identical"
    assert [f.id for f in assign_ids(new, old).fields] == [3, 0, 1, 2]
    with pytest.raises(ValueError):
        assign_ids(Component("C", (Field("q", "Int", id=1),)), old)
    assert len(WIDENINGS) == 24


def test_migration_paths():
    m = Migrations()
    for a, b in ((1, 2), (2, 3), (3, 4), (1, 3)):
        m.register("C", a, b, lambda df: df)
    assert m.path("C", 1, 4) == [1, 3, 4] and m.path("C", 4, 1) is None and m.path("C", 2, 2) == [2]


# Normal form: the value of a predicate equals the value of its branches, and of its negation the opposite.
leaf = st.tuples(st.sampled_from("ab"), st.sampled_from(sorted(dnf.INVERT)), st.integers(0, 3))
tree = st.recursive(leaf, lambda t: st.one_of(st.tuples(st.just("and"), t, t), st.tuples(st.just("or"), t, t), st.tuples(st.just("not"), t)), max_leaves=6)
OPS = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def build(t):
    if t[0] == "and":
        return build(t[1]) & build(t[2])
    if t[0] == "or":
        return build(t[1]) | build(t[2])
    if t[0] == "not":
        return ~build(t[1])
    return dnf.FieldRef("", t[0])._cmp(t[1], t[2])


def truth(t, row):
    if t[0] in ("and", "or"):
        return (all if t[0] == "and" else any)(truth(x, row) for x in t[1:])
    if t[0] == "not":
        return not truth(t[1], row)
    return OPS[t[1]](row[t[0]], t[2])


@settings(max_examples=200, deadline=None)
@given(tree, st.integers(0, 3), st.integers(0, 3))
def test_normal_form(t, a, b):
    row = {"a": a, "b": b}
    p = build(t)
    value = lambda p: any(all(OPS[c.op](row[c.field], c.value) for c in branch) for branch in p.branches())
    assert value(p) == truth(t, row) and value(~p) != truth(t, row)


def test_branch_limit():
    p = dnf.field("a") == 0
    for k in range(16):
        p = p | (dnf.field("a") == k)
    with pytest.raises(ValueError):
        dnf.branch_bitmap(p)


def test_estimates():
    st_ = dnf.FieldStatistics(0.0, 100.0, 1000, (100,) * 10, {5: 70})
    assert st_.estimate("==", 5) == 70 and st_.estimate("!=", 5) == 930 and st_.estimate(">", 50) == 500 and st_.estimate("<=", 25) == 250 and st_.range(60, 50) == 0
    first = dnf.by_selectivity([dnf.field("x") > 10, dnf.field("x") > 90], {"x": st_})[0]
    assert first[0].value == 90 and first[1] == 100


def test_overload_counters_hold():
    o = Overload()
    for _ in range(4):
        o.update(1.5)
    for _ in range(50):
        o.update(1.0)  # between the thresholds
    assert o.level == 0 and o.update(1.5) and o.level == 1
    q = Overload()
    for k in range(10):
        q.update(1.0, k)
    assert q.level == 1  # five ticks of growth start to count as overrun


def test_schedule_errors():
    x = frozenset(["X"])
    for systems in ([System("a"), System("a")], [System("a", after=("zz",))], [System("a", writes_resource=x), System("b", writes_resource=x)], [System("a", phase="none")]):
        with pytest.raises(ScheduleError):
            order(derive(systems, ["update"]))
    assert order(derive([System("b", phase="late"), System("a", phase="early")], ["early", "late"])) == [["a"], ["b"]]


def test_frames_and_literals():
    data = subscriptions.frame_bytes(1, [{"a": 1}]) + subscriptions.frame_bytes(2, [])
    assert [m["tick"] for m in subscriptions.read_frames(data)] == [1, 2]
    assert parse_literal('{ A: 1, B = -2.5, C: "x, }", d: true }') == {"A": 1, "B": -2.5, "C": "x, }", "d": True}
    for bad in ("A: 1", "{ A 1 }"):
        with pytest.raises(ValueError):
            parse_literal(bad)
    assert subscriptions.transition({"a", "b"}, {"b", "c"}) == ({"c"}, {"a"})


def test_output_table(spark):
    assert as_table(spark.createDataFrame([(1, None), (22, "x")], "a int, b string")).splitlines() == ["a  | b", "---+--", "1  |", "22 | x"]


def test_scalars(spark):
    rows = [(i, j) for i, j in ((0, 0), (1, 2), (65535, 65535), (12345, 54321), (65535, 0))]
    got = spark.createDataFrame(rows, "x int, y int").select("x", "y", s.morton("x", "y").alias("k")).withColumn("x2", s.morton_x("k")).withColumn("y2", s.morton_y("k")).collect()
    for r in got:
        assert (r["x2"], r["y2"]) == (r["x"], r["y"])
        assert r["k"] == sum((r["x"] >> i & 1) << 2 * i | (r["y"] >> i & 1) << 2 * i + 1 for i in range(16))
    texts = ["a" * 100, "é" * 40, "😀" * 20, "", None, "a" * 63, "a" * 61 + "😀"]
    cut = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(s.fixed_text("t")).collect()]
    want = [t if t is None else t.encode()[: 63 if len(t.encode()) >= 64 else None].decode(errors="ignore") for t in texts]
    assert cut == want
    v = spark.createDataFrame([("si:12",), ("bo:1",), ("st:si:3",), ("xx",), (None,), ("sb:300",)], "v string").select(s.variant_type("v").alias("t"), s.variant_as("v", "Int").alias("i"), s.variant_as("v", "Byte").alias("b"), s.variant_as("v", "String").alias("s")).collect()
    assert [tuple(r) for r in v] == [("Int", 12, None, None), ("Boolean", None, None, None), ("String", None, None, "si:3"), (None, None, None, None), (None, None, None, None), ("Byte", None, None, None)]
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("nan"),)], "x double").select(s.cell_index("x", 0.0, 1.0, 4)).collect()


def boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(-50, 1050), rng.uniform(-50, 1050)
        out.append((i, x, y, x + rng.choice([0, 5, 200]), y + rng.choice([0, 9, 120])))
    return out


def test_overlap_join(spark):
    a, b = boxes(120, 1), boxes(80, 2)
    grid = spatial.Grid(0.0, 0.0, 64.0, 16, 16)
    da = spark.createDataFrame(a, "i int, ax0 double, ay0 double, ax1 double, ay1 double")
    db = spark.createDataFrame(b, "j int, bx0 double, by0 double, bx1 double, by1 double")
    got = spatial.overlap_join(da, db, grid, Box.of("ax0", "ay0", "ax1", "ay1"), Box.of("bx0", "by0", "bx1", "by1"), "i", "j").collect()
    want = {(j[0], i[0]) for i in a for j in b if i[1] <= j[3] and j[1] <= i[3] and i[2] <= j[4] and j[2] <= i[4]}
    assert sorted((r["j"], r["i"]) for r in got) == sorted(want)


def test_nearest_each(spark):
    from entityspark.operators.checkpoints import ensure

    ensure(spark)
    points, probes = boxes(150, 3), boxes(12, 4)
    grid = spatial.Grid(0.0, 0.0, 64.0, 16, 16)
    dp = spark.createDataFrame([(i, x, y) for i, x, y, *_ in points], "i int, x double, y double")
    dq = spark.createDataFrame([(i, x, y) for i, x, y, *_ in probes], "q int, qx double, qy double")
    got = sorted((r["q"], r["rank"], r["i"]) for r in spatial.nearest_each(dp, dq, grid, "x", "y", "qx", "qy", 4, "i", "q").collect())
    want = []
    for q, qx, qy, *_ in probes:
        best = sorted(((x - qx) ** 2 + (y - qy) ** 2, i) for i, x, y, *_ in points)[:4]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(best)]
    assert got == sorted(want)


def test_rays(spark):
    rows = boxes(60, 5)
    df = spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double")
    b = Box.of("x0", "y0", "x1", "y1")
    for origin, direction in (((0.0, 0.0), (1.0, 1.0)), ((300.0, -100.0), (0.0, 1.0)), ((float("nan"), 0.0), (1.0, 0.0))):
        got = {r["i"]: r["e"] for r in df.select("i", b.ray_entry(origin, direction).alias("e")).collect()}
        for i, x0, y0, x1, y1 in rows:
            near, far = -math.inf, math.inf
            for o, d, lo, hi in ((origin[0], direction[0], x0, x1), (origin[1], direction[1], y0, y1)):
                if d:
                    near, far = max(near, min((lo - o) / d, (hi - o) / d)), min(far, max((lo - o) / d, (hi - o) / d))
                elif not lo < o < hi:
                    near = math.inf
            hit = near <= far and far >= 0 and not math.isnan(origin[0])
            assert (got[i] is not None) == hit and (not hit or abs(got[i] - max(near, 0)) < 1e-9)


def test_compaction(spark):
    """Against a replay of what each run of changes does to a set."""
    rng = random.Random(7)
    rows, want = [], {}
    for key in range(200):
        was = inside = rng.random() < 0.5
        modified = False
        for k in range(rng.randrange(1, 5)):
            kind = rng.choice(["Removed", "Modified"]) if inside else "Added"
            rows.append((key, k, kind))
            inside, modified = kind != "Removed", True
        if was or inside:
            want[key] = "Modified" if was and inside and modified else "Added" if inside else "Removed"
    got = views.compact(spark.createDataFrame(rows, "key int, at int, kind string"), "key", "at").collect()
    assert {r["key"]: r["kind"] for r in got} == want


def test_incremental_equals_full(spark):
    rng = random.Random(9)
    state = {k: rng.randrange(100) for k in range(300)}
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "entity_id int, v int")
    view = views.View("entity_id", lambda df: df.where("v > 40"))
    view.refresh(frame(state))
    for _ in range(3):
        changed = {}
        for k in rng.sample(range(330), 40):
            changed[k] = None if rng.random() < 0.3 else rng.randrange(100)
        rows = [(k, v or 0, "delete" if v is None else "write") for k, v in changed.items()]
        view.apply(spark.createDataFrame(rows, "entity_id int, v int, op string"))
        state = {k: v for k, v in {**state, **changed}.items() if v is not None}
        assert {r[0] for r in view.members.collect()} == {k for k, v in state.items() if v > 40}
    assert view.count() == sum(v > 40 for v in state.values()) and view.contains(next(k for k, v in state.items() if v > 40))
    view.clear_delta()
    assert view.delta is None


def test_cascade_cycle_and_depth(spark):
    from entityspark.operators.checkpoints import ensure

    ensure(spark)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 9)], "id long, parent long")
    roots = spark.createDataFrame([(3,)], "id long")
    assert sorted(tuple(r) for r in store.cascade(roots, [(links, "id", "parent")]).collect()) == [(1, 2), (2, 1), (3, 0), (4, 1)]
    with pytest.raises(ValueError):
        store.cascade(roots, [(links, "id", "parent")], depth=1)
    with pytest.raises(ValueError):
        store.cascade(roots, [(links, "id", "parent")], most=2)


def test_commit_without_conflict(spark):
    rows = spark.createDataFrame([(1, 5.0)], "k int, v double")
    new = spark.createDataFrame([(1, 6.0), (2, 7.0)], "k int, v double")
    got = {r["k"]: (r["v"], r["conflict"]) for r in store.merge_conflicts(rows, rows, new, ["k"], ["v"]).collect()}
    assert got == {1: (6.0, False), 2: (7.0, False)}
    assert store.snapshot(spark.createDataFrame([(0, 0), (5, 0), (5, 9), (12, 0)], "born int, died int"), 9).count() == 2


def test_round_trips(spark, tmp_path):
    from entityspark.operators.entities import World
    from entityspark.sources import tables

    e = spark.range(1000).select(F.col("id").alias("ts"), F.lit(1).cast("long").alias("dur"), F.lit("n").alias("name"), F.lit(0).alias("system"), F.col("id").alias("span_id"), (F.col("id") / 2).cast("int").alias("tick"))
    tables.write_trace(e, f"{tmp_path}/t", 100)
    back = tables.read_trace(spark, f"{tmp_path}/t", 120, 130, 100)
    assert back.count() == 22 and back.columns == e.columns
    r = Registry().component("A", Field("x", "Int")).archetype("P", 1, "A").archetype("Q", 2, parent="P")
    w = World(r, {"P": spark.createDataFrame([(4097, 1, (5,))], "entity_id long, enabled int, A struct<x:int>")})
    tables.save_world(w, f"{tmp_path}/w", {"P": "entity_id"})
    again = tables.load_world(spark, r, f"{tmp_path}/w")
    assert again.query("P").where_field(dnf.field("A.x") == 5).count() == 1 and again.query("P").any() and [x["entity_id"] for x in again.query("P")] == [4097]
    for fmt in ("orc", "json", "csv"):
        tables.write(e, f"{tmp_path}/{fmt}", fmt)
        assert tables.read(spark, f"{tmp_path}/{fmt}", fmt, tables.TRACE).count() == 1000
    with pytest.raises(ValueError):
        again.query("P").take(5)


def test_stream_ticks(spark, tmp_path):
    """Two files are two ticks; the runtime sees each batch as its changes, and the sink keeps a folder for each."""
    from entityspark.streaming import live, ticks

    for k in range(2):
        spark.createDataFrame([(k * 10 + i, "A") for i in range(3)], "entity_id long, component string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    view = spark.range(100).withColumnRenamed("id", "entity_id")
    rt = ticks.Runtime([System("s", lambda ctx: seen.append(sorted(r[0] for r in ctx.input.collect())), kind="query", view=lambda s: view, changed=frozenset(["A"]))])
    with pytest.raises(ValueError):
        ticks.Runtime([System("s", changed=frozenset(["A"]))], modes={"A": "versioned"})
    stream = live.change_stream(spark, f"{tmp_path}/in/*", "entity_id long, component string")
    q = stream.writeStream.foreachBatch(rt.each_batch({})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [[0, 1, 2], [10, 11, 12]] and rt.tick == 2
    subscriptions.sink(f"{tmp_path}/out", "v")(view, 3)
    assert spark.read.parquet(f"{tmp_path}/out").where("tick = 3").count() == 100


def test_ranks_of_many_rows(spark):
    """2,000,000 rows over many ranges: dense ids, full batches, right ticks and positions."""
    from pyspark.sql import functions as F

    from entityspark.operators import ranges, store, traces
    from entityspark.streaming import subscriptions

    n, old = 2_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = spark.range(n, numPartitions=23).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) * n + F.col("id")).alias("k"), F.concat(F.lit("wide " * 8), F.col("id").cast("string")).alias("name"))
        made = store.spawn(rows, 3, 1000, ["k"], 7)
        assert made.select(F.count_distinct("entity_id"), F.min("entity_id"), F.max("entity_id")).first() == (n, 1000 * 4096 + 3, (1000 + n - 1) * 4096 + 3)
        sync = subscriptions.initial_sync(rows, "k", 1000).groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("batch").collect()
        assert len(sync) == n // 1000 and all(r["n"] == 1000 for r in sync) and all(a["high"] < b["low"] for a, b in zip(sync, sync[1:]))
        events = spark.range(n, numPartitions=23).select(F.col("id").alias("ts"), F.lit("x" * 40).alias("name"))
        starts = spark.range(0, n, 1009).select(F.col("id").alias("ts"), (F.col("id") / 1009 + 1).cast("int").alias("tick"))
        got = traces.assign_ticks(events, starts)
        assert got.count() == n and got.where(F.col("tick") != F.floor(F.col("ts") / 1009) + 1).count() == 0
        lag = ranges.lagged(events, "ts", "ts", "before")
        assert lag.where(F.col("before") == F.col("ts") - 1).count() == n - 1
        p = ranges.nth(events.select(F.pmod("ts", F.lit(1_500_000)).alias("v")), "v", 0.95, [])
        v = sorted([*range(1_500_000), *range(500_000)])
        assert [r["p"] for r in p.collect()] == [v[int(0.95 * n)]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_nth_of_groups(spark):
    from entityspark.operators import traces

    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([1, 1, 1, 2, 5, 9, 30])) for _ in range(500)] + [("d", 4), (None, 3)]
    df = spark.createDataFrame(rows, "name string, part int")
    got = {r["name"]: r["p"] for r in traces.nth_of("part", 0.95, ["name"], df).collect() if r["name"] is not None}
    for name in "abcd":
        v = sorted(x for m, x in rows if m == name)
        assert got[name] == v[min(int(0.95 * len(v)), len(v) - 1)]


def test_ties_are_settled(spark):
    from entityspark.operators import store, views

    rows = [(1, 5, True, "b", 2), (1, 5, True, "a", 9), (1, 4, True, "z", 1), (2, 1, False, "q", 0), (2, 1, True, "p", 0)]
    df = spark.createDataFrame(rows, "id int, tsn int, active boolean, name string, n int")
    for parts in (1, 3):
        got = sorted(tuple(r) for r in store.latest(df.repartition(parts), ["id"]).select("id", "name", "n").collect())
        assert got == [(1, "b", 2), (2, "p", 0)]
    d = spark.createDataFrame([(1, 7, "Removed"), (1, 7, "Added"), (2, 3, "Modified"), (2, 3, "Removed")], "id int, at int, kind string")
    for parts in (1, 4):
        assert sorted(tuple(r) for r in views.compact(d.repartition(parts), "id", "at").collect()) == [(2, "Removed")]


def test_long_variants_and_great_numbers(spark):
    from pyspark.sql import functions as F

    from entityspark.functions import scalars
    from entityspark.operators import statistics

    text = "x" * ((1 << 20) + 77)
    df = spark.createDataFrame([(text,)], "t string").select(scalars.variant("t", "String").alias("v"))
    assert df.select(F.length(scalars.variant_as("v", "String")).alias("n")).first()["n"] == len(text)
    big = spark.createDataFrame([(2**53, 0.5), (2**53 + 1, 0.5), (2**53 + 1, None)], "a long, b double")
    made = statistics.rebuild(big, ["a", "b"])
    got = {r["field"]: (r["n"], r["n_distinct"], r["commonest_n"]) for r in made.summary.collect()}
    assert got == {"a": (3, 2, 2), "b": (2, 1, 2)}


def test_sampled_statistics(spark):
    from entityspark.operators import statistics

    df = spark.range(60_000).selectExpr("id % 7 as a", "id / 10.0 as b")
    keeper = statistics.Keeper()
    keeper.note("t", 1000)
    assert keeper.poll({"t": (lambda: df, ["a", "b"])}) == ["t"] and keeper.poll({"t": (lambda: df, ["a", "b"])}) == []
    made = keeper.known["t"]
    for r in made.summary.collect():
        assert abs(r["n"] - 60_000) < 3000
    common = made.common.where("field = 'a'").collect()
    assert len(common) == 7 and all(abs(r["n"] - 60_000 / 7) < 1200 for r in common)


def test_buffer(spark):
    from entityspark.operators import views

    rows = lambda xs: spark.createDataFrame(xs, "id long, x int, op string")
    state = rows([(1, 5, "write"), (2, 50, "write")])
    v = views.View("id", lambda df: df.where("x > 10"))
    v.refresh(state)
    b = views.DeltaBuffer(v, capacity=3)
    assert b.flush(state).count() == 0
    b.push(rows([(1, 20, "write")]))
    b.push(rows([(1, 5, "write"), (2, 60, "write")]))
    now = rows([(1, 5, "write"), (2, 60, "write")])
    assert sorted(tuple(r) for r in b.flush(now).collect()) == [(2, "Modified")]
    b.push(rows([(1, 20, "write"), (3, 20, "write"), (4, 20, "write"), (5, 20, "write")]))
    assert b.overflowed
    now = rows([(1, 20, "write"), (2, 60, "write"), (3, 20, "write"), (4, 20, "write"), (5, 20, "write")])
    assert sorted(tuple(r) for r in b.flush(now).collect()) == [(1, "Added"), (3, "Added"), (4, "Added"), (5, "Added")] and not b.overflowed


def test_late_rows_and_sliding_windows(spark, tmp_path):
    from entityspark.streaming import live

    schema = "ts timestamp, name string, value double"
    rows = lambda xs: spark.createDataFrame(xs, "ts string, name string, value double").selectExpr("cast(ts as timestamp) as ts", "name", "value")
    day = "2024-01-01 "
    for batch in ([(day + "00:10:00", "a", 1.0), (day + "00:20:00", "a", 2.0)], [(day + "09:00:00", "a", 3.0)], [(day + "09:05:00", "a", 0.0)], [(day + "00:30:00", "a", 99.0), (day + "09:10:00", "a", 4.0)], [(day + "23:00:00", "a", 5.0)]):
        rows(batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.tumbling(live.change_stream(spark, f"{tmp_path}/in", schema), "ts", "1 hour", ["name"], late="2 hours")
    got = {r["start"].hour: (r["n"], r["total"]) for r in live.drain(stream, f"{tmp_path}/out").collect()}
    assert got[0] == (2, 3.0) and got[9] == (3, 7.0)  # the row of 00:30 came after its window had closed
    slid = live.tumbling(rows([(day + "01:10:00", "a", 1.0)]), "ts", "1 hour", ["name"], slide="30 minutes").collect()
    assert sorted((r["start"].hour, r["start"].minute, r["n"]) for r in slid) == [(0, 30, 1), (1, 0, 1)]
