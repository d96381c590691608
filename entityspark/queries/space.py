"""Spatial queries: parts as points of their size and price, line items as boxes, nations as regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.scalars import morton, morton_x, morton_y
from ..operators import spatial
from .register import Tables, query
from .world import PARTS, place_x, place_y, world

POINT = ("x", "y", "x", "y")
GRID = spatial.Grid(0.0, 0.0, 50.0, 32, 32)
#: Regions by formula: a box for each nation.
REGIONS = "(SELECT n_nationkey AS region_id, n_nationkey * 35.0 AS rx0, n_nationkey * 37.0 AS ry0, n_nationkey * 35.0 + 120 AS rx1, n_nationkey * 37.0 + 120 AS ry1 FROM nation)"
#: Items: a part's place before and after a move.
BEFORE = "(SELECT p_partkey, p_size * 20.0::DOUBLE AS x, round((p_retailprice - 900) * 10) AS y FROM part)"
AFTER = "(SELECT p_partkey, p_size * 20.0::DOUBLE + (p_partkey % 5) * 20 AS x, round((p_retailprice - 900) * 10) + (p_partkey % 7) * 30 AS y FROM part)"
INSIDE = "x >= rx0 AND x <= rx1 AND y >= ry0 AND y <= ry1"
MORTON = " + ".join(f"((({{x}} >> {i}) & 1) << {2 * i}) + ((({{y}} >> {i}) & 1) << {2 * i + 1})" for i in range(16))


def regions(t: Tables):
    k = F.col("n_nationkey")
    return t.nation.select(k.alias("region_id"), (k * 35.0).alias("rx0"), (k * 37.0).alias("ry0"), (k * 35.0 + 120).alias("rx1"), (k * 37.0 + 120).alias("ry1"))


def places(t: Tables):
    return t.part.select("p_partkey", place_x().alias("x"), place_y().alias("y"))


def moved(t: Tables):
    return t.part.select("p_partkey", (place_x() + F.col("p_partkey") % 5 * 20).alias("x"), (place_y() + F.col("p_partkey") % 7 * 30).alias("y"))


def inside(items, t: Tables):
    return spatial.overlap_join(items, regions(t), GRID, Box.of("x", "y", "x", "y"), Box.of("rx0", "ry0", "rx1", "ry1"), "p_partkey", "region_id")


@query(f"SELECT entity_id, archetype_id FROM {PARTS} WHERE x BETWEEN 200 AND 400 AND y BETWEEN 100 AND 500")
def aabb(t: Tables):
    return world(t).query("Part").where_in_box("Place", POINT, 200, 100, 400, 500).execute()


@query(f"SELECT entity_id, archetype_id FROM {PARTS} WHERE (x - 500) * (x - 500) + (y - 600) * (y - 600) <= 10000")
def radius(t: Tables):
    return world(t).query("Part").where_near("Place", POINT, (500.0, 600.0), 100).execute()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE power(greatest(l_quantity - 2 - 25, 0, 25 - l_quantity - 2), 2) + power(greatest(l_extendedprice - 50 - 30000, 0, 30000 - l_extendedprice - 50), 2) <= 10000")
def radius_boxes(t: Tables):
    """Boxes around points; the sphere meets a box where its closest point is near enough."""
    b = Box.of(F.col("l_quantity") - 2, F.col("l_extendedprice") - 50, F.col("l_quantity") + 2, F.col("l_extendedprice") + 50)
    return t.lineitem.where(b.within((25.0, 30000.0), 100)).select("l_orderkey", "l_linenumber")


@query(f"""
WITH b AS (SELECT *, x - 10 AS x0, x + 10 AS x1, y - 10 AS y0, y + 10 AS y1 FROM {PARTS}),
s AS (SELECT *, greatest((x0 - 0) / 1.0, (y0 - 100) / 1.5) AS tn, least((x1 - 0) / 1.0, (y1 - 100) / 1.5) AS tf FROM b)
SELECT entity_id, round(greatest(tn, 0), 6) AS entry FROM s WHERE tn <= tf AND tf >= 0 AND greatest(tn, 0) <= 400""")
def ray(t: Tables):
    """What a ray meets, with the distance at which it enters."""
    p = F.col("Place")
    b = Box.of(p["x"] - 10, p["y"] - 10, p["x"] + 10, p["y"] + 10)
    rows = world(t).query("Part").read("Place").withColumn("entry", b.ray_entry((0.0, 100.0), (1.0, 1.5)))
    return rows.where("entry <= 400").select("entity_id", F.round("entry", 6).alias("entry"))


@query(f"""
WITH b AS (SELECT *, x - 10 AS x0, x + 10 AS x1, y - 10 AS y0, y + 10 AS y1 FROM {PARTS})
SELECT entity_id, CASE WHEN x1 - 200 < 0 OR 700 - x0 < 0 OR y1 + x1 - 600 < 0 THEN 'outside' WHEN x0 - 200 >= 0 AND 700 - x1 >= 0 AND y0 + x0 - 600 >= 0 THEN 'inside' ELSE 'intersecting' END AS side FROM b""")
def frustum(t: Tables):
    p = F.col("Place")
    b = Box.of(p["x"] - 10, p["y"] - 10, p["x"] + 10, p["y"] + 10)
    planes = [(1.0, 0.0, -200.0), (-1.0, 0.0, 700.0), (1.0, 1.0, -600.0)]
    return world(t).query("Part").read("Place").select("entity_id", b.side(planes).alias("side"))


@query(f"SELECT entity_id, archetype_id FROM {PARTS} WHERE x >= 200 AND x <= 700 AND y >= 300")
def frustum_query(t: Tables):
    return world(t).query("Part").where_frustum("Place", POINT, [(1.0, 0.0, -200.0), (-1.0, 0.0, 700.0), (0.0, 1.0, -300.0)]).execute()


@query(f"SELECT entity_id, round((x - 500) * (x - 500) + (y - 500) * (y - 500), 6) AS distance2 FROM {PARTS} QUALIFY row_number() OVER (ORDER BY (x - 500) * (x - 500) + (y - 500) * (y - 500), entity_id) <= 30")
def knn(t: Tables):
    rows = world(t).query("Part").read("Place").select("entity_id", "Place.x", "Place.y")
    return spatial.nearest(rows, Box.of("x", "y", "x", "y"), (500.0, 500.0), 30, "entity_id").withColumn("distance2", F.round("distance2", 6))


@query(f"""
SELECT region_id, rank, p_partkey, distance2 FROM (SELECT region_id, p_partkey, round((x - rx0) * (x - rx0) + (y - ry0) * (y - ry0), 6) AS distance2,
  row_number() OVER (PARTITION BY region_id ORDER BY (x - rx0) * (x - rx0) + (y - ry0) * (y - ry0), p_partkey)::INTEGER AS rank FROM {REGIONS}, {BEFORE}) WHERE rank <= 5""")
def knn_each(t: Tables):
    """The nearest points of many probes, by rings of grid cells."""
    from ..operators.checkpoints import ensure

    ensure(t.spark)
    out = spatial.nearest_each(places(t), regions(t), GRID, "x", "y", "rx0", "ry0", 5, "p_partkey", "region_id")
    return out.withColumn("distance2", F.round("distance2", 6))


@query(f"SELECT count(*) AS box, count(*) FILTER (WHERE (x - 350) * (x - 350) + (y - 350) * (y - 350) <= 22500) AS sphere FROM {PARTS} WHERE x BETWEEN 200 AND 500 AND y BETWEEN 200 AND 500")
def spatial_count(t: Tables):
    rows = world(t).query("Part").where_in_box("Place", POINT, 200, 200, 500, 500).read("Place").select("Place.*")
    near = Box.of("x", "y", "x", "y").within((350.0, 350.0), 150)
    return rows.agg(F.count("*").alias("box"), F.count(F.when(near, 1)).alias("sphere"))


@query(f"SELECT entity_id, archetype_id, 'all' AS how FROM {PARTS} WHERE category & 5 = 5 UNION ALL SELECT entity_id, archetype_id, 'any' FROM {PARTS} WHERE category & 5 <> 0")
def category_filter(t: Tables):
    q = world(t).query("Part")
    of = lambda how: q.where_category("Place", "category", 5, how).execute().withColumn("how", F.lit(how))
    return of("all").union(of("any"))


@query(f"SELECT entity_id FROM {PARTS} WHERE category < 4 AND x < 200 UNION ALL SELECT entity_id FROM {PARTS} WHERE category >= 4 AND x < 100")
def static_and_dynamic(t: Tables):
    """Two sets of different mobility, each with its own test, as one result."""
    p = world(t).query("Part").read("Place").select("entity_id", "Place.*")
    return spatial.in_both(p.where("category < 4"), p.where("category >= 4"), F.col("x") < 100, F.col("x") < 200).select("entity_id")


@query(f"SELECT p_partkey, least(floor(x / 50)::INTEGER, 31) AS cx, least(floor(y / 50)::INTEGER, 31) AS cy, ({MORTON.format(x='least(floor(x / 50)::INTEGER, 31)', y='least(floor(y / 50)::INTEGER, 31)')})::BIGINT AS cell FROM {BEFORE}")
def cell_key(t: Tables):
    k = GRID.key("x", "y")
    return places(t).select("p_partkey", GRID.cell_x("x").alias("cx"), GRID.cell_y("y").alias("cy"), k.alias("cell"))


@query("SELECT p_partkey, (p_partkey % 65536)::INTEGER AS x, p_size AS y FROM part")
def morton_round_trip(t: Tables):
    k = t.part.select("p_partkey", morton(F.col("p_partkey"), F.col("p_size")).alias("k"))
    return k.select("p_partkey", morton_x("k").alias("x"), morton_y("k").alias("y"))


@query(f"SELECT p_partkey FROM {BEFORE} WHERE x BETWEEN 100 AND 330 AND y BETWEEN 210 AND 420")
def grid_broadphase(t: Tables):
    """A box as a list of cells, which files laid out by cell are pruned by, and the exact test after it."""
    p = places(t).withColumn("cell", GRID.key("x", "y"))
    near = p.where(F.col("cell").isin(GRID.keys_in(100, 210, 330, 420)))
    return near.where(Box.of("x", "y", "x", "y").overlaps(Box.of(100, 210, 330, 420))).select("p_partkey")


@query(f"SELECT region_id, p_partkey FROM {REGIONS}, {BEFORE} WHERE {INSIDE}")
def region_overlap(t: Tables):
    return inside(places(t), t)


@query(f"""
WITH b AS (SELECT region_id, p_partkey FROM {REGIONS}, {BEFORE} WHERE {INSIDE}), a AS (SELECT region_id, p_partkey FROM {REGIONS}, {AFTER} WHERE {INSIDE})
SELECT coalesce(a.region_id, b.region_id) AS region_id, coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.region_id IS NULL THEN 'entered' WHEN a.region_id IS NULL THEN 'left' ELSE 'stayed' END AS change
FROM a FULL JOIN b ON a.region_id = b.region_id AND a.p_partkey = b.p_partkey""")
def region_enter_leave(t: Tables):
    return spatial.region_changes(inside(places(t), t), inside(moved(t), t), "region_id", "p_partkey")


@query(f"""
WITH b AS (SELECT region_id, p_partkey FROM {REGIONS}, {BEFORE} WHERE {INSIDE}), a AS (SELECT region_id, p_partkey FROM {REGIONS}, {AFTER} WHERE {INSIDE}),
c AS (SELECT coalesce(a.region_id, b.region_id) AS region_id, a.p_partkey AS n, b.p_partkey AS o FROM a FULL JOIN b ON a.region_id = b.region_id AND a.p_partkey = b.p_partkey)
SELECT region_id, count(*) FILTER (WHERE o IS NULL) AS entered, count(*) FILTER (WHERE n IS NULL) AS "left", count(*) FILTER (WHERE n IS NOT NULL AND o IS NOT NULL) AS stayed FROM c WHERE region_id % 3 = 0 GROUP BY region_id""")
def region_triggers(t: Tables):
    """Regions that are due: every third tick for a third of them."""
    c = spatial.region_changes(inside(places(t), t), inside(moved(t), t), "region_id", "p_partkey")
    known = regions(t).select("region_id", F.lit(3).alias("frequency"), F.when(F.col("region_id") % 3 == 0, 7).otherwise(9).alias("last_tick"))
    due = spatial.due_regions(known, 10).select("region_id")
    return spatial.trigger_results(c.join(due, "region_id", "left_semi"), "region_id", "p_partkey")


@query(f"""
WITH o AS (SELECT region_id AS observer_id, CASE region_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 95 ELSE 10 END AS last_tick, rx0, ry0, rx1, ry1 FROM {REGIONS})
SELECT observer_id, p_partkey AS entity_id, last_tick = 10 AS is_full_sync FROM o, {AFTER} WHERE {INSIDE} AND (last_tick = 10 OR (last_tick = 95 AND p_partkey % 5 <> 0 AND 90 + p_partkey % 10 > 95))""")
def interest(t: Tables):
    """Observers up to date, a little behind, and too far behind."""
    k = F.col("region_id") % 3
    obs = regions(t).select(F.col("region_id").alias("observer_id"), F.when(k == 0, 100).when(k == 1, 95).otherwise(10).alias("last_tick"), F.lit(0).alias("mask"), "rx0", "ry0", "rx1", "ry1")
    items = moved(t).withColumnRenamed("p_partkey", "entity_id")
    changes = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("entity_id"), (F.lit(90) + F.col("p_partkey") % 10).alias("tick"))
    return spatial.observer_updates(obs, items, changes, 100, GRID, Box.of("x", "y", "x", "y"), Box.of("rx0", "ry0", "rx1", "ry1"))


@query(f"""
WITH c AS (SELECT DISTINCT floor(x / 50)::INTEGER AS cx, floor(y / 50)::INTEGER AS cy FROM {BEFORE}), r AS (SELECT *, region_id % 2 AS tier FROM {REGIONS})
SELECT ({MORTON.format(x='cx', y='cy')})::BIGINT AS cell_key, least(3, coalesce(min(tier), 3))::INTEGER AS tier FROM c LEFT JOIN r ON floor(ry0 / 50) <= cy AND floor(ry1 / 50) >= cy AND floor(rx0 / 50) <= cx AND floor(rx1 / 50) >= cx GROUP BY cx, cy""")
def tier_assignment(t: Tables):
    """Cells take the least tier of the observers over them."""
    cells = places(t).select(GRID.key("x", "y").alias("cell_key")).distinct()
    obs = regions(t).withColumn("tier", F.col("region_id") % 2)
    return spatial.assign_tiers(cells, GRID, obs, Box.of("rx0", "ry0", "rx1", "ry1"), "tier", 3)


@query(f"SELECT (floor(y / 50)::INTEGER % 3)::INTEGER AS tier, count(*) AS n FROM {BEFORE} GROUP BY 1")
def tier_index(t: Tables):
    """Entities of each tier."""
    return spatial.tier_index(places(t), GRID.cell_y("y") % 3)


@query(f"""
SELECT p_partkey, CASE WHEN out THEN nx ELSE cx END AS new_x, CASE WHEN out THEN ny ELSE cy END AS new_y, out AND (nx <> cx OR ny <> cy) AS migrated FROM (SELECT a.p_partkey,
  floor(b.x / 50)::INTEGER AS cx, floor(b.y / 50)::INTEGER AS cy, floor(a.x / 50)::INTEGER AS nx, floor(a.y / 50)::INTEGER AS ny,
  a.x < floor(b.x / 50) * 50 - 15 OR a.x >= floor(b.x / 50) * 50 + 65 OR a.y < floor(b.y / 50) * 50 - 15 OR a.y >= floor(b.y / 50) * 50 + 65 AS out FROM {AFTER} a JOIN {BEFORE} b ON a.p_partkey = b.p_partkey)""")
def cell_migration(t: Tables):
    """Entities leave a cell only once they are well beyond it."""
    was = places(t).select("p_partkey", GRID.cell_x("x").alias("cx"), GRID.cell_y("y").alias("cy"))
    return spatial.migrate_cells(moved(t).join(was, "p_partkey"), GRID, "x", "y", "cx", "cy", 15.0).select("p_partkey", "new_x", "new_y", "migrated")


@query(f"SELECT (p_partkey // 64)::BIGINT AS cluster, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, bit_or(p_partkey % 8)::BIGINT AS category FROM {BEFORE} GROUP BY 1")
def cluster_bounds(t: Tables):
    """The union of the boxes and categories of each cluster."""
    return spatial.cluster_bounds(places(t), F.floor(F.col("p_partkey") / 64).cast("long"), Box.of("x", "y", "x", "y"), F.col("p_partkey") % 8)


@query("""
SELECT l_orderkey, l_linenumber, round(least(q + 2, 30) - greatest(q - 2, 20) , 6) AS width, q - 2 >= 20 AND q + 2 <= 30 AS inside, round((q - 25) * (q - 25) + (p - 100) * (p - 100), 4) AS center2, round(sqrt(16 + 4) / 2, 6) AS sphere, 8.0::DOUBLE AS area
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_tax AS p FROM lineitem) WHERE q - 2 <= 30 AND q + 2 >= 20""")
def box_measures(t: Tables):
    q, p = F.col("l_quantity"), F.col("l_tax")
    b, r = Box.of(q - 2, p - 1, q + 2, p + 1), Box.of(20, -50, 30, 50)
    inner = Box((F.greatest(b.low[0], r.low[0]),), (F.least(b.high[0], r.high[0]),))
    return t.lineitem.where(b.overlaps(r)).select(
        "l_orderkey", "l_linenumber", F.round(inner.measure(), 6).alias("width"), r.contains(b).alias("inside"), F.round(b.center_distance2((25.0, 100.0)), 4).alias("center2"), F.round(b.sphere()[1], 6).alias("sphere"), F.round(b.measure(), 6).alias("area")
    )


@query(f"SELECT region_id, p_partkey, (p_partkey // 64)::BIGINT AS chunk FROM {REGIONS}, {BEFORE} WHERE {INSIDE}")
def region_occupants(t: Tables):
    """Who is in each region, with the chunk that holds the entity."""
    return spatial.occupants(places(t), regions(t), GRID, Box.of("x", "y", "x", "y"), Box.of("rx0", "ry0", "rx1", "ry1"), "p_partkey", "region_id", F.floor(F.col("p_partkey") / 64).cast("long"))


@query(f"""
WITH o AS (SELECT region_id AS observer_id, rx0, ry0, rx1, ry1 FROM {REGIONS})
SELECT observer_id, p_partkey AS entity_id, FALSE AS is_full_sync FROM o, {AFTER} WHERE {INSIDE} AND p_partkey % 3 = 1""")
def interest_next(t: Tables):
    """Observers, one of them long behind, hear all up to a tick; at the next tick they hear that tick's changes only."""
    obs = regions(t).select(F.col("region_id").alias("observer_id"), F.when(F.col("region_id") % 3 == 2, 10).otherwise(95).alias("last_tick"), F.lit(0).alias("mask"), "rx0", "ry0", "rx1", "ry1")
    items = moved(t).withColumnRenamed("p_partkey", "entity_id")
    old = t.part.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("entity_id"), F.lit(99).alias("tick"))
    new = t.part.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("entity_id"), F.lit(101).alias("tick"))
    boxes = Box.of("x", "y", "x", "y"), Box.of("rx0", "ry0", "rx1", "ry1")
    return spatial.observer_updates(spatial.advance(obs, 100), items, old.union(new), 101, GRID, *boxes)


@query(f"""
WITH c AS (SELECT DISTINCT floor(x / 50)::INTEGER AS cx, floor(y / 50)::INTEGER AS cy FROM {BEFORE}),
a AS (SELECT *, CASE WHEN cx BETWEEN 2 AND 9 AND cy BETWEEN 1 AND 8 THEN 0 ELSE 3 END AS t1 FROM c), b AS (SELECT *, CASE WHEN cx BETWEEN 4 AND 12 AND cy BETWEEN 0 AND 20 THEN least(t1, 1) ELSE t1 END AS t2 FROM a)
SELECT ({MORTON.format(x='cx', y='cy')})::BIGINT AS cell_key, (CASE WHEN cx = 5 THEN 2 ELSE t2 END)::INTEGER AS tier FROM b""")
def set_tiers(t: Tables):
    """Tiers reset, set in a box, lowered in another, and set for a column of cells."""
    cells = spatial.reset_tiers(places(t).select(GRID.key("x", "y").alias("cell_key")).distinct(), 3)
    cells = spatial.set_tier_in_box(cells, GRID, (100, 50, 499, 449), 0)
    cells = spatial.set_tier_in_box(cells, GRID, (200, 0, 649, 1049), 1, least=True)
    return spatial.set_tier(cells, 2, morton_x("cell_key") == 5)


@query(f"""
SELECT region_id, ((rx1 - rx0) * (ry1 - ry0) * 10)::DOUBLE AS volume, FALSE AS flat, (rx1 - rx0 + 5)::DOUBLE AS union_width, sqrt(power(rx1 - rx0, 2) + power(ry1 - ry0, 2) + 100) / 2 AS radius FROM {REGIONS}""")
def box_measures_3d(t: Tables):
    """Boxes of three axes: volume, union with another box, and the sphere around them."""
    b = Box.of("rx0", "ry0", F.lit(0.0), "rx1", "ry1", F.lit(10.0))
    wide = b.union(Box.of(F.col("rx0") - 5, "ry0", F.lit(0.0), "rx1", "ry1", F.lit(10.0)))
    flat = b.is_degenerate()
    return regions(t).select("region_id", b.measure().alias("volume"), flat.alias("flat"), (wide.high[0] - wide.low[0]).alias("union_width"), b.sphere()[1].alias("radius"))
