"""Spatial operators over tables of boxes: grid, joins by cell, neighbours, regions, observers and tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.scalars import category_match, cell_index, morton, morton_x, morton_y


@dataclass(frozen=True)
class Grid:
    min_x: float
    min_y: float
    cell: float
    width: int
    height: int

    def cell_x(self, x) -> Column:
        return cell_index(x, self.min_x, self.cell, self.width)

    def cell_y(self, y) -> Column:
        return cell_index(y, self.min_y, self.cell, self.height)

    def key(self, x, y) -> Column:
        return morton(self.cell_x(x), self.cell_y(y))

    def cells(self, box: Box) -> Column:
        """Keys of all cells that a box touches, as an array."""
        (x0, x1), (y0, y1) = box.axes[:2]
        xs, ys = F.sequence(self.cell_x(x0), self.cell_x(x1)), F.sequence(self.cell_y(y0), self.cell_y(y1))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: morton(x, y))))

    def keys_in(self, *box: float) -> list[int]:
        """Cells of a constant box, on the driver: a filter on the cell column that partitions and files can be pruned by."""
        x0, x1 = (min(max(int((v - self.min_x) // self.cell), 0), self.width - 1) for v in (box[0], box[2]))
        y0, y1 = (min(max(int((v - self.min_y) // self.cell), 0), self.height - 1) for v in (box[1], box[3]))
        spread = lambda v: sum((v >> i & 1) << 2 * i for i in range(16))
        return [spread(x) | spread(y) << 1 for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]


#: Parts into which the items of each cell are dealt.
SALTS = 8


def overlap_join(items: DataFrame, regions: DataFrame, grid: Grid, item_box: Box, region_box: Box, item_id: str, region_id: str, residual: Column | None = None, also: tuple[str, ...] = (), salts: int = SALTS) -> DataFrame:
    """(region_id, item_id) of all pairs that overlap, with the columns of `also`.

    Both sides go to the cells they touch and meet by cell, so the join is an equi-join; a pair is kept in the one
    cell that holds the least corner of its overlap, so none comes twice and nothing is deduplicated by a shuffle.
    The items of a cell are dealt over `salts` parts and regions go to each of them, so a cell with very many items is
    no single task's. The columns of both sides must have different names.
    """
    a = items.withColumn("__cell", F.explode(grid.cells(item_box))).withColumn("__salt", F.pmod(F.xxhash64(item_id), F.lit(salts)))
    b = regions.withColumn("__cell", F.explode(grid.cells(region_box))).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    corner = [F.greatest(x[0], y[0]) for x, y in zip(item_box.axes[:2], region_box.axes[:2])]
    own = F.col("__cell") == grid.key(*corner)
    hit = a.join(b, ["__cell", "__salt"]).where(item_box.overlaps(region_box) & own)
    if residual is not None:
        hit = hit.where(residual)
    return hit.select(region_id, item_id, *also)


def occupants(items: DataFrame, regions: DataFrame, grid: Grid, item_box: Box, region_box: Box, item_id: str, region_id: str, chunk: Column) -> DataFrame:
    """(region_id, item_id, chunk): who is in each region, and the chunk that holds the item."""
    return overlap_join(items.withColumn("chunk", chunk), regions, grid, item_box, region_box, item_id, region_id, also=("chunk",))


def in_both(static: DataFrame, dynamic: DataFrame, test: Column, of_static: Column | None = None) -> DataFrame:
    """What a test holds for in the set that never moves and in the one that does, which may have a test of its own."""
    return static.where(test if of_static is None else of_static).unionByName(dynamic.where(test))


def cluster_bounds(items: DataFrame, cluster: Column, box: Box, category: Column) -> DataFrame:
    """(cluster, min_x, min_y, ..., category): the union of the boxes of each cluster, and all its categories' bits."""
    names = "xyz"[: len(box.axes)]
    least = [F.min(lo).alias(f"min_{n}") for n, (lo, _) in zip(names, box.axes)]
    most = [F.max(hi).alias(f"max_{n}") for n, (_, hi) in zip(names, box.axes)]
    return items.groupBy(cluster.alias("cluster")).agg(*least, *most, F.bit_or(category).alias("category"))


def nearest(df: DataFrame, box: Box, at: tuple, k: int, id_col: str) -> DataFrame:
    """The k closest, by squared distance to the box, ties by id: a top-k of each task, then of them."""
    d = df.select(id_col, box.distance2(at).alias("distance2"))
    return d.where(~F.isnan("distance2")).orderBy("distance2", id_col).limit(k)


def nearest_each(df: DataFrame, probes: DataFrame, grid: Grid, x: str, y: str, px: str, py: str, k: int, id_col: str, probe_id: str, salts: int = SALTS) -> DataFrame:
    """(probe_id, rank, id, distance2): the k points closest to each probe.

    Probes look around them with a reach that grows until k points are surely found: points within the reach are
    complete, so a probe is done once its k-th distance is inside it. Each round's cells are as wide as its reach, so a
    probe looks at nine at most; all rounds are equi-joins on cells, of which the points are dealt over `salts` parts;
    at the end the reach covers the grid, which gives probes of sparse places all points, so none is lost.
    """
    points = df.select(F.col(id_col).alias("__id"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)))
    open_ = probes.select(probe_id, F.col(px).cast("double").alias("__px"), F.col(py).cast("double").alias("__py"))
    reach, done, whole = 1, None, max(grid.width, grid.height)
    while True:
        box = Box.of(F.col("__px") - reach * grid.cell, F.col("__py") - reach * grid.cell, F.col("__px") + reach * grid.cell, F.col("__py") + reach * grid.cell)
        wide = Grid(grid.min_x, grid.min_y, grid.cell * reach, -(-grid.width // reach), -(-grid.height // reach))
        looking = open_.withColumn("__cell", F.explode(wide.cells(box))).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        near = looking.join(points.withColumn("__cell", wide.key("__x", "__y")), ["__cell", "__salt"])
        near = near.withColumn("distance2", (F.col("__x") - F.col("__px")) ** 2 + (F.col("__y") - F.col("__py")) ** 2)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(probe_id).orderBy("distance2", "__id"))).where(F.col("rank") <= k)
        sure = F.lit((reach * grid.cell) ** 2)
        # Cells at the edge also hold points beyond it, so only the covered distance counts.
        good = ranked.groupBy(probe_id).agg(F.max("distance2").alias("__far"), F.count("*").alias("__n")).where((F.col("__n") == k) & (F.col("__far") <= sure) if reach < whole else F.lit(True))
        part = ranked.join(good.select(probe_id), probe_id, "left_semi").select(probe_id, "rank", F.col("__id").alias(id_col), "distance2")
        done = part if done is None else done.unionByName(part)
        if reach >= whole:
            return done
        open_ = open_.join(good.select(probe_id), probe_id, "left_anti").checkpoint()
        if open_.isEmpty():
            return done
        reach = min(whole, reach * 4)


def region_changes(before: DataFrame, after: DataFrame, region_id: str, item_id: str) -> DataFrame:
    """Of each region and item of either occupancy: entered, left or stayed."""
    a = before.select(region_id, item_id, F.lit(True).alias("__was"))
    b = after.select(region_id, item_id, F.lit(True).alias("__is"))
    change = F.when(F.col("__was") & F.col("__is"), "stayed").when(F.col("__is"), "entered").otherwise("left")
    return a.join(b, [region_id, item_id], "full").select(region_id, item_id, change.alias("change"))


def trigger_results(changes: DataFrame, region_id: str, item_id: str) -> DataFrame:
    """For each region how many entered, left and stayed; which ones they are, the rows of changes say."""
    of = lambda c: F.count(F.when(F.col("change") == c, F.col(item_id))).alias(c)
    return changes.groupBy(region_id).agg(of("entered"), of("left"), of("stayed"))


def due_regions(regions: DataFrame, tick: int, frequency: str = "frequency", last: str = "last_tick") -> DataFrame:
    """Regions to evaluate at this tick: never evaluated, or `frequency` ticks ago or more."""
    return regions.where(F.col(last).isNull() | (F.lit(tick) - F.col(last) >= F.col(frequency)))


RING = 64


def observer_updates(observers: DataFrame, items: DataFrame, changes: DataFrame, tick: int, grid: Grid, item_box: Box, observer_box: Box, category: str | None = None, ring: int = RING) -> DataFrame:
    """(observer_id, entity_id, is_full_sync): what each observer must hear at a tick.

    observers(observer_id, last_tick, mask, box columns); changes(entity_id, tick). An observer up to date hears
    nothing; one more than `ring` ticks behind gets all entities it overlaps; others get the changed ones they overlap.
    """
    late = observers.where(F.col("last_tick") < tick).withColumn("is_full_sync", (F.lit(tick) - F.col("last_tick") > ring))
    fit = None if category is None else (F.col("mask") == 0) | (F.col(category).bitwiseAND(F.col("mask")) == F.col("mask"))
    full = overlap_join(items, late.where("is_full_sync"), grid, item_box, observer_box, "entity_id", "observer_id", fit).withColumn("is_full_sync", F.lit(True))
    # The last change of an entity in the ring says whether an observer has heard of it.
    last = changes.where((F.col("tick") <= tick) & (F.col("tick") > tick - ring)).groupBy("entity_id").agg(F.max("tick").alias("__changed"))
    newer = F.col("__changed") > F.col("last_tick")
    some = overlap_join(items.join(last, "entity_id"), late.where(~F.col("is_full_sync")), grid, item_box, observer_box, "entity_id", "observer_id", newer if fit is None else newer & fit)
    return full.unionByName(some.withColumn("is_full_sync", F.lit(False)))


def advance(observers: DataFrame, tick: int) -> DataFrame:
    """Observers that have heard all up to a tick, a full sync included."""
    return observers.withColumn("last_tick", F.greatest("last_tick", F.lit(tick)))


def set_tier(cells: DataFrame, tier: int, where: Column, least: bool = False) -> DataFrame:
    """cells(cell_key, tier) with a tier set where a condition holds; least: only where it is less than the cell's."""
    new = F.least("tier", F.lit(tier)) if least else F.lit(tier)
    return cells.withColumn("tier", F.when(where, new).otherwise(F.col("tier")).cast("int"))


def set_tier_in_box(cells: DataFrame, grid: Grid, box: tuple[float, ...], tier: int, least: bool = False) -> DataFrame:
    """The same for the cells that a box touches, told by their coordinates."""
    x, y = morton_x("cell_key"), morton_y("cell_key")
    x0, x1, y0, y1 = grid.cell_x(F.lit(box[0])), grid.cell_x(F.lit(box[2])), grid.cell_y(F.lit(box[1])), grid.cell_y(F.lit(box[3]))
    return set_tier(cells, tier, x.between(x0, x1) & y.between(y0, y1), least)


def reset_tiers(cells: DataFrame, tier: int) -> DataFrame:
    return cells.withColumn("tier", F.lit(tier))


def tier_index(items: DataFrame, tier: Column) -> DataFrame:
    """(tier, n): the entities of each tier."""
    return items.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def assign_tiers(cells: DataFrame, grid: Grid, observers: DataFrame, box: Box, tier: str, default: int) -> DataFrame:
    """cells(cell_key) with the least tier of the observers over each, or the default."""
    reached = observers.select(F.explode(grid.cells(box)).alias("cell_key"), F.col(tier).alias("__tier")).groupBy("cell_key").agg(F.min("__tier").alias("__tier"))
    return cells.join(reached, "cell_key", "left").select("cell_key", F.least(F.lit(default), F.coalesce("__tier", F.lit(default))).alias("tier"))


def migrate_cells(df: DataFrame, grid: Grid, x: str, y: str, cell_x: str, cell_y: str, hysteresis: float) -> DataFrame:
    """New cells of moved entities: one leaves its cell only when it is beyond the cell by the hysteresis."""
    def moved(at: str, cell: str, origin: float) -> Column:
        low = F.lit(origin) + F.col(cell) * grid.cell
        return (F.col(at) < low - hysteresis) | (F.col(at) >= low + grid.cell + hysteresis)

    out = moved(x, cell_x, grid.min_x) | moved(y, cell_y, grid.min_y)
    return df.withColumn("new_x", F.when(out, grid.cell_x(x)).otherwise(F.col(cell_x))).withColumn("new_y", F.when(out, grid.cell_y(y)).otherwise(F.col(cell_y))).withColumn("migrated", (F.col("new_x") != F.col(cell_x)) | (F.col("new_y") != F.col(cell_y)))


def categories(df: DataFrame, column: str, mask: int, how: str) -> DataFrame:
    return df.where(category_match(F.col(column), mask, how))
