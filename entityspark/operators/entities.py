"""Typed queries over entities: a lazy builder that composes one DataFrame.

Each archetype has a table of its own (entity_id, enabled and one struct a component), so archetype predicates prune
whole tables before anything is read, and the remaining predicates reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.scalars import category_match
from ..plans.dnf import Predicate
from ..schema import Registry
from .store import index_bounds, index_range

KEYS = ("entity_id", "archetype_id", "enabled")


class World:
    def __init__(self, registry: Registry, tables: dict[str, DataFrame]):
        """tables: by archetype, with entity_id, enabled (a bit for each slot) and a struct for each component."""
        self.registry, self.tables = registry, tables

    def query(self, archetype: str) -> EntityQuery:
        """The archetype and all that descend from it."""
        return EntityQuery(self, self.registry.subtree(archetype))

    def query_exact(self, archetype: str) -> EntityQuery:
        return EntityQuery(self, frozenset([archetype]))

    def with_pending(self, spawned: dict[str, DataFrame] | None = None, destroyed: DataFrame | None = None) -> World:
        """What a transaction sees that has spawned and destroyed entities and not committed yet."""
        out = {}
        for name, df in self.tables.items():
            if spawned and name in spawned:
                df = df.unionByName(spawned[name])
            out[name] = df.join(destroyed.select("entity_id"), "entity_id", "left_anti") if destroyed is not None else df
        return World(self.registry, out)

    def open(self, entity_id: int) -> DataFrame:
        """One entity by its id, which names its archetype, so that one table is read."""
        name = next((a.name for a in self.registry.archetypes.values() if a.id == entity_id & 0xFFF), None)
        if name is None or name not in self.tables:
            raise KeyError(entity_id)
        return self.query_exact(name).where(F.col("entity_id") == entity_id).read()

    def try_open(self, entity_id: int) -> DataFrame | None:
        """The entity, or None if its id names no table or no row of it."""
        try:
            found = self.open(entity_id)
        except KeyError:
            return None
        return None if found.isEmpty() else found

    def index(self, component: str, field: str) -> IndexHandle:
        """The index of a field; KeyError without one."""
        if self.registry.components[component][field].index is None:
            raise KeyError(f"{component}.{field} has no index")
        return IndexHandle(self, component, field)

    def alive(self, ids: DataFrame) -> DataFrame:
        """ids(entity_id) with `alive`."""
        every = self.query_all().execute().select("entity_id", F.lit(True).alias("__in"))
        return ids.join(every, "entity_id", "left").select("entity_id", F.coalesce("__in", F.lit(False)).alias("alive"))

    def query_all(self) -> EntityQuery:
        return EntityQuery(self, frozenset(self.tables))

    def counts(self) -> DataFrame:
        """Entities of each archetype, and of it with all its descendants."""
        r = self.registry
        own = self.query_all().execute().groupBy("archetype_id").agg(F.count("*").alias("n"))
        up = [(a.id, b) for b in r.archetypes for a in [r.archetypes[x] for x in r.subtree(b)]]
        links = own.sparkSession.createDataFrame(up, "archetype_id int, archetype string")
        own_id = {a.name: a.id for a in r.archetypes.values()}
        mine = reduce(lambda c, kv: c.when(F.col("archetype") == kv[0], F.lit(kv[1])), own_id.items(), F.when(F.lit(False), F.lit(0)))
        return (
            links.join(own, "archetype_id", "left")
            .groupBy("archetype")
            .agg(F.coalesce(F.sum(F.when(F.col("archetype_id") == mine, F.col("n"))), F.lit(0)).alias("exact"), F.coalesce(F.sum("n"), F.lit(0)).alias("polymorphic"))
        )


class EntityQuery:
    def __init__(self, world: World, archetypes: frozenset[str]):
        self.world, self.archetypes = world, archetypes
        self._filters: list[Callable[[str], Column | None]] = []  # of an archetype: its condition, None for no row
        self.predicates: list[Predicate] = []
        self._order: tuple[Column, bool] | None = None
        self._skip, self._take = 0, None

    def _copy(self) -> EntityQuery:
        q = EntityQuery(self.world, self.archetypes)
        q._filters, q.predicates, q._order, q._skip, q._take = [*self._filters], [*self.predicates], self._order, self._skip, self._take
        return q

    def _narrowed(self, to: frozenset[str]) -> EntityQuery:
        q = self._copy()
        q.archetypes = self.archetypes & to
        return q

    def _filtered(self, f: Callable[[str], Column | None]) -> EntityQuery:
        q = self._copy()
        q._filters.append(f)
        return q

    def _has(self, archetype: str, component: str) -> bool:
        return component in self.world.registry.slots(archetype)

    def _on(self, archetype: str, component: str) -> Column | None:
        bit = self.world.registry.bit(archetype, component)
        return None if bit is None else F.col("enabled").bitwiseAND(bit) != 0

    def with_(self, *components: str) -> EntityQuery:
        return reduce(lambda q, c: q._narrowed(q.world.registry.having(c)), components, self)

    def without(self, *components: str) -> EntityQuery:
        return reduce(lambda q, c: q._narrowed(q.archetypes - q.world.registry.having(c)), components, self)

    def exclude(self, archetype: str) -> EntityQuery:
        return self._narrowed(self.archetypes - self.world.registry.subtree(archetype))

    def enabled(self, component: str) -> EntityQuery:
        """Entities without the component fail."""
        return self._filtered(lambda a: self._on(a, component))

    def disabled(self, component: str) -> EntityQuery:
        """Entities without the component pass."""

        def f(a: str) -> Column:
            on = self._on(a, component)
            return F.lit(True) if on is None else ~on

        return self._filtered(f)

    def where(self, condition: Column) -> EntityQuery:
        return self._filtered(lambda a: condition)

    def where_opaque(self, component: str, test: Callable[[Column], Column]) -> EntityQuery:
        """Any test of a component, a Python function too; absent and disabled components fail it."""

        def f(a: str) -> Column | None:
            on = self._on(a, component)
            return None if on is None else on & F.coalesce(test(F.col(component)), F.lit(False))

        return self._filtered(f)

    def where_field(self, predicate: Predicate) -> EntityQuery:
        """Field comparisons in any and/or/not; several calls are anded. Archetypes that lack a component that some
        branch tests fail that branch."""

        def f(a: str) -> Column | None:
            held = [b for b in predicate.branches() if all(self._has(a, c.component) for c in b)]
            if not held:
                return None
            return reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [c.column() for c in b], F.lit(True)) for b in held])

        q = self._filtered(f)
        q.predicates.append(predicate)
        return q

    # Space: `bounds` names the box fields of a component, least corner first.
    def _box(self, component: str, bounds: tuple[str, ...]) -> Box:
        return Box.of(*[F.col(component)[b] for b in bounds])

    def _spatial(self, component: str, test: Callable[[], Column]) -> EntityQuery:
        return self._filtered(lambda a: test() if self._has(a, component) else None)

    def where_in_box(self, component: str, bounds: tuple[str, ...], *box: float) -> EntityQuery:
        return self._spatial(component, lambda: self._box(component, bounds).overlaps(Box.of(*box)))

    def where_near(self, component: str, bounds: tuple[str, ...], at: tuple, radius: float) -> EntityQuery:
        return self._spatial(component, lambda: self._box(component, bounds).within(at, radius))

    def where_ray(self, component: str, bounds: tuple[str, ...], origin: tuple, direction: tuple, length: float) -> EntityQuery:
        if not length >= 0:
            return self._narrowed(frozenset())
        return self._spatial(component, lambda: F.coalesce(self._box(component, bounds).ray_entry(origin, direction) <= length, F.lit(False)))

    def where_frustum(self, component: str, bounds: tuple[str, ...], planes: list[tuple]) -> EntityQuery:
        return self._spatial(component, lambda: self._box(component, bounds).side(planes) != "outside")

    def where_category(self, component: str, field: str, mask: int, how: str = "all") -> EntityQuery:
        return self._spatial(component, lambda: category_match(F.col(component)[field], mask, how))

    def order_by(self, component: str, field: str, descending: bool = False) -> EntityQuery:
        q = self._copy()
        q._order = (F.col(component)[field] if component else F.col(field), descending)
        return q

    def front_to_back(self, component: str, bounds: tuple[str, ...], origin: tuple, direction: tuple) -> EntityQuery:
        """In the order in which a ray enters the boxes, ties by entity."""
        q = self._copy()
        q._order = (self._box(component, bounds).ray_entry(origin, direction), False)
        return q

    def order_by_key(self, descending: bool = False) -> EntityQuery:
        return self.order_by("", "entity_id", descending)

    def skip(self, n: int) -> EntityQuery:
        if self._order is None:
            raise ValueError("skip needs an order")
        q = self._copy()
        q._skip = n
        return q

    def take(self, n: int) -> EntityQuery:
        if self._order is None:
            raise ValueError("take needs an order")
        q = self._copy()
        q._take = n
        return q

    def read(self, *components: str) -> DataFrame:
        """Keys and components, a component null where it is absent or disabled."""
        r = self.world.registry
        wanted = components or tuple(dict.fromkeys(c for a in sorted(self.archetypes) for c in r.slots(a)))
        parts = []
        for a in sorted(self.archetypes & set(self.world.tables)):
            conditions = [f(a) for f in self._filters]
            if any(c is None for c in conditions):
                continue
            df = self.world.tables[a].withColumn("archetype_id", F.lit(r.archetypes[a].id))
            for c in conditions:
                df = df.where(c)
            if self._order is not None:
                df = df.withColumn("__order", self._order[0])
            cols = [F.when(self._on(a, c), F.col(c)).alias(c) for c in wanted if self._has(a, c)]
            parts.append(df.select(*KEYS, *cols, *(["__order"] if self._order is not None else [])))
        if not parts:
            base = next(iter(self.world.tables.values())).where(F.lit(False))
            return base.select("entity_id", F.lit(0).alias("archetype_id"), "enabled")
        out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        if self._order is not None:
            # Null keys last; ties by entity.
            out = out.orderBy(F.desc_nulls_last("__order") if self._order[1] else F.asc_nulls_last("__order"), "entity_id")
            if self._skip:
                out = out.offset(self._skip)
            if self._take is not None:
                out = out.limit(self._take)
            out = out.drop("__order")
        return out

    def execute(self) -> DataFrame:
        return self.read().select("entity_id", "archetype_id")

    def count_frame(self) -> DataFrame:
        return self.execute().agg(F.count("*").alias("n"))

    def any_frame(self) -> DataFrame:
        return self.execute().limit(1).agg((F.count("*") > 0).alias("any"))

    def count(self) -> int:
        return self.execute().count()

    def any(self) -> bool:
        return not self.execute().isEmpty()

    def __iter__(self):
        """Rows one by one; a partition at a time comes to the driver."""
        return self.execute().toLocalIterator()

    def map_chunks(self, work: Callable, schema: str, *components: str) -> DataFrame:
        """A function over Arrow batches of the entities, for work on spans of many entities at once."""
        return self.read(*components).mapInArrow(work, schema)


@dataclass(frozen=True)
class IndexHandle:
    """An indexed field of all archetypes that have its component; disabled components are not in the index."""

    world: World
    component: str
    field: str

    @property
    def unique(self) -> bool:
        return self.world.registry.components[self.component][self.field].index == "unique"

    def entries(self) -> DataFrame:
        """(entity_id, key)"""
        rows = self.world.query_all().with_(self.component).enabled(self.component).read(self.component)
        return rows.select("entity_id", F.col(self.component)[self.field].alias("key")).where("key is not null")

    def lookup(self, key) -> DataFrame:
        return self.entries().where(F.col("key") == key)

    def range(self, low=None, high=None, descending: bool = False) -> DataFrame:
        return index_range(self.entries(), "key", low, high, descending, "entity_id")

    def bounds(self) -> DataFrame:
        return index_bounds(self.entries(), "key")


class Navigation:
    """Sources whose foreign key leads to a target that a predicate holds for; a semi-join."""

    def __init__(self, source: DataFrame, target: DataFrame, key: str, target_key: str, registry: Registry | None = None, check: tuple[str, str, str] | None = None):
        if registry is not None and check is not None:
            registry.check_reference(*check)
        self.source, self.target, self.key, self.target_key = source, target, key, target_key
        self._source, self._target = F.lit(True), F.lit(True)

    def where(self, source: Column | None = None, target: Column | None = None) -> Navigation:
        out = Navigation(self.source, self.target, self.key, self.target_key)
        out._source = self._source if source is None else self._source & source
        out._target = self._target if target is None else self._target & target
        return out

    def execute(self) -> DataFrame:
        """Key 0 and null lead nowhere."""
        linked = F.col(self.key).isNotNull() & (F.col(self.key) != 0)
        targets = self.target.where(self._target).select(F.col(self.target_key).alias(self.key))
        return self.source.where(self._source & linked).join(targets, self.key, "left_semi")

    def sources_of(self, targets: DataFrame) -> DataFrame:
        """The reverse: all sources of the targets with these keys."""
        return self.source.join(targets.select(F.col(self.target_key).alias(self.key)), self.key, "left_semi")

    def count(self) -> int:
        return self.execute().count()

    def any(self) -> bool:
        return not self.execute().isEmpty()
