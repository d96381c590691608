"""Components, archetypes and their registry; field identity, differences between revisions, and migrations."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(names: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names.split()])


_F, _D = T.FloatType(), T.DoubleType()
#: The field types by name, as (Spark type, bytes in a component).
TYPES: dict[str, tuple[T.DataType, int]] = {
    "Boolean": (T.BooleanType(), 1),
    "Byte": (T.ByteType(), 1),
    "Short": (T.ShortType(), 2),
    "Int": (T.IntegerType(), 4),
    "Long": (T.LongType(), 8),
    "UByte": (T.ShortType(), 1),
    "UShort": (T.IntegerType(), 2),
    "UInt": (T.LongType(), 4),
    "ULong": (T.DecimalType(20, 0), 8),
    "Float": (_F, 4),
    "Double": (_D, 8),
    "Char": (T.StringType(), 2),
    "String64": (T.StringType(), 64),
    "String1024": (T.StringType(), 1024),
    "String": (T.StringType(), 32),
    "Variant": (T.StringType(), 64),
    "Point2F": (_struct("x y", _F), 8),
    "Point3F": (_struct("x y z", _F), 12),
    "Point4F": (_struct("x y z w", _F), 16),
    "Point2D": (_struct("x y", _D), 16),
    "Point3D": (_struct("x y z", _D), 24),
    "Point4D": (_struct("x y z w", _D), 32),
    "QuaternionF": (_struct("x y z w", _F), 16),
    "QuaternionD": (_struct("x y z w", _D), 32),
    "AABB2F": (_struct("min_x min_y max_x max_y", _F), 16),
    "AABB3F": (_struct("min_x min_y min_z max_x max_y max_z", _F), 24),
    "AABB2D": (_struct("min_x min_y max_x max_y", _D), 32),
    "AABB3D": (_struct("min_x min_y min_z max_x max_y max_z", _D), 48),
    "BSphere2F": (_struct("center_x center_y radius", _F), 12),
    "BSphere3F": (_struct("center_x center_y center_z radius", _F), 16),
    "BSphere2D": (_struct("center_x center_y radius", _D), 24),
    "BSphere3D": (_struct("center_x center_y center_z radius", _D), 32),
    "PackedDateTime48": (T.TimestampType(), 6),
    "PackedTimeSpan32": (T.LongType(), 4),
    "PackedTimeSpan48": (T.LongType(), 6),
    "Component": (T.LongType(), 8),
}

_SIGNED, _UNSIGNED = ("Byte", "Short", "Int", "Long"), ("UByte", "UShort", "UInt", "ULong")
#: Lossless widenings: within the signed and unsigned chains, unsigned to a wider signed, and to more precision.
WIDENINGS: frozenset[tuple[str, str]] = frozenset(
    [(c[i], c[j]) for c in (_SIGNED, _UNSIGNED) for i in range(4) for j in range(i + 1, 4)]
    + [(_UNSIGNED[i], _SIGNED[j]) for i in range(3) for j in range(i + 1, 4)]
    + [("Float", "Double"), ("QuaternionF", "QuaternionD"), ("String64", "String1024")]
    + [(f"Point{n}F", f"Point{n}D") for n in (2, 3, 4)]
)


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    id: int | None = None
    previous_name: str | None = None
    index: str | None = None  # "unique" or "multi"
    references: str | None = None  # the target component of a foreign key
    on_parent_delete: str = "none"  # or "delete"
    element: str | None = None  # the element type of a collection, whose type is "Collection"

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(TYPES[self.element][0]) if self.type == "Collection" else TYPES[self.type][0]

    @property
    def size(self) -> int:
        return 4 if self.type == "Collection" else TYPES[self.type][1]


@dataclass(frozen=True)
class Component:
    name: str
    fields: tuple[Field, ...]
    revision: int = 1
    mode: str = "versioned"  # "single" or "transient"
    previous_name: str | None = None

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, True, {"field_id": f.id, "previous_name": f.previous_name}) for f in self.fields])

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


@dataclass(frozen=True)
class Archetype:
    name: str
    id: int
    components: tuple[str, ...] = ()
    parent: str | None = None
    revision: int = 1


class Registry:
    """What is known of components and archetypes; plain Python, on the driver."""

    def __init__(self):
        self.components: dict[str, Component] = {}
        self.archetypes: dict[str, Archetype] = {}

    def component(self, name: str, *fields: Field, **options) -> Registry:
        if name in self.components:
            raise ValueError(f"component {name} exists")
        if len({f.name for f in fields}) < len(fields):
            raise ValueError(f"component {name} names a field twice")
        self.components[name] = assign_ids(Component(name, fields, **options))
        return self

    def archetype(self, name: str, id: int, *components: str, parent: str | None = None) -> Registry:
        if name in self.archetypes or any(a.id == id for a in self.archetypes.values()):
            raise ValueError(f"archetype {name} or id {id} exists")
        if not 0 <= id < 4096:
            raise ValueError("archetype ids take 12 bits")
        for c in components:
            if c not in self.components:
                raise KeyError(c)
        if parent is not None and set(components) & set(self.slots(parent)):
            raise ValueError(f"{name} repeats a component of its parent")
        self.archetypes[name] = Archetype(name, id, components, parent)
        if len(self.slots(name)) > 16:
            raise ValueError(f"{name} has more than 16 components")
        return self

    def slots(self, archetype: str) -> tuple[str, ...]:
        """Components in slot order, the parent's first."""
        a = self.archetypes[archetype]
        return (*(self.slots(a.parent) if a.parent else ()), *a.components)

    def subtree(self, archetype: str) -> frozenset[str]:
        out, grown = {archetype}, True
        while grown:
            more = {a.name for a in self.archetypes.values() if a.parent in out} - out
            out, grown = out | more, bool(more)
        return frozenset(out)

    def having(self, component: str) -> frozenset[str]:
        if component not in self.components:
            raise KeyError(component)
        return frozenset(a for a in self.archetypes if component in self.slots(a))

    def bit(self, archetype: str, component: str) -> int | None:
        slots = self.slots(archetype)
        return 1 << slots.index(component) if component in slots else None

    def check_reference(self, source: str, field_name: str, target: str) -> Field:
        """A navigation's field must be an indexed foreign key to the target component."""
        f = self.components[source][field_name]
        if f.references is None:
            raise ValueError(f"{source}.{field_name} is not a foreign key")
        if f.references != target:
            raise ValueError(f"{source}.{field_name} refers to {f.references}, not {target}")
        if f.index != "multi":
            raise ValueError(f"{source}.{field_name} needs an index of many values")
        return f

    # The registry as tables.
    def archetype_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a.name, a.id, a.parent, a.revision, list(self.slots(a.name))) for a in self.archetypes.values()]
        return spark.createDataFrame(rows, "archetype string, archetype_id int, parent string, revision int, components array<string>")

    def field_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.revision, c.mode, f.id, f.name, f.type, f.size, f.index, f.references) for c in self.components.values() for f in c.fields]
        return spark.createDataFrame(rows, "component string, revision int, mode string, field_id int, field string, type string, bytes int, `index` string, references string")


def assign_ids(new: Component, old: Component | None = None) -> Component:
    """Give each field its id: its explicit one, or that of the old field of its name, or of its previous name, or the
    next free one."""
    by_name = {f.name: f.id for f in old.fields} if old else {}
    by_id = {f.id: f.name for f in old.fields} if old else {}
    used = set(by_id) | {f.id for f in new.fields if f.id is not None}
    out, free = [], 0
    for f in new.fields:
        if f.id is not None:
            if by_id.get(f.id, f.name) not in (f.name, f.previous_name):
                raise ValueError(f"id {f.id} of {f.name} belongs to {by_id[f.id]}")
            out.append(f)
            continue
        i = by_name.get(f.name)
        if i is None and f.previous_name:
            i = by_name.get(f.previous_name)
        if i is None:
            while free in used:
                free += 1
            i = free
        used.add(i)
        out.append(replace(f, id=i))
    return replace(new, fields=tuple(out))


LEVELS = ("Identical", "InformationOnly", "Compatible", "CompatibleWidening", "Breaking")


@dataclass(frozen=True)
class Change:
    kind: str
    field: str
    field_id: int
    level: str
    old: str | None = None
    new: str | None = None


def compare(old: Component, new: Component) -> list[Change]:
    """Changes between revisions, fields matched by id."""
    new = assign_ids(new, old)
    a, b = ({f.id: f for f in c.fields} for c in (old, new))
    place = lambda c: dict(zip((f.id for f in c.fields), _offsets(c)))
    at_old, at_new = place(old), place(new)
    out = []
    for i, f in a.items():
        g = b.get(i)
        if g is None:
            out.append(Change("Removed", f.name, i, "Compatible", f.type))
            continue
        if f.name != g.name:
            out.append(Change("Renamed", g.name, i, "InformationOnly", f.name, g.name))
        if f.type != g.type:
            wide = (f.type, g.type) in WIDENINGS
            out.append(Change("TypeWidened" if wide else "TypeChanged", g.name, i, "CompatibleWidening" if wide else "Breaking", f.type, g.type))
        if at_old[i] != at_new[i]:
            out.append(Change("OffsetChanged", g.name, i, "Compatible", str(at_old[i]), str(at_new[i])))
        if f.size != g.size:
            out.append(Change("SizeChanged", g.name, i, "Compatible", str(f.size), str(g.size)))
        if f.index != g.index:
            kind = "IndexAdded" if f.index is None else "IndexRemoved" if g.index is None else "IndexTypeChanged"
            out.append(Change(kind, g.name, i, "Compatible", f.index, g.index))
    out += [Change("Added", g.name, i, "Compatible", None, g.type) for i, g in b.items() if i not in a]
    return out


def _offsets(c: Component) -> list[int]:
    out, at = [], 0
    for f in c.fields:
        out.append(at)
        at += f.size
    return out


def level(changes: Iterable[Change]) -> str:
    return LEVELS[max((LEVELS.index(c.level) for c in changes), default=0)]


def validate(old: Component, new: Component, migrations: Migrations | None = None) -> tuple[str, str]:
    """(level, what opening a store of old with new would do): nothing, a projection, a migration that is registered, or a
    refusal. No rows are read."""
    worst = level(compare(old, new))
    if worst == "Breaking":
        path = migrations.path(new.name, old.revision, new.revision) if migrations is not None else None
        return worst, "refuse" if path is None else "migrate " + " to ".join(map(str, path))
    return worst, "open" if worst == LEVELS[0] else "project"


def evolve(df: DataFrame, old: Component, new: Component, defaults: dict[str, object] | None = None, strict: bool = True) -> DataFrame:
    """Rows of old as rows of new, by field id: renamed, widened and added fields in one projection.

    strict: a breaking change raises; else its field is cast where that works and null where not.
    """
    changes = compare(old, new)
    if strict and level(changes) == "Breaking":
        raise ValueError("breaking: " + ", ".join(c.field for c in changes if c.level == "Breaking"))
    before = {f.id: f for f in old.fields}
    cols: list[Column] = [F.col(c) for c in df.columns if c not in {f.name for f in old.fields}]
    for f in assign_ids(new, old).fields:
        if f.id in before:
            src = F.col(before[f.id].name)
            cols.append((src if before[f.id].type == f.type else src.try_cast(f.spark_type)).alias(f.name))
        else:
            cols.append(F.lit((defaults or {}).get(f.name)).cast(f.spark_type).alias(f.name))
    return df.select(*cols)


@dataclass
class Migrations:
    """Functions from a DataFrame of one revision to one of another, chained by the shortest path."""

    steps: dict[tuple[str, int, int], Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, component: str, start: int, end: int, step: Callable[[DataFrame], DataFrame]) -> None:
        if (component, start, end) in self.steps:
            raise ValueError(f"{component} {start} to {end} is registered")
        self.steps[component, start, end] = step

    def path(self, component: str, start: int, end: int) -> list[int] | None:
        seen, queue = {start: None}, deque([start])
        while queue:
            at = queue.popleft()
            if at == end:
                out = [at]
                while seen[out[-1]] is not None:
                    out.append(seen[out[-1]])
                return out[::-1]
            for c, s, e in sorted(self.steps):
                if c == component and s == at and e not in seen:
                    seen[e] = at
                    queue.append(e)
        return None

    def migrate(self, df: DataFrame, component: str, start: int, end: int) -> DataFrame:
        path = self.path(component, start, end)
        if path is None:
            raise ValueError(f"no migration of {component} from {start} to {end}")
        for s, e in zip(path, path[1:]):
            df = self.steps[component, s, e](df)
        return df


def migrate_rows(df: DataFrame, migrate: Callable, schema: str | T.StructType) -> DataFrame:
    """Rows through a Python function of a dict; one that fails keeps its old fields of the same names, and the reason in
    `error`."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kind.fields]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    rows.append({**migrate(row), "error": None})
                except Exception as e:  # the failure is the result
                    rows.append({**{n: row.get(n) for n in names}, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return df.mapInPandas(run, T.StructType([*kind.fields, T.StructField("error", T.StringType())]))
