"""A small command layer over a world: literals in braces, create, read, update, delete, and output formats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from ..operators.entities import World

_PAIR = re.compile(r"""\s*(\w+)\s*[:=]\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,}]+)\s*(?:,|(?=\}))""")


def parse_literal(text: str) -> dict[str, object]:
    """{ A: 1, B = 2.5, Name: "x" } as a dict: whole numbers, fractions, booleans and strings."""
    text = text.strip()
    if not (text.startswith("{") and text.endswith("}")):
        raise ValueError("a literal stands in braces")
    out, at = {}, 1
    while text[at:].strip() != "}":
        m = _PAIR.match(text, at)
        if m is None:
            raise ValueError(f"not a field: {text[at:]}")
        out[m[1]], at = _value(m[2].strip()), m.end()
    return out


def _value(s: str) -> object:
    if s[0] in "\"'":
        return re.sub(r"\\(.)", r"\1", s[1:-1])
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    return int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s)


class Shell:
    """Commands of one transaction over a world; commit() gives the world with them, rollback() that without."""

    def __init__(self, world: World, next_key: int):
        self.base, self.world, self.next_key = world, world, next_key

    def create(self, archetype: str, **components: dict | str) -> int:
        r = self.world.registry
        given = {c: parse_literal(v) if isinstance(v, str) else v for c, v in components.items()}
        slots = r.slots(archetype)
        if unknown := set(given) - set(slots):
            raise KeyError(f"{archetype} has no {sorted(unknown)[0]}")
        key, self.next_key = self.next_key, self.next_key + 1
        id_ = key << 12 | r.archetypes[archetype].id
        df = self.world.tables[archetype]
        on = sum(1 << i for i, c in enumerate(slots) if c in given)
        row = {"entity_id": id_, "enabled": on} | {c: given.get(c) for c in slots}
        kind = T.StructType([f for f in df.schema.fields])
        values = tuple(tuple(row[f.name].get(x.name) for x in f.dataType.fields) if isinstance(f.dataType, T.StructType) and row.get(f.name) else row.get(f.name) for f in kind.fields)
        self._set(archetype, df.unionByName(df.sparkSession.createDataFrame([values], kind)))
        return id_

    def read(self, id_: int) -> DataFrame:
        return self.world.open(id_)

    def update(self, id_: int, component: str, literal: dict | str) -> None:
        new = parse_literal(literal) if isinstance(literal, str) else literal
        name = self._archetype(id_)
        df = self.world.tables[name]
        c = F.col(component)
        for f, v in new.items():
            kind = next(x.dataType for x in df.schema[component].dataType.fields if x.name == f)
            c = c.withField(f, F.lit(v).cast(kind))
        self._set(name, df.withColumn(component, F.when(F.col("entity_id") == id_, c).otherwise(F.col(component))))

    def delete(self, id_: int) -> None:
        name = self._archetype(id_)
        self._set(name, self.world.tables[name].where(F.col("entity_id") != id_))

    def commit(self) -> World:
        self.base = self.world
        return self.world

    def rollback(self) -> World:
        self.world = self.base
        return self.world

    def _archetype(self, id_: int) -> str:
        return next(a.name for a in self.world.registry.archetypes.values() if a.id == id_ & 0xFFF)

    def _set(self, archetype: str, df: DataFrame) -> None:
        self.world = World(self.world.registry, {**self.world.tables, archetype: df})


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def as_csv(df: DataFrame) -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns)).alias("line"))


def as_table(df: DataFrame, rows: int = 50, width: int = 40) -> str:
    """The first rows as aligned text."""
    cells = [list(df.columns)] + [["" if v is None else str(v)[:width] for v in r] for r in df.limit(rows).collect()]
    sizes = [max(map(len, col)) for col in zip(*cells)]
    line = lambda r: " | ".join(v.ljust(n) for v, n in zip(r, sizes)).rstrip()
    return "\n".join([line(cells[0]), "-+-".join("-" * n for n in sizes), *map(line, cells[1:])])



