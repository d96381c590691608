"""Versioned rows: visibility, writes, conflicts, cascades, constraints.

A history has a row for each version. Entities carry born and died (0: never died); values carry tsn and active. A
write appends rows, and a reader picks what its snapshot sees, so nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entity_id
from .ranges import ranked


def visible(tsn: Column | int, born: str = "born", died: str = "died") -> Column:
    """born 0 is seen always; died 0 is alive still."""
    t = tsn if isinstance(tsn, Column) else F.lit(tsn)
    return ((F.col(born) == 0) | (F.col(born) <= t)) & ((F.col(died) == 0) | (F.col(died) > t))


def read_status(history: DataFrame, key: str, value: int, tsn: int, born: str = "born", died: str = "died") -> DataFrame:
    """Success, NotFound, SnapshotInvisible or Deleted for one key at a snapshot."""
    state = F.when(visible(tsn, born, died), 3).when((F.col(died) != 0) & (F.col(died) <= tsn), 2).otherwise(1)
    best = F.coalesce(F.max(state), F.lit(0))
    return history.where(F.col(key) == value).agg(F.when(best == 3, "Success").when(best == 2, "Deleted").when(best == 1, "SnapshotInvisible").otherwise("NotFound").alias("status"))


def snapshot(history: DataFrame, tsn: int, born: str = "born", died: str = "died") -> DataFrame:
    return history.where(visible(tsn, born, died))


def latest(history: DataFrame, keys: list[str], tsn: int | None = None, order: str = "tsn", active: str | None = "active") -> DataFrame:
    """The newest version of each key up to tsn, if it is active; of versions with one tsn the greatest row, column by
    column, so reruns agree.

    The maximum combines before the shuffle, so a key with very many versions costs one row a task; the other columns
    are packed in one struct. Columns that can't be compared, such as maps, don't decide ties.
    """
    h = history if tsn is None else history.where(F.col(order) <= tsn)
    rest = [c for c in history.columns if c not in keys]
    ties = [c for c in rest if c != order and "map<" not in dict(history.dtypes)[c] and dict(history.dtypes)[c] != "variant"]
    top = h.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *ties)).alias("__v"))
    out = top.select(*keys, *[F.col("__v")[c].alias(c) for c in rest])
    return out.where(F.col(active)) if active else out


class PointInTime:
    """Reads of many tables at one snapshot, which can move on."""

    def __init__(self, tables: dict[str, DataFrame], tsn: int):
        self.tables, self.tsn = tables, tsn

    def __getitem__(self, name: str) -> DataFrame:
        return snapshot(self.tables[name], self.tsn)

    def attach(self, name: str, history: DataFrame) -> PointInTime:
        return PointInTime({**self.tables, name: history}, self.tsn)

    def advance(self, tsn: int) -> PointInTime:
        if tsn < self.tsn:
            raise ValueError("a snapshot moves on only")
        return PointInTime(self.tables, tsn)


def spawn(rows: DataFrame, archetype_id: int, first_key: int, order: list[str], tsn: int) -> DataFrame:
    """New entities with ids from first_key on, in the order given, born at tsn; ids are dense, and reruns agree if no
    two rows are equal in the order."""
    out = ranked(rows, order, "__key", first_key, "spawned").withColumn("entity_id", entity_id(F.col("__key"), archetype_id)).drop("__key")
    return out.withColumn("born", F.lit(tsn).cast("long")).withColumn("died", F.lit(0).cast("long"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with each changed key's last version."""
    last = latest(changes, keys, order=order, active=None)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*base.columns))


def destroy(history: DataFrame, ids: DataFrame, key: str, tsn: int) -> DataFrame:
    """History with these entities dead from tsn on, if they were alive."""
    hit = history.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return hit.withColumn("died", F.when(F.col("__hit") & (F.col("died") == 0), F.lit(tsn).cast("long")).otherwise(F.col("died"))).drop("__hit")


def cascade(roots: DataFrame, links: list[tuple[DataFrame, str, str]], depth: int = 32, most: int | None = 100_000) -> DataFrame:
    """(id, depth): roots(id) and all that a deletion takes along.

    links: (children, their id column, their parent column) for each reference that deletes with its parent. One round
    a level, each a semi-join on the last level only; cycles end, since what is known isn't followed again.
    """
    known = roots.select("id", F.lit(0).alias("depth")).distinct()
    last, total = known, None
    for d in range(1, depth + 1):
        new = None
        for children, own, parent in links:
            step = children.where(F.col(parent).isNotNull() & (F.col(parent) != 0)).select(F.col(own).alias("id"), F.col(parent).alias("__parent")).join(last.select(F.col("id").alias("__parent")), "__parent", "left_semi").select("id")
            new = step if new is None else new.union(step)
        last = new.distinct().join(known, "id", "left_anti").select("id", F.lit(d).alias("depth")).checkpoint()
        if last.isEmpty():
            return known
        known = known.union(last)
        if most is not None:
            total = known.count()
            if total > most:
                raise ValueError(f"a deletion takes {total} entities; {most} at most")
    raise ValueError(f"a deletion goes deeper than {depth} levels")


def set_enabled(df: DataFrame, bit: int, on: bool, where: Column | None = None) -> DataFrame:
    new = F.col("enabled").bitwiseOR(bit) if on else F.col("enabled").bitwiseAND(~bit)
    return df.withColumn("enabled", new if where is None else F.when(where, new).otherwise(F.col("enabled")))


def merge_conflicts(read: DataFrame, committed: DataFrame, committing: DataFrame, keys: list[str], fields: list[str], resolve: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """What a commit writes: a three-way join on the keys.

    read: what the transaction read; committed: what stands now; committing: its writes. A row conflicts if what stands
    differs from what was read. Without a handler the last writer wins; resolve(read, committed, committing) gives a
    field's value from the three otherwise.
    """
    named = lambda df, n: df.select(*keys, F.struct(*fields).alias(n))
    x = named(committing, "mine").join(named(committed, "now"), keys, "left").join(named(read, "base"), keys, "left")
    conflict = F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("base"))
    pick = resolve or (lambda base, now, mine: mine)
    out = [F.when(conflict, pick(F.col("base")[f], F.col("now")[f], F.col("mine")[f])).otherwise(F.col("mine")[f]).alias(f) for f in fields]
    return x.select(*keys, *out, conflict.alias("conflict"))


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def index_range(df: DataFrame, key: str, low, high, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Rows with low <= key <= high in the key's order; a bound of None is open. The filter reaches the scan."""
    for bound, op in ((low, "__ge__"), (high, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col(key), op)(bound))
    return df.orderBy(F.desc(key) if descending else F.asc(key), *([tie] if tie else []))


def index_point(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with the key; the comparison reaches the scan."""
    return df.where(F.col(key) == value)


def collect_values(df: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """(key, into): the values of each key as one collection, in ascending order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(into))


def append(df: DataFrame, collection: str, *values) -> DataFrame:
    """Values added at a collection's end."""
    out = F.concat(F.col(collection), F.array(*map(F.lit, values)).cast(dict(df.dtypes)[collection]))
    return df.withColumn(collection, out)


def elements(df: DataFrame, key: str, collection: str, into: str) -> DataFrame:
    """(key, at, into): a row for each element with its place, from 0."""
    return df.select(key, F.posexplode(collection).alias("at", into))


def index_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def version_chain(history: DataFrame, key: str, value=None, order: str = "tsn") -> DataFrame:
    """Versions with their number, oldest first, and when the next one replaced them."""
    h = history if value is None else history.where(F.col(key) == value)
    w = Window.partitionBy(key).orderBy(order)
    return h.withColumn("version", F.row_number().over(w)).withColumn("replaced", F.lead(order).over(w))


def chain_statistics(history: DataFrame, key: str) -> DataFrame:
    n = history.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("chains"), F.sum("n").alias("versions"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))
