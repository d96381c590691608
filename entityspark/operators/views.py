"""Views: an entity set kept up to date, and what a refresh added, removed and modified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dnf import Predicate, branch_bitmap


def diff(before: DataFrame, after: DataFrame, key: str, bits: str | None = None) -> DataFrame:
    """(key, kind) between two sets: Added, Removed; with a bitmap column, Modified where it changed."""
    cols = [key] + ([bits] if bits else [])
    a = before.select(key, F.lit(True).alias("__was"), *([F.col(bits).alias("__a")] if bits else []))
    b = after.select(*cols, F.lit(True).alias("__is"))
    x = a.join(b, key, "full")
    changed = F.col("__was") & F.col("__is") & (F.col("__a") != F.col(bits)) if bits else F.lit(False)
    kind = F.when(F.col("__was").isNull(), "Added").when(F.col("__is").isNull(), "Removed").when(changed, "Modified")
    return x.select(key, kind.alias("kind")).where("kind is not null")


def crossings(changes: DataFrame, key: str, was: Column, now: Column) -> DataFrame:
    """A change feed with before and after images against one predicate: out to in Added, in to out Removed, in to in
    Modified, out to out nothing. Only changed rows are looked at."""
    w, n = F.coalesce(was, F.lit(False)), F.coalesce(now, F.lit(False))
    kind = F.when(~w & n, "Added").when(w & ~n, "Removed").when(w & n, "Modified")
    return changes.select(*changes.columns, kind.alias("kind")).where("kind is not null")


def compact(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """The net change of each key from a run of changes.

    Added then Removed cancel; Added then Modified stays Added; Modified then Removed is Removed; Removed then Added
    is Modified. So the first and the last change decide: was it there before, is it there after.
    """
    # Changes with one order count as Added, Modified, Removed in turn, so reruns agree.
    turn = F.struct(F.col(order), F.array_position(F.array(*map(F.lit, ("Added", "Modified", "Removed"))), F.col("kind")))
    first, last = F.min_by("kind", turn), F.max_by("kind", turn)
    x = deltas.groupBy(key).agg(first.alias("__f"), last.alias("__l"))
    was, now = F.col("__f") != "Added", F.col("__l") != "Removed"
    kind = F.when(~was & now, "Added").when(was & ~now, "Removed").when(was & now, "Modified")
    return x.select(key, kind.alias("kind")).where("kind is not null")


def field_changes(log: DataFrame, fields: list[str]) -> DataFrame:
    """The entries of a change log that a view over these fields must see: its fields, creations and deletions."""
    return log.where(F.col("field").isin(*fields) | F.col("op").isin("create", "delete"))


def affected_sources(changed_sources: DataFrame, changed_targets: DataFrame, sources: DataFrame, source_key: str, reference: str, target_key: str) -> DataFrame:
    """Keys of a navigation view to look at again: changed sources, and the sources of changed targets."""
    behind = sources.where(F.col(reference) != 0).join(changed_targets.select(F.col(target_key).alias(reference)).distinct(), reference, "left_semi").select(source_key)
    return changed_sources.select(source_key).union(behind).distinct()


class View:
    """A set of keys with a delta since the last refresh. The set is a DataFrame; a refresh composes, and reads nothing.

    query(rows) gives the rows of the view, `key` among them; a predicate with several branches is kept as a bitmap, so
    that a change of branch shows as Modified.
    """

    def __init__(self, key: str, query: Callable[[DataFrame], DataFrame] | Predicate):
        self.key, self.query = key, query
        self.members: DataFrame | None = None
        self._delta: DataFrame | None = None

    def _rows(self, rows: DataFrame) -> DataFrame:
        if isinstance(self.query, Predicate):
            return rows.select(self.key, branch_bitmap(self.query).alias("bits")).where("bits <> 0")
        return self.query(rows).select(self.key).distinct()

    def refresh(self, rows: DataFrame) -> DataFrame:
        """Take a new snapshot of all rows: the full re-query, and its difference."""
        new = self._rows(rows)
        old = self.members if self.members is not None else new.where(F.lit(False))
        self._delta = diff(old, new, self.key, "bits" if isinstance(self.query, Predicate) else None)
        self.members = new
        return self._delta

    def apply(self, changed: DataFrame) -> DataFrame:
        """Take only changed rows, `op` 'delete' for those gone: work in proportion to the change, but for the set.

        The result is the same as a refresh over all rows; in a view without a bitmap, rows changed inside it count as
        Modified besides.
        """
        if self.members is None:
            raise ValueError("refresh the view once before changes")
        touched = changed.select(self.key)
        now = self._rows(changed.where("op <> 'delete'"))
        was = self.members.join(touched, self.key, "left_semi")
        if isinstance(self.query, Predicate):
            self._delta = diff(was, now, self.key, "bits")
        else:
            both = was.select(self.key).join(now.select(self.key), self.key, "left_semi").select(self.key, F.lit("Modified").alias("kind"))
            self._delta = diff(was, now, self.key).unionByName(both)
        self.members = self.members.join(touched, self.key, "left_anti").unionByName(now)
        return self._delta

    @property
    def delta(self) -> DataFrame | None:
        return self._delta

    def clear_delta(self) -> None:
        self._delta = None

    def contains(self, key) -> bool:
        return self.members is not None and not self.members.where(F.col(self.key) == key).isEmpty()

    def count(self) -> int:
        return 0 if self.members is None else self.members.count()

    def checkpoint(self) -> None:
        """Cut the lineage, which grows with each apply."""
        if self.members is not None:
            self.members = self.members.checkpoint()


class DeltaBuffer:
    """Changes that wait for a view, up to a number of rows; beyond it they are dropped, and the view is queried again.

    A flush gives the net change of each key. After an overflow rows inside the view before and after are no change.
    """

    def __init__(self, view: View, capacity: int = 4096):
        self.view, self.capacity = view, capacity
        self.frames: list[DataFrame] = []
        self.size, self.overflowed = 0, False

    def push(self, changed: DataFrame) -> None:
        if self.overflowed:
            return
        self.size += changed.limit(self.capacity + 1).count()
        self.frames.append(changed)
        if self.size > self.capacity:
            self.frames, self.overflowed = [], True

    def flush(self, rows: DataFrame) -> DataFrame:
        """The view's change since the last flush; rows is the state now, read after an overflow only."""
        frames, over = self.frames, self.overflowed
        self.frames, self.size, self.overflowed = [], 0, False
        if over or not frames:
            return self.view.refresh(rows) if over else self.view.members.select(self.view.key, F.lit("").alias("kind")).where("false")
        deltas = None
        for k, f in enumerate(frames):
            d = self.view.apply(f).withColumn("__turn", F.lit(k))
            deltas = d if deltas is None else deltas.unionByName(d)
        return compact(deltas, self.view.key, "__turn")


def change_log(before: DataFrame, after: DataFrame, key: str, fields: list[str], tsn: int) -> DataFrame:
    """(key, field, before, after, tsn, op) of all fields that differ between two states."""
    a = before.select(key, F.struct(*fields).alias("__a"))
    b = after.select(key, F.struct(*fields).alias("__b"))
    x = a.join(b, key, "full")
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.col("__a")[f].cast("string").alias("before"), F.col("__b")[f].cast("string").alias("after"))
    op = F.when(F.col("__a").isNull(), "create").when(F.col("__b").isNull(), "delete").otherwise("update")
    each = x.select(key, op.alias("op"), F.explode(F.array(*map(entry, fields))).alias("e"))
    return each.where(~F.col("e.before").eqNullSafe(F.col("e.after"))).select(key, "e.field", "e.before", "e.after", F.lit(tsn).cast("long").alias("tsn"), "op")


def latest_streak(ticks: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Length of the run of equal flags that each row ends: gaps and islands."""
    w = Window.partitionBy(*by).orderBy(order)
    x = ticks.withColumn("__f", flag).withColumn("__s", (F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "__f").orderBy(order))))
    return x.withColumn("streak", F.row_number().over(Window.partitionBy(*by, "__f", "__s").orderBy(order))).drop("__f", "__s")
