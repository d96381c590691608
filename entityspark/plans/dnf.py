"""Predicates over component fields: comparisons, their normal form, and estimates of what they select."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import compare

FLIP = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
INVERT = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def branches(self) -> list[list[Cmp]]:
        """Disjunctive normal form: an or of ands."""
        raise NotImplementedError

    def negated(self) -> Predicate:
        raise NotImplementedError

    def column(self) -> Column:
        return any_of([all_of(b) for b in self.branches()])

    def components(self) -> set[str]:
        return {c.component for b in self.branches() for c in b}


def all_of(cmps: list[Cmp]) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in cmps], F.lit(True)) if len(cmps) != 1 else cmps[0].column()


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


@dataclass(frozen=True, eq=False)
class Cmp(Predicate):
    component: str
    field: str
    op: str
    value: object

    def branches(self):
        return [[self]]

    def negated(self):
        """The opposite comparison, which a NaN fails as well."""
        return Cmp(self.component, self.field, INVERT[self.op], self.value)

    def column(self) -> Column:
        x = F.col(self.component)[self.field] if self.component else F.col(self.field)
        y = self.value.ref() if isinstance(self.value, FieldRef) else self.value
        return compare(x, self.op, y, floating=isinstance(self.value, float))


@dataclass(frozen=True, eq=False)
class And(Predicate):
    parts: tuple

    def branches(self):
        return reduce(lambda out, p: [[*a, *b] for a in out for b in p.branches()], self.parts, [[]])

    def negated(self):
        return Or(tuple(p.negated() for p in self.parts))


@dataclass(frozen=True, eq=False)
class Or(Predicate):
    parts: tuple

    def branches(self):
        return [b for p in self.parts for b in p.branches()]

    def negated(self):
        return And(tuple(p.negated() for p in self.parts))


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    part: Predicate

    def branches(self):
        return self.part.negated().branches()

    def negated(self):
        return self.part


@dataclass(frozen=True, eq=False)
class FieldRef:
    """A field of a component; comparing it makes a predicate, with the constant on either side."""

    component: str
    field: str

    def ref(self) -> Column:
        return F.col(self.component)[self.field] if self.component else F.col(self.field)

    def _cmp(self, op: str, value) -> Cmp:
        return Cmp(self.component, self.field, op, value)

    def __eq__(self, v):
        return self._cmp("==", v)

    def __ne__(self, v):
        return self._cmp("!=", v)

    def __lt__(self, v):
        return self._cmp("<", v)

    def __le__(self, v):
        return self._cmp("<=", v)

    def __gt__(self, v):
        return self._cmp(">", v)

    def __ge__(self, v):
        return self._cmp(">=", v)

    __hash__ = None


def field(path: str) -> FieldRef:
    """'Component.field', or 'field' for a plain column."""
    component, _, name = path.rpartition(".")
    return FieldRef(component, name)


def flipped(value, op: str, f: FieldRef) -> Cmp:
    """value op field, with the constant moved to the right."""
    return f._cmp(FLIP[op], value)


def branch_bitmap(p: Predicate, most: int = 16) -> Column:
    """Bit k is set where branch k of the normal form holds."""
    branches = p.branches()
    if len(branches) > most:
        raise ValueError(f"{len(branches)} branches; {most} at most")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(all_of(b), F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(branches)])


@dataclass(frozen=True)
class FieldStatistics:
    """What estimates need of one field: least and greatest value, equal-width buckets and the commonest values."""

    low: float
    high: float
    total: int
    buckets: tuple[int, ...]
    common: dict

    def range(self, low: float, high: float) -> int:
        """Rows between, with shares of the buckets at both ends."""
        if not self.total or low > high:
            return 0
        if self.high == self.low:
            return self.total if low <= self.low <= high else 0
        width = (self.high - self.low) / len(self.buckets)
        share = lambda k: max(0.0, min(high, self.low + (k + 1) * width) - max(low, self.low + k * width)) / width
        return int(round(sum(n * min(1.0, share(k)) for k, n in enumerate(self.buckets))))

    def equal(self, value) -> int:
        if value in self.common:
            return self.common[value]
        if self.high == self.low:
            return self.total if value == self.low else 0
        if not self.low <= value <= self.high:
            return 0
        k = min(len(self.buckets) - 1, int((value - self.low) / (self.high - self.low) * len(self.buckets)))
        return 1 if self.buckets[k] else 0

    def estimate(self, op: str, value) -> int:
        if op == "==":
            return self.equal(value)
        if op == "!=":
            return max(0, self.total - self.equal(value))
        return self.range(value, self.high) if op in (">", ">=") else self.range(self.low, value)


def by_selectivity(branch: list[Cmp], statistics: dict[str, FieldStatistics]) -> list[tuple[Cmp, int]]:
    """The comparisons of a branch with their estimates, the most selective first."""
    known = [(c, statistics[c.field].estimate(c.op, c.value)) for c in branch]
    return sorted(known, key=lambda x: (x[1], x[0].field))
