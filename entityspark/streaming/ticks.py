"""The tick loop: a schedule of systems over DataFrames, one batch a tick, in batch or as a stream's foreachBatch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.overload import Overload
from ..plans.schedule import Skip, System, derive, order, skip_reason


class QueueFull(RuntimeError):
    pass


@dataclass
class EventQueue:
    """Rows that a tick's producers push for its consumers; bounded by rows, empty at the next tick."""

    schema: str
    capacity: int = 1024
    frames: list[DataFrame] = field(default_factory=list)
    size: int = 0

    def push(self, rows: DataFrame) -> None:
        n = rows.count()
        if self.size + n > self.capacity:
            raise QueueFull(f"{self.size + n} events; {self.capacity} at most")
        self.frames.append(rows)
        self.size += n

    def drain(self) -> DataFrame | None:
        out = None
        for f in self.frames:
            out = f if out is None else out.unionByName(f)
        self.frames = []
        self.size = 0
        return out

    def reset(self) -> None:
        self.frames, self.size = [], 0


def in_tier(df: DataFrame, tier: Column | str, mask: int) -> DataFrame:
    return df.where((F.col(tier) if isinstance(tier, str) else tier).bitwiseAND(mask) != 0)


def cell_turn(df: DataFrame, bucket: Column, share: int, tick: int) -> DataFrame:
    """1/share of the cells at each tick, in turn."""
    return df.where(F.pmod(bucket, F.lit(share)) == tick % share)


def checkerboard(df: DataFrame, cx: str, cy: str, phase: int) -> DataFrame:
    """The cells of one colour, so that no two neighbours are worked on at once."""
    return df.where(F.pmod(F.col(cx) + F.col(cy), F.lit(2)) == phase)


def changed_in(view: DataFrame, changes: DataFrame, components: Iterable[str], key: str = "entity_id") -> DataFrame:
    """The view's entities of which one of the components changed."""
    touched = changes.where(F.col("component").isin(*components)).select(key)
    return view.join(touched, key, "left_semi")


@dataclass
class Context:
    tick: int
    state: dict
    queues: dict[str, EventQueue]
    changes: DataFrame | None = None
    input: DataFrame | None = None


class Runtime:
    """Runs a schedule tick by tick; keeps a row of telemetry for each system and tick."""

    def __init__(self, systems: list[System], phases: list[str] = ("input", "update", "output"), queues: dict[str, EventQueue] | None = None, target_seconds: float = 1.0, ring: int = 1024, modes: dict[str, str] | None = None):
        for s in systems:
            if any((modes or {}).get(c) == "versioned" for c in s.changed):
                raise ValueError(f"{s.name} filters by changes of a versioned component")
        flat = [p for s in systems for p in (s.parts or [s])]
        self.edges = derive(flat, list(phases))
        self.layers = order(self.edges)
        self.systems = {s.name: s for s in flat}
        self.queues, self.overload, self.tick = queues or {}, Overload(), 0
        self.target, self.ring, self.telemetry = target_seconds, ring, []

    def run(self, state: dict, changes: DataFrame | None = None, load: float | None = None) -> dict[str, Skip]:
        """One tick. load: time used over time allowed, measured if not given."""
        began, outcome, failed = time.monotonic(), {}, set()
        for layer in self.layers:
            for name in layer:
                s = self.systems[name]
                ctx = Context(self.tick, state, self.queues, changes)
                upstream = any(name in self.edges[f] for f in failed)
                wanted = s.run_if is None or bool(s.run_if(ctx))
                empty = False
                if not upstream and wanted and s.view is not None:
                    ctx.input = s.view(state)
                    if s.changed:
                        ctx.input = changed_in(ctx.input, changes, s.changed) if changes is not None else ctx.input.limit(0)
                    if s.tier is not None:
                        ctx.input = in_tier(ctx.input, "tier", s.tier)
                    if s.cell_share > 1:
                        ctx.input = cell_turn(ctx.input, F.col("cell_key"), s.cell_share, self.tick)
                    empty = ctx.input.isEmpty()
                why = skip_reason(s, self.tick, self.overload.level, upstream, wanted, empty)
                start = time.monotonic()
                if why is Skip.RUN:
                    try:
                        for phase in (0, 1) if s.checkerboard else (None,):
                            if phase is not None:
                                ctx.input = checkerboard(s.view(state), "cx", "cy", phase)
                            state.update(s.run(ctx) or {})
                    except Exception:
                        failed.add(name)
                        outcome[name] = None
                        self._note(name, "Failed", start)
                        continue
                elif why is Skip.DEPENDENCY_FAILED:
                    failed.add(name)
                outcome[name] = why
                self._note(name, why.name, start)
        for q in self.queues.values():
            q.reset()
        used = (time.monotonic() - began) / self.target
        self.overload.update(used if load is None else load, 0)
        self.tick += 1
        return outcome

    def _note(self, name: str, what: str, start: float) -> None:
        self.telemetry.append((self.tick, name, what, int((time.monotonic() - start) * 1e6), self.overload.level))
        del self.telemetry[: -self.ring]

    def telemetry_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.telemetry, "tick int, system string, outcome string, micros long, level int")

    def each_batch(self, state: dict, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: each micro-batch is a tick, and its rows the tick's changes."""

        def run(batch: DataFrame, batch_id: int) -> None:
            state["batch"] = batch
            self.run(state, prepare(batch))

        return run
