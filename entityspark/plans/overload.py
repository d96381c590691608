"""How a runtime under load steps its service down and up again."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The levels in order, and the tick multipliers that level 3 walks through.
LEVELS = ("Normal", "SystemThrottling", "ScopeReduction", "TickRateModulation", "PlayerShedding")
MULTIPLIERS = (1, 2, 3, 4, 6)
_RATE = 3


@dataclass(frozen=True)
class Limits:
    overrun: float = 1.2
    underrun: float = 0.6
    up_after: int = 5
    down_after: int = 20
    queue_growth: int = 5
    base_rate: int = 60
    least_rate: int = 10


@dataclass
class Overload:
    """Level and multiplier after each tick's ratio of time used and depth of the event queue."""

    limits: Limits = field(default_factory=Limits)
    level: int = 0
    step: int = 0
    over: int = 0
    under: int = 0
    growing: int = 0
    depth: int | None = None

    @property
    def allowed(self) -> tuple[int, ...]:
        return tuple(m for m in MULTIPLIERS if m == 1 or m <= self.limits.base_rate / self.limits.least_rate)

    @property
    def multiplier(self) -> int:
        return self.allowed[self.step]

    def update(self, ratio: float, depth: int = 0) -> bool:
        """True if the level changed. Between the two thresholds the counters stay as they are."""
        lim, was = self.limits, self.level
        rising = self.depth is not None and lim.queue_growth > 0 and depth > self.depth
        self.growing = self.growing + 1 if rising else 0
        self.depth = depth
        if ratio > lim.overrun or (rising and self.growing >= lim.queue_growth):
            self.over, self.under = self.over + 1, 0
            if self.over >= lim.up_after:
                self.over = 0
                self._up()
        elif ratio < lim.underrun:
            self.over, self.under = 0, self.under + 1
            if self.under >= lim.down_after:
                self.under = 0
                self._down()
        return self.level != was

    def _up(self) -> None:
        last = len(self.allowed) - 1
        if self.level == _RATE and self.step < last:
            self.step += 1
        elif self.level < len(LEVELS) - 1:
            self.level += 1
            if self.level == _RATE and last:
                self.step = 1

    def _down(self) -> None:
        if self.level == _RATE and self.step > 1:
            self.step -= 1
            return
        if self.level == _RATE:
            self.step = 0
        self.level = max(0, self.level - 1)
