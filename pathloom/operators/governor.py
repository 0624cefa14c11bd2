"""The resource governor: how much background work the samples of a machine allow, as a fold over its signals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

#: Thresholds of the policy.
SEARCH_SLA_MS, LOW_MEMORY, CRITICAL_MEMORY, HIGH_CPU, HIGH_DISK = 75, 1000, 500, 9000, 9000
PRESSURE_WINDOWS, RECOVERY_WINDOWS, COOLDOWN_WINDOWS, HOLD_WINDOWS, IDLE_MS = 2, 5, 3, 3, 300_000
_MIB = 1 << 20
BUDGET_FIELDS = ("maximum_batch_mutations", "maximum_batches", "maximum_run_time_millis", "writer_heap_bytes", "rebuild_page_size", "projection_concurrency", "maintenance_intensity", "background_paused")
#: Budgets by mode, in the order of BUDGET_FIELDS.
BUDGETS = {
    "active": (0, 0, 0, 32 * _MIB, 1000, 0, "paused", True),
    "balanced": (5000, 20, 5000, 64 * _MIB, 5000, 1, "normal", False),
    "idle_boost": (10_000, 100, 30_000, 128 * _MIB, 10_000, 1, "elevated", False),
    "pressure": (128, 0, 0, 32 * _MIB, 500, 0, "paused", True),
    "battery": (256, 1, 250, 32 * _MIB, 1000, 1, "minimal", False),
    "battery_saver": (0, 0, 0, 32 * _MIB, 1000, 0, "paused", True),
}


@dataclass(frozen=True)
class Sample:
    """A sample of the machine; None: not known. Shares are in ten-thousandths."""

    memory: int | None = None
    cpu: int | None = None
    disk: int | None = None
    power: str = "unknown"
    energy_saver: bool = False

    @property
    def critical(self) -> bool:
        return self.memory is not None and self.memory <= CRITICAL_MEMORY

    @property
    def pressed(self) -> bool:
        return any((self.memory is not None and self.memory <= LOW_MEMORY, self.cpu is not None and self.cpu >= HIGH_CPU, self.disk is not None and self.disk >= HIGH_DISK))


@dataclass(frozen=True)
class Governor:
    """State between signals. Signals return the next state; mode, reason and transitions are its decision."""

    mode: str = "balanced"
    reason: str = "startup"
    transitions: int = 0
    sample: Sample = Sample()
    known: bool = True
    recovering: bool = False
    user_active: bool = False
    user_idle: bool = False
    backlog: int = 0
    pressed: int = 0
    calm: int = 0
    cooldown: int = 0
    hold: int = 0

    def budget(self) -> dict:
        saver = self.mode == "battery" and self.sample.energy_saver
        return dict(zip(BUDGET_FIELDS, BUDGETS["battery_saver" if saver else self.mode], strict=True))

    def _to(self, mode: str, reason: str, **also) -> Governor:
        if mode != self.mode:
            also |= {"mode": mode, "transitions": self.transitions + 1}
            also.setdefault("cooldown", COOLDOWN_WINDOWS)
        return replace(self, reason=reason, **also)

    @property
    def _heard(self) -> bool:
        return self.known and not self.recovering

    def interactive(self) -> Governor:
        """A search begins: background work stops for a few windows."""
        held = replace(self, hold=HOLD_WINDOWS)
        return held._to("active", "user_active") if self._heard else held

    def latency(self, nanos: int) -> Governor:
        """A search ended."""
        held = replace(self, hold=HOLD_WINDOWS)
        return held._to("active", "search_sla" if -(-nanos // 1_000_000) > SEARCH_SLA_MS else "user_active") if self._heard else held

    def sampled(self, sample: Sample) -> Governor:
        """A window with a sample."""
        return replace(self, sample=sample, known=True, hold=max(0, self.hold - 1))._judged(True)

    def window(self) -> Governor:
        """A window without news."""
        return replace(self, hold=max(0, self.hold - 1))._judged(True)

    def unavailable(self) -> Governor:
        """Samples can't be had: only calm windows with samples lead out again."""
        return replace(self, sample=Sample(), known=False, recovering=True, user_idle=False, pressed=0, calm=0, hold=0)._to("pressure", "resource_telemetry_unavailable")

    def workload(self, user_active: bool, user_idle: bool, backlog: int) -> Governor:
        new = replace(self, user_active=user_active, user_idle=user_idle, backlog=backlog)
        return replace(new, hold=HOLD_WINDOWS)._to("active", "user_active") if user_active and self._heard else new

    def pending(self, backlog: int) -> Governor:
        new = replace(self, backlog=backlog)
        return new._to("balanced", "balanced", calm=0) if backlog == 0 and self.mode == "idle_boost" else new

    def idle(self, millis: int | None) -> Governor:
        new = replace(self, user_idle=millis is not None and millis >= IDLE_MS)
        return new._to("balanced", "balanced", calm=0) if not new.user_idle and self.mode == "idle_boost" else new._judged(False)

    def _judged(self, counts: bool) -> Governor:
        g, one = self, int(counts)
        if not g.known:
            return g._to("pressure", "resource_telemetry_unavailable")
        if g.recovering:
            g = replace(g, calm=g.calm + one, cooldown=max(0, g.cooldown - one))
            if g.calm < RECOVERY_WINDOWS:
                return g._to("pressure", "resource_telemetry_unavailable")
            g = replace(g, recovering=False, calm=0)._to("balanced", "balanced")
        if g.sample.critical:
            return g._to("pressure", "critical_memory")
        if g.sample.pressed:
            g = replace(g, pressed=g.pressed + one, calm=0)
            if g.pressed >= PRESSURE_WINDOWS:
                return g._to("pressure", "system_pressure")
        else:
            g = replace(g, pressed=0)
        if g.user_active or g.hold:
            return replace(g, calm=0)._to("active", "user_active")
        if g.sample.energy_saver:
            return g._to("battery", "energy_saver")
        if g.sample.power == "battery":
            return g._to("battery", "battery")
        if g.sample.pressed:
            return g
        g = replace(g, calm=g.calm + one, cooldown=max(0, g.cooldown - one))
        boost = g.user_idle and g.backlog > 0 and g.sample.power == "ac"
        mode, reason = ("idle_boost", "idle_backlog") if boost else ("balanced", "balanced")
        if g.mode == mode:
            return replace(g, reason=reason)
        return g._to(mode, reason, calm=0) if g.calm >= RECOVERY_WINDOWS and not g.cooldown else g


def step(g: Governor, signal: dict) -> Governor:
    """The state after a signal row: kind, and the fields that the kind uses."""
    kind = signal["kind"]
    if kind == "sample":
        return g.sampled(Sample(signal.get("memory"), signal.get("cpu"), signal.get("disk"), signal.get("power") or "unknown", bool(signal.get("energy_saver"))))
    if kind == "latency":
        return g.latency(signal["nanos"])
    if kind == "workload":
        return g.workload(bool(signal.get("user_active")), bool(signal.get("user_idle")), signal.get("backlog") or 0)
    if kind == "backlog":
        return g.pending(signal.get("backlog") or 0)
    if kind == "idle":
        return g.idle(signal.get("idle_millis"))
    return {"interactive": g.interactive, "window": g.window, "unavailable": g.unavailable}[kind]()


def run(signals: Iterable[dict], g: Governor | None = None) -> Iterator[Governor]:
    g = g or Governor()
    for s in signals:
        g = step(g, s)
        yield g
