"""Stateful streams: journal correlation for each volume, and the governor for each machine."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame

from ..operators import governor
from ..sources.journal import Correlator

EVENT = "volume_id binary, position long, part int, event string, file_reference long, parent_reference long, file_link_id binary, name string, reason string"
_JOURNAL_STATE = "pending string, known string"
DECISION = "machine string, sequence long, mode string, reason string, transition_sequence long, background_paused boolean, maximum_batch_mutations int, maximum_batches int, maximum_run_time_millis long, writer_heap_bytes long, rebuild_page_size int, projection_concurrency int, maintenance_intensity string"


def _correlated(key: tuple, frames: Iterator[pd.DataFrame], c: Correlator) -> pd.DataFrame:
    columns = [x.split()[0] for x in EVENT.split(", ")]
    rows = pd.concat(list(frames)).sort_values("position")
    out = []
    for r in rows.itertuples():
        unsigned = lambda v: int(v) % (1 << 64)
        record = (unsigned(r.file_reference), unsigned(r.parent_reference), int(r.position), int(r.reason), int(r.attributes), r.name, bool(r.had_invalid_utf16))
        for part, e in enumerate(c.events(record, getattr(r, "there", "observed"))):
            signed = {k: e[k] - (1 << 64) if e[k] >= 1 << 63 else e[k] for k in ("file_reference", "parent_reference") if k in e}
            out.append({"volume_id": key[0], "position": int(r.position), "part": part, **e, **signed})
    return pd.DataFrame([[e.get(c) for c in columns] for e in out], columns=columns, dtype=object)


def correlate_batch(records: DataFrame) -> DataFrame:
    """Events of whole journals (volume_id binary, the columns of journal.RECORD, there): one group for a volume, in order of position."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        return _correlated(key, iter([frame]), Correlator(bytes(key[0])))

    return records.groupBy("volume_id").applyInPandas(run, EVENT)


def correlate(records: DataFrame) -> DataFrame:
    """correlate_batch() on a stream: renames whose halves come in different batches meet by state."""

    def run(key, frames, state):
        c = Correlator(bytes(key[0]))
        if state.exists:
            pending, known = state.get
            c.pending = {int(k): bytes.fromhex(v) for k, v in json.loads(pending).items()}
            c.known = {(p, n): bytes.fromhex(v) for p, n, v in json.loads(known)}
        out = _correlated(key, frames, c)
        state.update((json.dumps({str(k): v.hex() for k, v in c.pending.items()}), json.dumps([[p, n, v.hex()] for (p, n), v in c.known.items()])))
        yield out

    return records.groupBy("volume_id").applyInPandasWithState(run, EVENT, _JOURNAL_STATE, "append", "NoTimeout")


def _decisions(machine: str, rows: pd.DataFrame, g: governor.Governor) -> tuple[pd.DataFrame, governor.Governor]:
    out = []
    for signal in rows.sort_values("sequence").astype(object).where(lambda d: d.notna(), None).to_dict("records"):
        g = governor.step(g, {k: int(v) if isinstance(v, float) else v for k, v in signal.items()})
        b = g.budget()
        out.append({"machine": machine, "sequence": signal["sequence"], "mode": g.mode, "reason": g.reason, "transition_sequence": g.transitions, **b})
    return pd.DataFrame(out, columns=[x.split()[0] for x in DECISION.split(", ")]), g


def govern_batch(signals: DataFrame) -> DataFrame:
    """A decision for each signal (machine, sequence, kind and the kind's fields), in order, for each machine."""
    return signals.groupBy("machine").applyInPandas(lambda key, rows: _decisions(key[0], rows, governor.Governor())[0], DECISION)


def govern(signals: DataFrame) -> DataFrame:
    """govern_batch() on a stream: the governor's state of each machine goes from batch to batch."""

    def run(key, frames, state):
        g = governor.Governor()
        if state.exists:
            held = json.loads(state.get[0])
            g = governor.Governor(**held | {"sample": governor.Sample(**held["sample"])})
        out, g = _decisions(key[0], pd.concat(list(frames)), g)
        state.update((json.dumps(asdict(g)),))
        yield out

    return signals.groupBy("machine").applyInPandasWithState(run, DECISION, "governor string", "append", "NoTimeout")
