"""One state machine for a (call, band, mode): the batch, streaming and serial paths all step it.

A row is ingested, then gated and filtered, then it may open (New), renew (Update) or move (Withdraw and New) a spot.  Entries die at ticks.
The machine's memory is the call's open buckets, each with bounded observations and its distinct originators.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import AggregatorConfig, FilterConfig
from .observations import CALL_BAND_MODE, ORDER

_S = 1_000_000
EVENT = "dx_call_norm string, band string, mode string, freq_bucket_hz long, at_us long, source_id string, seq long, step int, kind string, revision long, dx_call string, freq_hz long, first_seen_us long, last_seen_us long, comment string, unique_originators int, unique_sources int, n_observations int, skim_quality string, confidence string"
COLUMNS = [f.split()[0] for f in EVENT.split(", ")]
ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind]) for name, kind in (f.split() for f in EVENT.split(", "))])
#: What a row must hold.
INPUT = [*CALL_BAND_MODE, "freq_bucket_hz", *ORDER, "originator_kind", "spotter_call_norm", "dx_call", "freq_hz", "comment", "skim_quality", "passes", "text_ok", "text_cq", "row_cq"]


def needed(rows: DataFrame) -> DataFrame:
    return rows.select(*INPUT)


def _floor_seconds(us: int) -> int:
    return us // _S if us >= 0 else -(-us // _S)


class SpotMachine:
    """State of one call, band and mode."""

    def __init__(self, config: AggregatorConfig, rules: FilterConfig = FilterConfig(), origin_us: int = 0):
        self.cfg, self.rules, self.origin = config, rules.compiled(), origin_us
        self.entries: dict[int, dict] = {}
        self.out: int | None = None
        #: rows that a rule on counts or content, or `passes`, kept from being an event
        self.dropped = 0
        #: no entry expires before this; None where it is not known
        self.quiet: int | None = None

    def fresh(self) -> SpotMachine:
        """An empty machine of the same settings, which are not checked again."""
        m = SpotMachine.__new__(SpotMachine)
        m.cfg, m.rules, m.origin, m.entries, m.out, m.dropped, m.quiet = self.cfg, self.rules, self.origin, {}, None, 0, None
        return m

    def configure(self, cfg: AggregatorConfig, rules: FilterConfig) -> None:
        """Other settings, checked by the caller."""
        self.cfg, self.rules, self.quiet = cfg, rules, None

    # -- life --

    def _event(self, bucket: int, kind: str, at: int, row: dict | None, step: int) -> dict:
        e = self.entries[bucket]
        return {
            "freq_bucket_hz": bucket, "at_us": at, "source_id": row and row["source_id"], "seq": row and row["seq"], "step": step, "kind": kind, "revision": e["revision"], "dx_call": e["dx_call"], "freq_hz": e["freq"], "first_seen_us": e["first"], "last_seen_us": e["last"],
            "comment": e["comment"], "unique_originators": min(len(e["who"]), 255), "unique_sources": min(len(e["sources"]), 255), "n_observations": len(e["obs"]), "skim_quality": e["tag"], "confidence": "Unverified",
        }

    def drop(self, bucket: int) -> None:
        del self.entries[bucket]
        if self.out == bucket:
            self.out = None

    def _due(self, last: int) -> int:
        """The first tick that finds an entry last seen then expired."""
        at = last + (self.cfg.spot_ttl_secs + 1) * _S
        return at + (self.origin - at) % (self.cfg.tick_secs * _S)

    def next_due(self) -> int | None:
        return min((self._due(e["last"]) for e in self.entries.values()), default=None)

    def tick(self, now: int) -> list[dict]:
        """Withdrawals of all ticks up to now."""
        if not self.entries or (self.quiet is not None and now < self.quiet):
            return []
        out = []
        for at, b in sorted((self._due(e["last"]), b) for b, e in self.entries.items()):
            if at > now:
                break
            out.append(self._event(b, "Withdraw", at, None, 0))
            self.drop(b)
        self.quiet = self.next_due()
        return out

    def _ingest(self, r: dict) -> dict:
        b, t = r["freq_bucket_hz"], r["t_us"]
        e = self.entries.get(b)
        if e is None or t < e["last"]:
            # an entry seen again expires later, so the bound stays one
            self.quiet = self._due(t) if not self.entries else None if self.quiet is None else min(self.quiet, self._due(t))
        if e is None:
            e = self.entries[b] = {"first": r["t_us"], "dx_call": r["dx_call"], "comment": None, "revision": 0, "who": set(), "humans": set(), "sources": set(), "obs": [], "emitted": None, "tag": None, "text_ok": r["text_ok"], "text_cq": r["text_cq"]}
        e["revision"] += 1
        e["last"], e["freq"] = r["t_us"], r["freq_hz"]
        if r["comment"] is not None:
            # content rules judge the spot's last comment, whichever row brought it
            e["comment"], e["text_ok"], e["text_cq"] = r["comment"], r["text_ok"], r["text_cq"]
        e["who"].add(r["spotter_call_norm"])
        if r["originator_kind"] == "Human":
            e["humans"].add(r["spotter_call_norm"])
        e["sources"].add(r["source_id"])
        e["obs"].append([r["spotter_call_norm"], r["source_id"], r["t_us"], r["freq_hz"]])
        del e["obs"][: -self.cfg.max_observations]
        if r["skim_quality"] is not None:
            e["tag"] = r["skim_quality"]
        return e

    def _enough(self, e: dict) -> bool:
        c, n = self.rules.correlation, len(e["obs"])
        who = min(len(e["humans" if c.originators_human_only else "who"]), 255)
        return who >= c.min_unique_originators and min(len(e["sources"]), 255) >= c.min_unique_sources and min(n, 255) >= c.min_observations and min(n, 255) >= c.min_repeats_same_key

    def observe(self, r: dict) -> list[dict]:
        """Events of the ticks before a row and of the row itself.  `passes` holds the gate and all rules that look at the row alone."""
        t, b, d = r["t_us"], r["freq_bucket_hz"], self.cfg.dedupe
        out = self.tick(t - (t - self.origin) % (self.cfg.tick_secs * _S))
        e = self._ingest(r)
        content = e["text_ok"] and (r["row_cq"] or e["text_cq"])
        if not (r["passes"] and content and self._enough(e)):
            self.dropped += 1
            return out
        if e["emitted"] is None:
            kind = "New"
        elif d.emit_updates and not (d.min_update_interval_us is not None and t - e["emitted"] < d.min_update_interval_us):
            kind = "Update"
        else:
            return out
        e["emitted"] = t
        if kind == "New" and d.detect_qsy:
            old, self.out = self.out, b
            if old is not None and old != b:
                gap = t - self.entries[old]["emitted"] if self.entries[old]["emitted"] is not None else None
                quiet = d.qsy_coalesce_us is not None and gap is not None and 0 <= gap < d.qsy_coalesce_us
                if not quiet:
                    out.append(self._event(old, "Withdraw", t, r, 0))
                del self.entries[old]
        out.append(self._event(b, kind, t, r, 1))
        return out

    # -- in and out of a state store --

    def dump(self) -> str:
        plain = {b: {k: sorted(v, key=str) if isinstance(v, set) else v for k, v in e.items()} for b, e in self.entries.items()}
        return json.dumps({"entries": plain, "out": self.out})

    def load(self, text: str) -> SpotMachine:
        state = json.loads(text)
        self.entries = {int(b): {k: set(v) if k in ("who", "humans", "sources") else v for k, v in e.items()} for b, e in state["entries"].items()}
        self.out, self.quiet = state["out"], None
        return self


def rows_of(pdf: pd.DataFrame) -> Iterator[dict]:
    cols = {c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in INPUT}
    for values in zip(*cols.values()):
        yield dict(zip(cols, values))


def rows_in(batch: pa.RecordBatch) -> Iterator[dict]:
    """The same of an Arrow batch."""
    for values in zip(*[batch.column(c).to_pylist() for c in INPUT]):
        yield dict(zip(INPUT, values))


def batch_of(events: list[tuple[tuple, dict]]) -> pa.RecordBatch:
    keys = list(zip(*[key for key, _ in events])) or [()] * 3
    made = [*keys, *[[e[c] for _, e in events] for c in COLUMNS[3:]]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, ARROW)], schema=ARROW)


def frame(events: list[tuple[tuple, dict]]) -> pd.DataFrame:
    rows = [dict(zip(CALL_BAND_MODE, key)) | e for key, e in events]
    return pd.DataFrame(rows, columns=COLUMNS).astype({"seq": "Int64"})


def events(rows: DataFrame, config: AggregatorConfig = AggregatorConfig(), rules: FilterConfig = FilterConfig(), origin_us: int = 0, end_us: int | None = None) -> DataFrame:
    """The changelog of keyed rows (`INPUT`): one shuffle by call, band and mode, then each key's rows stream by in order through its machine.

    end_us is where time stops (ticks after it do not run); by default at the last row, which takes a second pass over rows' times.
    """
    if end_us is None:
        end_us = rows.agg(F.max("t_us")).first()[0] or 0

    blank = SpotMachine(config, rules, origin_us)

    def run(batches):
        key, machine = None, None
        for batch in batches:
            out: list = []
            for r in rows_in(batch):
                k = (r["dx_call_norm"], r["band"], r["mode"])
                if k != key:
                    if machine:
                        out += [(key, e) for e in machine.tick(end_us)]
                    key, machine = k, blank.fresh()
                out += [(k, e) for e in machine.observe(r)]
            yield batch_of(out)
        if machine:
            yield batch_of([(key, e) for e in machine.tick(end_us)])

    ordered = rows.select(*INPUT).repartition(*CALL_BAND_MODE).sortWithinPartitions(*CALL_BAND_MODE, *ORDER)
    return ordered.mapInArrow(run, EVENT)
