"""Corroboration of skimmer reports: Valid, Qsy, Busted, Unknown, over slices of time."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalar import whole_seconds
from ..plans.config import SkimmerQuality
from .observations import ORDER, arrival

_S = 1_000_000


SKIM = [*ORDER, "dx_call_norm", "freq_hz", "spotter_call_norm"]


def corroboration(skims: DataFrame, cfg: SkimmerQuality = SkimmerQuality()) -> DataFrame:
    """skims(`SKIM`) with `distinct_skimmers` near each report, itself included.

    Reports of a call meet within time slices of the lookback, each in its own and the next, so a hot call is spread over
    its slices and the join is an equi-join; only distinct skimmers of a report are kept while counting.  A report meets itself, so none is lost.
    """
    width = (cfg.lookback_secs + 1) * _S
    slot = F.floor(F.col("t_us") / width)
    new = skims.select(*SKIM, slot.alias("slot"))
    old = skims.select(*[F.col(c).alias(f"o_{c}") for c in (*ORDER, "freq_hz", "spotter_call_norm")], "dx_call_norm", F.explode(F.array(slot, slot + 1)).alias("slot"))
    near = (arrival("o_") <= arrival()) & (F.abs(F.col("freq_hz") - F.col("o_freq_hz")) <= cfg.freq_window_hz) & (whole_seconds(F.col("t_us"), F.col("o_t_us")) <= cfg.lookback_secs)
    counts = new.join(old, ["dx_call_norm", "slot"]).where(near).groupBy(*SKIM).agg(F.count_distinct("o_spotter_call_norm").alias("distinct_skimmers"))
    return counts.withColumn("distinct_skimmers", F.col("distinct_skimmers").cast("int"))


_TAGS = {"distinct_skimmers": ("int", pa.int32()), "previous_freq_hz": ("long", pa.int64()), "similar_call": ("string", pa.string()), "edit_distance": ("int", pa.int32()), "skim_quality": ("string", pa.string())}


def tags(skims: DataFrame, cfg: SkimmerQuality = SkimmerQuality(), tick_secs: int = 10, origin_us: int = 0) -> DataFrame:
    """skims(`SKIM`) with `skim_quality` and its detail: corroborating skimmers, previous verified frequency, similar call and its distance."""
    return tagged(skims.select(*SKIM), cfg, tick_secs, origin_us)


def tagged(rows: DataFrame, cfg: SkimmerQuality = SkimmerQuality(), tick_secs: int = 10, origin_us: int = 0) -> DataFrame:
    """rows(`SKIM` and others) with the columns of `tags`; where rows hold an originator_kind, those of others than skimmers are null.

    One shuffle into slices of time, whose rows stream by in order.  What a row is called depends on the reports of three lookbacks and a tick at
    most (its own reports, the verifications that still stand, and their reports), so each slice is led by that much of the slice before.
    """
    lead_us = (3 * cfg.lookback_secs + tick_secs + 2) * _S
    width = 8 * lead_us
    place = F.floor(F.col("t_us") / width)
    asks = F.col("originator_kind") == "Skimmer" if "originator_kind" in rows.columns else F.lit(True)
    late = asks & (F.pmod(F.col("t_us"), F.lit(width)) >= width - lead_us)
    dealt = rows.withColumns({"_asks": asks, "_own": place}).withColumn("_place", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    order = dealt.withColumn("_own", F.col("_own") == F.col("_place")).repartition("_place").sortWithinPartitions("_place", *ORDER)
    schema = StructType(rows.schema.fields + [StructField(n, StructType.fromDDL(f"c {t}")["c"].dataType) for n, (t, _) in _TAGS.items()])
    return order.mapInArrow(_tagger(rows.columns, cfg, tick_secs, origin_us), schema)


class Reports:
    """The reports of a slice of time up to now: by call those of the lookback, and each call's last verification."""

    def __init__(self, cfg: SkimmerQuality):
        self.cfg, self.width = cfg, max(1, cfg.busted_freq_hz)
        self.near: dict[str, deque] = {}
        self.verified: dict[str, tuple[int, int]] = {}
        #: calls by the frequency band of their verification
        self.bands: dict[int, dict[str, int]] = {}

    def tag(self, call: str, freq: int, who: str | None, t: int, tick: int) -> tuple:
        """Record a report and say what it is, as the columns of `tags`."""
        c = self.cfg
        q = self.near.setdefault(call, deque())
        old = t - (c.lookback_secs + 1) * _S
        while q and q[0][0] <= old:
            q.popleft()
        q.append((t, freq, who))
        lo, hi = freq - c.freq_window_hz, freq + c.freq_window_hz
        n = len({w for _, f, w in q if lo <= f <= hi and w is not None})
        # a verification is forgotten only at a tick, once twice the lookback has passed
        gone = tick - (2 * c.lookback_secs + 1) * _S
        before = self.verified.get(call)
        previous = before[0] if before and before[1] > gone else None
        if c.compute_valid and n >= c.required_distinct_skimmers:
            band = freq // self.width
            if before:
                self.bands[before[0] // self.width].pop(call, None)
            self.bands.setdefault(band, {})[call] = freq
            self.verified[call] = (freq, t)
            moved = c.compute_qsy and previous is not None and abs(freq - previous) > c.qsy_freq_hz
            return n, previous, None, None, "Qsy" if moved else "Valid"
        best = self._similar(call, freq, gone) if c.compute_busted else None
        return (n, previous, best[1], best[0], "Busted") if best else (n, previous, None, None, "Unknown")

    def _similar(self, call: str, freq: int, gone: int) -> tuple[int, str] | None:
        """(distance, call) of the nearest other call whose standing verification lies close by."""
        best, band = None, freq // self.width
        for b in (band - 1, band, band + 1):
            for v, f in list(self.bands.get(b, {}).items()):
                if self.verified[v][1] <= gone:
                    del self.bands[b][v], self.verified[v]
                elif v != call and abs(f - freq) <= self.cfg.busted_freq_hz:
                    d = edits(v, call, self.cfg.busted_max_edit)
                    if d is not None and (best is None or (d, v) < best):
                        best = (d, v)
        return best


@lru_cache(maxsize=1 << 16)
def edits(a: str, b: str, most: int) -> int | None:
    """Edit distance of two calls if it is `most` at most, else None."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row[:]
        row[0] = i
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
    return row[-1] if row[-1] <= most else None


def _tagger(columns: list[str], cfg: SkimmerQuality, tick_secs: int, origin_us: int):
    none = (None,) * len(_TAGS)

    def run(batches):
        place = reports = None
        for batch in batches:
            marks = ("_place", "_own", "_asks", "dx_call_norm", "freq_hz", "spotter_call_norm", "t_us")
            made = []
            for p, own, asks, call, freq, who, t in zip(*[batch.column(c).to_pylist() for c in marks]):
                if p != place:
                    place, reports = p, Reports(cfg)
                got = reports.tag(call, freq, who, t, t - (t - origin_us) % (tick_secs * _S)) if asks else none
                if own:
                    made.append(got)
            kept = batch.filter(batch.column("_own")).select(columns)
            values = list(zip(*made)) or [()] * len(_TAGS)
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, kind) for v, (_, kind) in zip(values, _TAGS.values())]], names=[*columns, *_TAGS])

    return run


def should_emit(tag: Column, kind: Column, cfg: SkimmerQuality = SkimmerQuality()) -> Column:
    """The gate; a missing tag counts as Unknown."""
    if not (cfg.enabled and cfg.gate):
        return F.lit(True)
    ok = F.coalesce(tag, F.lit("Unknown")).isin(*cfg.allow) if cfg.allow else F.lit(False)
    return F.when(kind != "Skimmer", F.lit(True)).otherwise(ok) if cfg.apply_only_to_skimmer else ok
