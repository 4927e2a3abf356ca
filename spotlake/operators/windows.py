"""Incarnations and running aggregates by window functions.

Ticks come every `tick_secs` from the origin; a tick at t runs before an observation at t.  An entry dies at the first tick at which its last
observation is more than the TTL old, in whole seconds, so a gap splits a key's rows into incarnations exactly where the stateful path does.
Key columns partition every window: predicates on them may pass below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import saturate, whole_seconds
from .observations import CALL_BAND_MODE, KEY, ORDER, arrival
from .store import stored

_S = 1_000_000


def last_tick(t: Column, tick_secs: int = 10, origin_us: int = 0) -> Column:
    """The last tick at or before t."""
    return t - F.pmod(t - F.lit(origin_us), F.lit(tick_secs * _S))


def withdraw_time(t: Column, ttl_secs: int = 900, tick_secs: int = 10, origin_us: int = 0) -> Column:
    """The first tick that finds an entry last seen at t expired."""
    due = t + F.lit((ttl_secs + 1) * _S)
    wait = F.pmod(F.lit(origin_us) - due, F.lit(tick_secs * _S))
    return due + wait


def incarnations(rows: DataFrame, ttl_secs: int = 900, tick_secs: int = 10, origin_us: int = 0, key: list[str] = KEY) -> DataFrame:
    """rows with `incarnation`, counted from 0 by key."""
    w = W.partitionBy(*key).orderBy(*ORDER)
    before = F.lag("t_us").over(w)
    broke = before.isNotNull() & (whole_seconds(last_tick(F.col("t_us"), tick_secs, origin_us), before) > ttl_secs)
    return rows.withColumn("_b", broke.cast("int")).withColumn("incarnation", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def running(rows: DataFrame, max_observations: int = 20, key: list[str] = KEY) -> DataFrame:
    """rows(with incarnation) with the entry's state after each row: counts, revision, first and last seen, comment, first call, observations.

    A distinct count is the running sum of first occurrences, so nothing grows with an incarnation; all windows share one partitioning.
    """
    of = [*key, "incarnation"]
    w = W.partitionBy(*of).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    last = W.partitionBy(*of).orderBy(*ORDER).rowsBetween(-(max_observations - 1), 0)
    first = lambda *c: (F.row_number().over(W.partitionBy(*of, *c).orderBy(*ORDER)) == 1).cast("int")
    human = (F.col("originator_kind") == "Human").cast("int")
    rows = rows.withColumns({"_who": first("spotter_call_norm"), "_human": first("spotter_call_norm", "originator_kind") * human, "_source": first("source_id")})
    kept = F.least(F.count(F.lit(1)).over(w), F.lit(max_observations))
    obs = F.struct("spotter_call", "source_id", "originator_kind", "t_us", "freq_hz", "comment", F.col("skimmer_fields.snr_db").alias("snr_db"), F.col("skimmer_fields.wpm").alias("wpm"))
    rows = rows.withColumns(
        {
            "unique_originators": saturate(F.sum("_who").over(w)), "unique_human_originators": saturate(F.sum("_human").over(w)),
            "unique_sources": saturate(F.sum("_source").over(w)), "revision": F.count(F.lit(1)).over(w), "first_seen_us": F.first("t_us").over(w), "last_seen_us": F.col("t_us"),
            "last_comment": F.last("comment", ignorenulls=True).over(w), "first_dx_call": F.first("dx_call").over(w), "total_observations": saturate(kept), "repeats": saturate(kept), "observations": F.collect_list(obs).over(last),
        }
    )
    return rows.drop("_who", "_human", "_source")


def withdrawals(rows: DataFrame, ttl_secs: int = 900, tick_secs: int = 10, origin_us: int = 0) -> DataFrame:
    """One TTL withdrawal for each incarnation that expires before the input ends (QSY detection off)."""
    last = rows.groupBy(*KEY, "incarnation").agg(F.max_by("t_us", arrival()).alias("last_seen_us"), F.count(F.lit(1)).alias("revision"), F.max("t_us").alias("_latest"))
    last = stored(last.withColumn("at_us", withdraw_time(F.col("last_seen_us"), ttl_secs, tick_secs, origin_us)))
    end_us = last.agg(F.max("_latest")).first()[0]
    return last.where(F.col("at_us") <= F.lit(end_us)).drop("_latest")


def new_events(rows: DataFrame) -> DataFrame:
    """The rows that open a spot, where passing does not depend on counts and updates are off.

    rows must hold `passes` and `incarnation` (from the arrivals of each key).  At most one key of a call, band and mode is out at a time, so a
    passing row opens a spot if the last passing row lies in another bucket, or that bucket's entry has died since.
    """
    w = W.partitionBy(*CALL_BAND_MODE).orderBy(*ORDER)
    on = rows.where("passes")
    prev = {c: F.lag(c).over(w) for c in ("freq_bucket_hz", "incarnation")}
    on = on.withColumns({"_pb": prev["freq_bucket_hz"], "_pi": prev["incarnation"]})
    new = F.coalesce((F.col("_pb") != F.col("freq_bucket_hz")) | (F.col("_pi") != F.col("incarnation")), F.lit(True))
    return on.where(new).drop("_pb", "_pi").withColumn("kind", F.lit("New"))


def active_view(events: DataFrame, now_us: int | Column, stale_secs: int = 300) -> DataFrame:
    """What a live display holds: the last event of each key, unless withdrawn or stale."""
    last = events.groupBy(*KEY).agg(F.max_by(F.struct("kind", "freq_hz", "last_seen_us", "revision"), "event_no").alias("e")).select(*KEY, "e.*")
    return last.where((F.col("kind") != "Withdraw") & (F.col("last_seen_us") >= F.lit(now_us) - stale_secs * _S))


def newest(spots: DataFrame, most: int, by: str = "last_seen_us") -> DataFrame:
    """The `most` entries seen last, ties by key: what a table cut down to that size keeps."""
    return spots.orderBy(F.col(by).desc(), *KEY).limit(most)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, most: int = 500) -> DataFrame:
    """The activity ring: the last events."""
    return events.orderBy(F.col("event_no").desc()).limit(most)


def page(spots: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of spots by frequency."""
    return spots.orderBy("freq_hz", *KEY).offset(offset).limit(size)
