"""The feed: lines in, changelog out, over micro-batches whose state is a table.

Every micro-batch runs the batch plan: parse, keys, quality, lookups, rules, then the state machines.  What goes from batch to batch lies beside
the query's checkpoint, written under the batch's number, so a batch that is repeated after a failure finds what it found before:

* state: one row for each call, band and mode with an open spot;
* skims: the skimmer reports that can still corroborate or stand as a verification.

Settings are read when a batch begins, so setters on a running feed take effect with the next batch and keep all state.  Time is arrival
time: rows of a batch are put in order, a row that comes in a later batch than younger ones is taken as it comes, and nothing is ever
dropped for being late.  Ticks run up to the last arrival of a batch; `ticks` adds a clock to the sources so that spots expire in silence as well.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lines as line_ops
from ..operators import observations as obs_ops
from ..operators import quality
from ..operators.pipeline import changelog, judged
from ..operators.state import CALL_BAND_MODE, EVENT, SpotMachine, needed
from ..operators.store import path_of, stored
from ..plans.config import AggregatorConfig, ConfigError, FilterConfig, SkimmerQuality, replace

LINE = "source_id string, seq long, t_us long, value string, originator_policy string"
STATE = "dx_call_norm string, band string, mode string, machine string"
_SKIM = "t_us long, source_id string, seq long, dx_call_norm string, freq_hz long, spotter_call_norm string"
_S = 1_000_000


@dataclass(frozen=True)
class Metrics:
    """Counts since the feed began, and the spots that are open now."""

    spots_received: int = 0
    spots_filtered: int = 0
    spots_emitted: int = 0
    parse_errors: int = 0
    reconnects: int = 0
    spot_table_size: int = 0


def ticks(spark: SparkSession, every: int = 10) -> DataFrame:
    """A clock as a source: a line without text every so many seconds."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % every == 0)
    return rate.select(F.lit("clock").alias("source_id"), F.col("value").alias("seq"), F.unix_micros("timestamp").alias("t_us"), F.lit("").alias("value"), F.lit("Clock").alias("originator_policy"))


def step(rows: DataFrame, prior: DataFrame, config: AggregatorConfig, rules: FilterConfig, origin_us: int, end_us: int) -> DataFrame:
    """Events of rows on top of prior(`STATE`) up to end_us, and rows of the kind `State` with the machines that go on (`machine`) and how many
    rows they dropped (`revision`)."""

    schema = f"{EVENT}, machine string"
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(mine: pa.Table, held: pa.Table) -> pa.Table:
        machine = SpotMachine(config, rules, origin_us)
        before, new = held.to_pylist(), sorted(mine.to_pylist(), key=lambda r: tuple(r[c] for c in obs_ops.ORDER))
        if before:
            machine.load(before[0]["machine"])
        name = {c: (before or new)[0][c] for c in CALL_BAND_MODE}
        out = [e for r in new for e in machine.observe(r)] + machine.tick(end_us)
        out.append({"kind": "State", "at_us": end_us, "step": 2, "revision": machine.dropped, "n_observations": len(machine.entries), "machine": machine.dump() if machine.entries else None})
        return pa.Table.from_pylist([name | e for e in out], schema=fields)

    return rows.groupBy(*CALL_BAND_MODE).cogroup(prior.groupBy(*CALL_BAND_MODE)).applyInArrow(run, schema)


def shrink(state: DataFrame, config: AggregatorConfig) -> DataFrame:
    """state without the spots seen longest ago beyond `max_spots` (ties by key), dropped in silence.

    Only keys and times of open spots are compared, of which there are the cap and one batch's at most.
    """
    entry = F.from_json("machine", "entries map<string,struct<last:long>>")["entries"]
    spots = state.select(*CALL_BAND_MODE, F.explode(entry).alias("bucket", "e")).select(*CALL_BAND_MODE, "bucket", F.col("e.last").alias("last"))
    over = spots.count() - config.max_spots
    if over <= 0:
        return state
    gone = spots.orderBy("last", *CALL_BAND_MODE, F.col("bucket").cast("long")).limit(over).groupBy(*CALL_BAND_MODE).agg(F.collect_list("bucket").alias("gone"))

    def cut(batches):
        for pdf in batches:
            out = []
            for *key, text, buckets in pdf[[*CALL_BAND_MODE, "machine", "gone"]].itertuples(index=False):
                machine = SpotMachine(config).load(text)
                for b in buckets if buckets is not None else []:
                    machine.drop(int(b))
                out.append((*key, machine.dump() if machine.entries else None))
            yield pd.DataFrame(out, columns=[*CALL_BAND_MODE, "machine"])

    return state.join(gone, CALL_BAND_MODE, "left").mapInPandas(cut, STATE).where("machine is not null")


def tracked(skims: DataFrame, cfg: SkimmerQuality, now_us: int, tick_secs: int) -> DataFrame:
    """The reports that still matter: three lookbacks and a tick back, and of those the calls with the newest first reports, up to `max_tracked`."""
    kept = skims.where(F.col("t_us") > now_us - (3 * cfg.lookback_secs + tick_secs + 2) * _S)
    if kept.count() <= cfg.max_tracked:
        return kept
    calls = kept.groupBy("dx_call_norm").agg(F.min("t_us").alias("first"), F.count(F.lit(1)).alias("n")).orderBy(F.col("first").desc(), F.col("dx_call_norm").desc())
    room, names = cfg.max_tracked, []
    for row in calls.toLocalIterator():  # calls that fit the cap, and the first that does not
        room -= row["n"]
        if room < 0:
            break
        names.append((row["dx_call_norm"],))
    return kept.join(kept.sparkSession.createDataFrame(names, "dx_call_norm string"), "dx_call_norm", "left_semi").select(*quality.SKIM)


class Feed:
    """A running feed."""

    def __init__(self, spark: SparkSession, config: AggregatorConfig, rules: FilterConfig, entities: DataFrame | None, enrichment: DataFrame | None, sink: Callable[[DataFrame, int], None], checkpoint: str, origin_us: int = 0):
        rules.compiled()
        self.spark, self.entities, self.enrichment, self.sink, self.origin = spark, entities, enrichment, sink, origin_us
        self.folder = checkpoint.rstrip("/") + "/feed"
        self.lock, self.config, self.rules = threading.Lock(), config, rules
        self.metrics = Metrics()
        self.query: StreamingQuery | None = None

    # -- settings of a running feed --

    def update_filter(self, rules: FilterConfig) -> None:
        """A rule set that is not valid is refused, and the one before stays."""
        rules.compiled()
        with self.lock:
            self.rules = rules

    def update_aggregator(self, config: AggregatorConfig) -> None:
        with self.lock:
            self.config = config

    def update_skimmer(self, cfg: SkimmerQuality | None) -> None:
        """None ends tagging; settings without `enabled` do not begin it."""
        with self.lock:
            if cfg is None or self.config.skimmer is not None or cfg.enabled:
                self.config = replace(self.config, skimmer=cfg)

    def disable_skimmer(self) -> None:
        self.update_skimmer(None)

    def set(self, **changes: Any) -> None:
        """spot_ttl_secs, max_spots, max_observations, dedupe__emit_updates, dedupe__min_update_interval_us, dedupe__detect_qsy,
        dedupe__qsy_coalesce_us, skimmer__gate, skimmer__allow, skimmer__required_distinct_skimmers, ..."""
        with self.lock:
            if self.config.skimmer is None:
                changes = {k: v for k, v in changes.items() if not k.startswith("skimmer__")}
            self.config = replace(self.config, **changes)

    def shutdown(self) -> None:
        if self.query:
            self.query.stop()

    @property
    def progress(self) -> dict | None:
        """Rows read and written by the last batch, by Spark's own count."""
        return self.query.lastProgress if self.query else None

    # -- one batch --

    def _kept(self, name: str, number: int, schema: str) -> DataFrame:
        system, place = path_of(self.spark, f"{self.folder}/{name}/{number}")
        return self.spark.read.schema(schema).parquet(str(place)) if system.exists(place) else self.spark.createDataFrame([], schema)

    def _keep(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{number}")
        system, place = path_of(self.spark, f"{self.folder}/{name}/{number - 2}")
        system.delete(place, True)

    def batch(self, df: DataFrame, number: int) -> None:
        with self.lock:
            config, rules = self.config, self.rules
        raw = stored(df.select(*[c.split()[0] for c in LINE.split(", ")]))
        end_us = raw.agg(F.max("t_us")).first()[0]
        if end_us is None:
            return
        parsed = line_ops.parse_lines(raw.where("originator_policy not in ('Status', 'Clock')"))
        errors = parsed.where("kind = 'Unknown' and text <> ''").count()
        reconnects = obs_ops.statuses(raw).where("state = 'Reconnecting'").count()
        obs = obs_ops.observations(raw.where("originator_policy not in ('Status', 'Clock')"))
        history = self._kept("skims", number - 1, _SKIM)
        rows = stored(needed(judged(obs, config, rules, self.entities, self.enrichment, self.origin, history if config.skimmer else None)))
        made = stored(step(rows, self._kept("state", number - 1, STATE), config, rules, self.origin, end_us))
        state = made.where("kind = 'State' and machine is not null").select(*CALL_BAND_MODE, "machine")
        self._keep(shrink(state, config), "state", number)
        if config.skimmer:
            new = rows.where("originator_kind = 'Skimmer'").select(*quality.SKIM)
            latest = max(end_us, history.agg(F.max("t_us")).first()[0] or end_us)
            self._keep(tracked(new.unionByName(history), config.skimmer, latest, config.tick_secs), "skims", number)
        events = made.where("kind <> 'State'").drop("machine")
        self.sink(events, number)
        total = made.agg(F.count_if(F.col("kind") != "State").alias("out"), F.sum(F.when(F.col("kind") == "State", F.col("revision"))).alias("dropped"), F.sum(F.when(F.col("kind") == "State", F.col("n_observations"))).alias("open")).first()
        m = self.metrics
        self.metrics = Metrics(m.spots_received + rows.count(), m.spots_filtered + (total["dropped"] or 0), m.spots_emitted + total["out"], m.parse_errors + errors, m.reconnects + reconnects, min(total["open"] or 0, config.max_spots))

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict[str, Any] | None = None) -> Feed:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(**trigger) if trigger else writer).start()
        return self


class FeedBuilder:
    """Sources, rules and settings; `build` makes the changelog of finite sources, `start` runs a feed over streams."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.rules, self.config = spark, [], FilterConfig(), AggregatorConfig()
        self.entities: DataFrame | None = None
        self.enrichment: DataFrame | None = None

    def add_source(self, lines: DataFrame) -> FeedBuilder:
        """lines(source_id, seq, t_us, value, originator_policy), batch or stream."""
        self.sources.append(lines)
        return self

    def filter(self, rules: FilterConfig) -> FeedBuilder:
        self.rules = rules
        return self

    def aggregator(self, config: AggregatorConfig) -> FeedBuilder:
        self.config = config
        return self

    def set(self, **changes: Any) -> FeedBuilder:
        """As `Feed.set`."""
        self.config = replace(self.config, **changes)
        return self

    def resolver(self, entities: DataFrame) -> FeedBuilder:
        self.entities = entities
        return self

    def enricher(self, table: DataFrame) -> FeedBuilder:
        self.enrichment = table
        return self

    def lines(self) -> DataFrame:
        if not self.sources:
            raise ConfigError("no sources")
        self.rules.compiled()
        return obs_ops.fan_in(*self.sources)

    def observations(self) -> DataFrame:
        return obs_ops.observations(self.lines())

    def announcements(self) -> DataFrame:
        return obs_ops.announcements(self.lines())

    def statuses(self) -> DataFrame:
        return obs_ops.statuses(self.lines())

    def build(self, origin_us: int = 0, end_us: int | None = None) -> DataFrame:
        return changelog(self.observations(), self.config, self.rules, self.entities, self.enrichment, origin_us, end_us)

    def start(self, sink: Callable[[DataFrame, int], None], checkpoint: str, origin_us: int = 0, trigger: dict[str, Any] | None = None) -> Feed:
        """sink gets each batch's events and its number; it may see a batch again after a failure."""
        feed = Feed(self.spark, self.config, self.rules, self.entities, self.enrichment, sink, checkpoint, origin_us)
        return feed.start(self.lines(), checkpoint, trigger)
