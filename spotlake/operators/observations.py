"""From lines to observations, and from observations to keyed rows.

An observation has seq (its number within its source), t_us (arrival in microseconds) and source_id; arrival in the order of `ORDER` is the total
order that everything else follows, and (source_id, seq) names a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines, scalar
from ..plans.config import AggregatorConfig

ORDER = ["t_us", "source_id", "seq"]
ROW = ["source_id", "seq"]
KEY = ["dx_call_norm", "band", "mode", "freq_bucket_hz"]
CALL_BAND_MODE = KEY[:3]


def arrival(prefix: str = "") -> Column:
    """A row's place in the total order, comparable."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ORDER])


def observations(raw: DataFrame, keep_raw: bool = False) -> DataFrame:
    """raw(source_id, seq, t_us, value, originator_policy) -> the spots among the lines; with keep_raw also the line as `raw`."""
    rows = lines.parse_lines(raw).where(F.col("kind") == "Spot")
    kept = [F.col("value").alias("raw")] if keep_raw else []
    return rows.select("seq", "t_us", "source_id", lines.originator(F.col("spotter_call"), F.col("originator_policy")).alias("originator_kind"), "spotter_call", "dx_call", "freq_hz", "comment", "skimmer_fields", *kept)


def announcements(raw: DataFrame) -> DataFrame:
    """Announce lines pass beside the aggregator."""
    return lines.parse_lines(raw).where(F.col("kind") == "Announce").select("source_id", "seq", "t_us", "text")


def statuses(raw: DataFrame) -> DataFrame:
    """What sources say of themselves passes beside the aggregator: rows of the policy `Status` hold a state, `Reconnecting 3` or `Failed reason`."""
    rows = raw.where(F.col("originator_policy") == "Status")
    state = F.split_part("value", F.lit(" "), F.lit(1))
    about = F.when(F.instr("value", " ") > 0, F.substring(F.col("value"), F.instr("value", " ") + 1, F.length("value")))
    return rows.select("source_id", "seq", "t_us", state.alias("state"), F.when(state == "Reconnecting", about.try_cast("int")).alias("attempt"), F.when(state == "Failed", about).alias("reason"))


def fan_in(*sources: DataFrame) -> DataFrame:
    """All sources' rows in one relation; numbers need to be unique within a source only."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def keyed(obs: DataFrame, config: AggregatorConfig = AggregatorConfig()) -> DataFrame:
    """Normalised calls, band, mode and bucket; a mode in the comment counts only from skimmers."""
    n, b = config.normalization, config.buckets
    norm = lambda c: scalar.normalize_callsign(F.col(c), n.uppercase, n.strip_non_alnum, n.portable_policy)
    upstream = F.when(F.col("originator_kind") == "Skimmer", F.col("skimmer_fields.mode"))
    rows = obs.withColumns({"dx_call_norm": norm("dx_call"), "spotter_call_norm": norm("spotter_call"), "band": scalar.freq_to_band(F.col("freq_hz")), "mode": scalar.resolve_mode(F.col("freq_hz"), upstream, config.mode_policy)})
    return rows.withColumn("freq_bucket_hz", scalar.freq_bucket(F.col("freq_hz"), F.col("mode"), b.cw_hz, b.ssb_hz, b.dig_hz))


def view(rows: DataFrame) -> DataFrame:
    """Filter input for rows that came through `keyed`, counts and lookups; columns that the pipeline never fills are null or false.

    Where the running state is known, the comment is the spot's, the last that was not null.
    """
    geo = "struct<continent:string,cq_zone:int,itu_zone:int,entity:string,country:string,state:string,grid:string>"
    fill = {
        "now_us": F.col("t_us"), "last_seen_us": F.col("t_us"), "snr_db": F.col("skimmer_fields.snr_db"), "wpm": F.col("skimmer_fields.wpm"), "is_skimmer_dupe": F.lit(False),
        "is_skimmer_cq": F.coalesce(F.col("skimmer_fields.is_cq"), F.lit(False)), "dx_geo": F.lit(None).cast(geo), "spotter_geo": F.lit(None).cast(geo), "lotw": F.lit(None).cast("boolean"),
        "in_master_db": F.lit(None).cast("boolean"), "in_callbook": F.lit(None).cast("boolean"), "memberships": F.lit(None).cast("array<string>"),
        "unique_originators": F.lit(1), "unique_human_originators": F.lit(1), "unique_sources": F.lit(1), "total_observations": F.lit(1), "repeats": F.lit(1),
    }
    if "last_comment" in rows.columns:
        rows = rows.withColumn("comment", F.col("last_comment"))
    return rows.withColumns({c: v for c, v in fill.items() if c not in rows.columns})


def unique_originators(rows: DataFrame, by: list[str], human_only: bool = False) -> DataFrame:
    """How many calls report each `by`, all or human ones, 255 at most."""
    who = F.when(F.col("originator_kind") == "Human", F.col("spotter_call_norm")) if human_only else F.col("spotter_call_norm")
    return rows.groupBy(*by).agg(scalar.saturate(F.count_distinct(who)).alias("unique_originators"))
