"""The whole query: observations -> keys -> quality -> gate -> rules -> changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import parse_lines
from ..plans.config import AggregatorConfig, FilterConfig
from ..plans.predicate import comment_verdict, drop_reason
from . import lookup, quality, state
from .observations import ORDER, keyed, observations, view
from .store import stored


def judged(obs: DataFrame, config: AggregatorConfig = AggregatorConfig(), rules: FilterConfig = FilterConfig(), entities: DataFrame | None = None, enrichment: DataFrame | None = None, origin_us: int = 0, history: DataFrame | None = None) -> DataFrame:
    """Keyed rows with skim_quality, drop_reason and passes, of the gate and all rules that look at the row alone, and what the rules on the
    spot's comment need: text_ok, text_cq, row_cq.

    history holds earlier skimmer reports (`quality.SKIM`) that corroborate without being judged again.
    """
    rows = keyed(obs, config)
    if config.skimmer:
        if history is None:
            rows = quality.tagged(rows, config.skimmer, config.tick_secs, origin_us)
        else:
            rows = stored(rows)
            skims = rows.where(F.col("originator_kind") == "Skimmer").select(*quality.SKIM)
            rows = rows.join(quality.tags(skims.unionByName(history), config.skimmer, config.tick_secs, origin_us).select(*ORDER, "skim_quality"), ORDER, "left")
        gate = quality.should_emit(F.col("skim_quality"), F.col("originator_kind"), config.skimmer)
    else:
        rows, gate = rows.withColumn("skim_quality", F.lit(None).cast("string")), F.lit(True)
    if entities is not None:
        rows = lookup.with_geo(rows, entities, "dx_call_norm", "dx_geo")
        rows = lookup.with_geo(rows, entities, "spotter_call_norm", "spotter_geo")
    if enrichment is not None:
        rows = lookup.enrich(rows, enrichment)
    rows = view(rows).withColumn("drop_reason", drop_reason(rules, correlation=False, content=False))
    text = comment_verdict(rules)
    return rows.withColumns({"passes": gate & F.col("drop_reason").isNull(), "text_ok": text.ok, "text_cq": text.cq, "row_cq": F.col("is_skimmer_cq")})


def changelog(obs: DataFrame, config: AggregatorConfig = AggregatorConfig(), rules: FilterConfig = FilterConfig(), entities: DataFrame | None = None, enrichment: DataFrame | None = None, origin_us: int = 0, end_us: int | None = None) -> DataFrame:
    """New, Update and Withdraw events of all observations; `max_spots` and `max_tracked` need the serial path (`serial.changelog`)."""
    rows = stored(state.needed(judged(obs, config, rules, entities, enrichment, origin_us)))
    return state.events(rows, config, rules, origin_us, end_us)


def metrics(raw: DataFrame, config: AggregatorConfig = AggregatorConfig(), rules: FilterConfig = FilterConfig()) -> DataFrame:
    """One row of what a run over raw lines received, dropped by the gate or a rule on single rows, emitted, and could not parse."""
    raw = stored(raw)
    rows = stored(state.needed(judged(observations(raw), config, rules)))
    out = state.events(rows, config, rules)
    bad = parse_lines(raw).agg(F.count_if((F.col("kind") == "Unknown") & (F.col("text") != "")).alias("parse_errors"))
    got = rows.agg(F.count(F.lit(1)).alias("spots_received"), F.count_if(~F.col("passes")).alias("spots_filtered"))
    # three rows of one number each meet
    return got.crossJoin(out.agg(F.count(F.lit(1)).alias("spots_emitted"))).crossJoin(bad)
