"""One query for each operator of the inventory over the driver's tables, with its DuckDB twin where SQL can express it.

The tables hold no spots, so `events` rows become lines of a spotting node by whole-number arithmetic that both engines share; the Spark
side then parses those lines, the SQL side computes the fields directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lines, scalar
from .operators import lookup, observations, pipeline, quality, serial, windows
from .operators.store import spread, stored
from .plans.config import AggregatorConfig, Callsigns, Content, Correlation, Dedupe, Enrichment, EntityRules, FilterConfig, Geo, Membership, Patterns, Profile, Rf, SkimmerMetrics, SkimmerQuality, Spotters
from .plans.predicate import drop_reason
from .sources.files import format_age, format_band, format_freq, format_mode, json_lines, truncate

START = 1_704_067_200_000_000
STEP = 2_000_000
Query = Callable[[SparkSession, str], DataFrame]

# ---- the observations, twice ----

_FIELDS = """
select event_id as seq, {start} + event_id * {step} as t_us, concat('src', event_id % 3) as source_id,
  concat('K', (user_id % 12) % 3, case when (user_id % 12) % 2 = 0 then 'A' else 'B' end, substr('CDEF', cast(((user_id % 12) {div} 3) % 4 as int) + 1, 1)) as dx_call,
  case (event_id {div} 500) % 5 when 0 then 14025000 when 1 then 7025000 when 2 then 21025000 when 3 then 3525000 else 28025000 end + (k % 4) * 100 + 1000 * ((event_id {div} 300) % 2) as freq_hz,
  case when event_type in ('view', 'click', 'error') then 'Skimmer' else 'Human' end as originator_kind,
  case when event_type in ('view', 'click', 'error') then concat('SK', k % 12, '-', k % 9 + 1) else concat('SK', k % 12) end as spotter_call,
  case event_type when 'view' then 'CW 15 dB  22 WPM  CQ' when 'click' then concat('CW ', k % 30, ' dB  25 WPM') when 'error' then 'FT8 -12 dB  1500 Hz' when 'purchase' then 'UP 2' end as comment,
  case event_type when 'view' then 15 when 'click' then k % 30 when 'error' then -12 end as snr_db, case event_type when 'view' then 22 when 'click' then 25 end as wpm,
  case when event_type = 'view' then true else false end as is_cq, case event_type when 'view' then 'CW' when 'click' then 'CW' when 'error' then 'DIG' end as said
from ({events}) e"""
_DUCK_EVENTS = "select *, cast(json_extract(props, '$.k') as bigint) as k from events"
OBS = _FIELDS.format(start=START, step=STEP, div="//", events=_DUCK_EVENTS)


def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    events = spread(spark.read.parquet(f"{sf}/events.parquet")).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return spark.sql(_FIELDS.format(start=START, step=STEP, div="div", events="select * from {events}"), events=events)


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines a node would have sent."""
    f = event_fields(spark, sf)
    khz = F.concat(F.floor(F.col("freq_hz") / 1000).cast("string"), F.lit("."), F.floor(F.pmod(F.col("freq_hz"), F.lit(1000)) / 100).cast("string"))
    minute = F.pmod(F.col("seq"), F.lit(1440))
    hhmm = F.format_string("%02d%02dZ", F.floor(minute / 60), F.pmod(minute, F.lit(60)))
    value = F.concat_ws("", F.lit("DX de "), "spotter_call", F.lit(":  "), khz, F.lit("  "), "dx_call", F.lit("  "), F.coalesce("comment", F.lit("")), F.lit(" "), hhmm)
    return f.select("source_id", "seq", "t_us", value.alias("value"), F.lit("Auto").alias("originator_policy"))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return observations.observations(raw_lines(spark, sf))


# The twins' ranges are written out by themselves (kHz), so that an edge that is wrong in one place shows.
_BANDS = "1800-2000 B160, 3500-4000 B80, 5250-5450 B60, 7000-7300 B40, 10100-10150 B30, 14000-14350 B20, 18068-18168 B17, 21000-21450 B15, 24890-24990 B12, 28000-29700 B10, 50000-54000 B6, 144000-148000 B2"
_USUAL = (
    "1800-1840 CW, 1840-2000 SSB, 3500-3600 CW, 3600-4000 SSB, 5250-5450 DIG, 7000-7125 CW, 7125-7300 SSB, 10100-10140 CW, 10140-10150 DIG, 14000-14100 CW, 14100-14112 DIG, 14112-14350 SSB, "
    "18068-18110 CW, 18110-18168 SSB, 21000-21200 CW, 21200-21450 SSB, 24890-24930 CW, 24930-24990 SSB, 28000-28300 CW, 28300-29700 SSB, 50000-50100 CW, 50100-50300 SSB, 50300-50400 DIG, 50400-54000 SSB, "
    "144000-144150 CW, 144150-144400 SSB, 144400-148000 DIG"
)


def _parts(text: str) -> list[tuple[int, int, str]]:
    """(lo, hi, name) in Hz, in order: the first range that holds a frequency counts."""
    return [(int(lo) * 1000, int(hi) * 1000, name) for part in text.split(", ") for span, name in [part.split()] for lo, hi in [span.split("-")]]


def _ranges(column: str, parts: list[tuple[int, int, str]]) -> str:
    return "case " + " ".join(f"when {column} between {lo} and {hi} then '{v}'" for lo, hi, v in parts) + " else 'Unknown' end"


_BAND, _MODE = _ranges("freq_hz", _parts(_BANDS)), _ranges("freq_hz", _parts(_USUAL))
KEYED = f"""
select *, case mode when 'CW' then freq_hz // 200 * 200 when 'DIG' then freq_hz // 100 * 100 else freq_hz // 1000 * 1000 end as freq_bucket_hz from (
  select *, dx_call as dx_call_norm, spotter_call as spotter_call_norm, {_BAND} as band, coalesce(case when originator_kind = 'Skimmer' then said end, {_MODE}) as mode from ({OBS}) o) m"""
_TICK = "(t_us - t_us % 10000000)"
_K = "dx_call_norm, band, mode, freq_bucket_hz"
INCARNATIONS = f"""
select *, sum(case when before is not null and ({_TICK} - before) // 1000000 > 900 then 1 else 0 end) over (partition by {_K} order by seq rows unbounded preceding) as incarnation from (
  select *, lag(t_us) over (partition by {_K} order by seq) as before from ({KEYED}) k) b"""
_RUN = f"over (partition by {_K}, incarnation order by seq rows unbounded preceding)"
RUNNING = f"""
select *, list_unique(list(spotter_call_norm) {_RUN}) as unique_originators, list_unique(list(case when originator_kind = 'Human' then spotter_call_norm end) {_RUN}) as unique_human_originators,
  list_unique(list(source_id) {_RUN}) as unique_sources, count(*) {_RUN} as revision, first(t_us) {_RUN} as first_seen_us, least(count(*) {_RUN}, 20) as total_observations,
  last_value(comment ignore nulls) {_RUN} as last_comment, first(dx_call) {_RUN} as first_dx_call from ({INCARNATIONS}) i"""
_CORROBORATED = f"""
select a.seq, count(distinct b.spotter_call_norm) as distinct_skimmers from ({KEYED}) a join ({KEYED}) b
  on a.dx_call_norm = b.dx_call_norm and b.seq <= a.seq and abs(a.freq_hz - b.freq_hz) <= 300 and (a.t_us - b.t_us) // 1000000 <= 180 and b.originator_kind = 'Skimmer'
  where a.originator_kind = 'Skimmer' group by a.seq"""
_VERIFIED = f"""
select s.*, d.distinct_skimmers, d.distinct_skimmers >= 3 as v,
  last_value(case when d.distinct_skimmers >= 3 then freq_hz end ignore nulls) over w as prev_f, last_value(case when d.distinct_skimmers >= 3 then t_us end ignore nulls) over w as prev_t,
  lead(case when d.distinct_skimmers >= 3 then seq end ignore nulls) over (partition by dx_call_norm order by seq) as next_v
from ({KEYED}) s join ({_CORROBORATED}) d using (seq) window w as (partition by dx_call_norm order by seq rows between unbounded preceding and 1 preceding)"""
TAGS = f"""
with ver as ({_VERIFIED}),
bust as (select a.seq, min({{'d': levenshtein(a.dx_call_norm, b.dx_call_norm), 'c': b.dx_call_norm}}) as s from ver a join ver b on not a.v and b.v and b.seq < a.seq and coalesce(b.next_v > a.seq, true)
  and abs(a.freq_hz - b.freq_hz) <= 100 and a.dx_call_norm <> b.dx_call_norm and levenshtein(a.dx_call_norm, b.dx_call_norm) <= 1 and (a.t_us - a.t_us % 10000000 - b.t_us) // 1000000 <= 360 group by a.seq)
select ver.*, case when ({_TICK} - prev_t) // 1000000 <= 360 then prev_f end as previous_freq_hz, s.c as similar_call, s.d as edit_distance,
  case when v and coalesce(({_TICK} - prev_t) // 1000000 <= 360 and abs(freq_hz - prev_f) > 400, false) then 'Qsy' when v then 'Valid' when s is not null then 'Busted' else 'Unknown' end as skim_quality
from ver left join bust using (seq)"""
_CBM = "partition by dx_call_norm, band, mode order by seq"
NEW = f"""
select * from (select *, lag(freq_bucket_hz) over ({_CBM}) as pb, lag(incarnation) over ({_CBM}) as pi from ({INCARNATIONS}) i where freq_hz between 1800000 and 54000000) p
where pb is null or pb <> freq_bucket_hz or pi <> incarnation"""



def _machine(rows: str, updates_us: int | None) -> str:
    """The changelog of rows(`KEYED` and pass) as a recursion over each call, band and mode: the open spots are a list."""
    due = "(e.last + 901000000 + 9999999) // 10000000 * 10000000"
    spot = "struct(b bigint, first bigint, last bigint, rev bigint, em bigint, freq bigint)"
    event = "{{'kind': {kind}, 'due': {at}, 'seq': {seq}, 'b': e.b, 'rev': e.rev, 'freq': e.freq, 'first': e.first, 'last': e.last}}"
    made = lambda kind, at, seq: event.format(kind=kind, at=at, seq=seq)
    update = f"when old.em is not null and t_us - old.em >= {updates_us} then 'Update'" if updates_us is not None else ""
    return f"""
with recursive r as (select *, row_number() over (partition by dx_call_norm, band, mode order by t_us, source_id, seq) as n from ({rows}) x),
fin as (select max(t_us) as end_us from r),
s as (
  select distinct dx_call_norm, band, mode, 0::bigint as n, []::{spot}[] as spots, null::bigint as outb,
    []::struct(kind varchar, due bigint, seq bigint, b bigint, rev bigint, freq bigint, first bigint, last bigint)[] as ev from r
  union all
  select dx_call_norm, band, mode, n, list_append(list_filter(live, lambda e: e.b <> b and not (qsy and e.b = out1)), me), case when kind = 'New' then b else out1 end,
    list_concat(list_concat(list_transform(gone, lambda e: {made("'Withdraw'", due, "null::bigint")}),
      case when qsy then list_transform(list_filter(live, lambda e: e.b = out1), lambda e: {made("'Withdraw'", "t_us", "seq")}) else [] end),
      case when kind is not null then list_transform([me], lambda e: {made("kind", "t_us", "seq")}) else [] end)
  from (
    select *, coalesce(kind, '') = 'New' and out1 is not null and out1 <> b as qsy,
      {{'b': b, 'first': coalesce(old.first, t_us), 'last': t_us, 'rev': coalesce(old.rev, 0) + 1, 'em': case when kind is not null then t_us else old.em end, 'freq': freq_hz}}::{spot} as me
    from (
      select *, case when not pass then null when old is null or old.em is null then 'New' {update} end as kind
      from (
        select *, list_filter(live, lambda e: e.b = b)[1] as old, case when len(list_filter(gone, lambda e: e.b = outb)) > 0 then null else outb end as out1
        from (
          select s.dx_call_norm, s.band, s.mode, r.n, s.outb, r.t_us, r.seq, r.freq_hz, r.pass, r.freq_bucket_hz as b,
            list_filter(s.spots, lambda e: {due} <= r.t_us // 10000000 * 10000000) as gone, list_filter(s.spots, lambda e: {due} > r.t_us // 10000000 * 10000000) as live
          from s join r on r.dx_call_norm = s.dx_call_norm and r.band = s.band and r.mode = s.mode and r.n = s.n + 1) a) c) d) f
),
last_state as (select dx_call_norm, band, mode, arg_max(spots, n) as spots from s group by all),
happened as (
  select dx_call_norm, band, mode, unnest(ev) as x from s
  union all
  select dx_call_norm, band, mode, unnest(list_transform(list_filter(spots, lambda e: {due} <= end_us), lambda e: {made("'Withdraw'", due, "null::bigint")})) as x from last_state, fin)
select dx_call_norm, band, mode, x.b as freq_bucket_hz, x.due as at_us, x.seq as seq, x.kind as kind, x.rev as revision, x.freq as freq_hz, x.first as first_seen_us, x.last as last_seen_us from happened"""


# three sources that number their lines alike, in threes that arrive at once; rows stand in (t_us, source_id, seq)
_ALIKE = KEYED.replace(f"({OBS}) o", f"(select * replace ({START} + event_seq // 3 * {3 * STEP} as t_us, event_seq // 3 as seq) from (select *, seq as event_seq from ({OBS}) o1) o2) o")
_A_RUN = f"over (partition by {_K}, incarnation order by t_us, source_id rows unbounded preceding)"
_SAME = f"""
with k as ({_ALIKE}),
b as (select *, lag(t_us) over (partition by {_K} order by t_us, source_id) as before from k),
i as (select *, sum(case when before is not null and ({_TICK} - before) // 1000000 > 900 then 1 else 0 end) over (partition by {_K} order by t_us, source_id rows unbounded preceding) as incarnation from b),
st as (select source_id, seq, count(*) {_A_RUN} as revision, list_unique(list(spotter_call_norm) {_A_RUN})::int as unique_originators, last_value(comment ignore nulls) {_A_RUN} as last_comment from i),
c as (select x.source_id, x.seq, count(distinct y.spotter_call_norm) as d from k x join k y on x.dx_call_norm = y.dx_call_norm and (y.t_us < x.t_us or y.t_us = x.t_us and y.source_id <= x.source_id) and abs(x.freq_hz - y.freq_hz) <= 300
  and (x.t_us - y.t_us) // 1000000 <= 180 and y.originator_kind = 'Skimmer' where x.originator_kind = 'Skimmer' group by all),
ver as (select k.*, d, d >= 3 as v, row_number() over (order by t_us, source_id) as pos from k join c using (source_id, seq)),
w as (select *, last_value(case when v then freq_hz end ignore nulls) over z as prev_f, last_value(case when v then t_us end ignore nulls) over z as prev_t, lead(case when v then pos end ignore nulls) over (partition by dx_call_norm order by pos) as next_v
  from ver window z as (partition by dx_call_norm order by pos rows between unbounded preceding and 1 preceding)),
bust as (select distinct a.pos from w a join w b on not a.v and b.v and b.pos < a.pos and coalesce(b.next_v > a.pos, true) and abs(a.freq_hz - b.freq_hz) <= 100 and a.dx_call_norm <> b.dx_call_norm and levenshtein(a.dx_call_norm, b.dx_call_norm) <= 1
  and (a.t_us - a.t_us % 10000000 - b.t_us) // 1000000 <= 360),
tag as (select source_id, seq, d::int as distinct_skimmers, case when v and coalesce(({_TICK} - prev_t) // 1000000 <= 360 and abs(freq_hz - prev_f) > 400, false) then 'Qsy' when v then 'Valid' when bust.pos is not null then 'Busted' else 'Unknown' end as skim_quality
  from w left join bust on bust.pos = w.pos)
select st.*, skim_quality, distinct_skimmers from st left join tag using (source_id, seq)"""
_QUIET = _machine(f"select *, freq_hz between 1800000 and 54000000 as pass from ({KEYED}) k", None)
_BUSY = _machine(f"select k.*, freq_hz between 1800000 and 54000000 and (originator_kind <> 'Skimmer' or coalesce(t.q, 'Unknown') = 'Valid') as pass from ({KEYED}) k left join (select seq as s, skim_quality as q from ({TAGS}) g) t on t.s = k.seq", 30_000_000)
# no split or QSY in the spot's last comment: the comment of a row without one is the entry's, which a withdrawal ends
_COMMENTS = f"""
select decision, count(*) as n from (select case when regexp_matches(coalesce(last_comment, ''), '(?i)\\b(UP|QSX|SPLIT|QSY)\\b') then 'SplitQsySuppressed' when not (coalesce(is_cq and comment is not null, false) or regexp_matches(coalesce(last_comment, ''), '(?i)\\bCQ\\b')) then 'CqRequired' else 'Allow' end as decision from ({RUNNING}) r) x group by decision"""

# ---- rule sets ----

RULES = {
    "F02": (FilterConfig(freq_sanity_hz=(7_000_000, 22_000_000)), "case when not freq_hz between 7000000 and 22000000 then 'FreqOutOfRange' end"),
    "F03": (FilterConfig(rf=Rf(band_deny=("B40",), band_allow=("B20", "B15", "B40"))), "case when band = 'B40' then 'BandDenied' when band not in ('B20', 'B15', 'B40') then 'BandDenied' end"),
    "F04": (FilterConfig(rf=Rf(mode_deny=("DIG",), mode_allow=("CW",))), "case when mode = 'DIG' then 'ModeDenied' when mode <> 'CW' then 'ModeDenied' end"),
    "F05": (FilterConfig(rf=Rf(freq_deny_hz=((14_025_100, 14_025_200), (7_000_000, 7_025_000)))), "case when freq_hz between 14025100 and 14025200 or freq_hz between 7000000 and 7025000 then 'FreqDenied' end"),
    "F06": (FilterConfig(rf=Rf(freq_allow_hz=((14_000_000, 14_100_000),))), "case when not freq_hz between 14000000 and 14100000 then 'FreqNotAllowed' end"),
    "F07": (FilterConfig(rf=Rf(profiles=(Profile("a", ((3_500_000, 3_600_000),)), Profile("b", ((28_000_000, 28_300_000),))))), "case when not (freq_hz between 3500000 and 3600000 or freq_hz between 28000000 and 28300000) then 'ProfileNoMatch' end"),
    "F08": (FilterConfig(dx=Callsigns(deny=Patterns(globs=("K0*",)), allow=Patterns(regexes=("A[CD]$",)))), "case when dx_call_norm like 'K0%' then 'DxCallDenied' when not regexp_matches(dx_call_norm, 'A[CD]$') then 'DxCallNotAllowed' end"),
    "F09": (FilterConfig(spotter=Spotters(allow_human=False)), "case when originator_kind = 'Human' then 'OriginatorKindDenied' end"),
    "F10": (FilterConfig(spotter=Spotters(source_deny=("src1",), source_allow=("src0", "src1"))), "case when source_id = 'src1' then 'SpotterDenied' when source_id not in ('src0', 'src1') then 'SpotterNotAllowed' end"),
    "F11": (FilterConfig(spotter=Spotters(callsign=Callsigns(deny=Patterns(globs=("sk1*",), case_insensitive=True)))), "case when spotter_call_norm like 'SK1%' then 'SpotterDenied' end"),
    "F12": (FilterConfig(content=Content(suppress_split_qsy=True)), "case when regexp_matches(coalesce(comment, ''), '(?i)\\b(UP|QSX|SPLIT|QSY)\\b') then 'SplitQsySuppressed' end"),
    "F13": (FilterConfig(content=Content(cq_only=True)), "case when not regexp_matches(coalesce(comment, ''), '(?i)\\bCQ\\b') then 'CqRequired' end"),
    "F14": (FilterConfig(content=Content(comment_allow=Patterns(globs=("CW*",)), comment_deny=Patterns(regexes=("25 WPM",)))), "case when comment like '%25 WPM%' then 'CommentDenied' when comment is null or comment not like 'CW%' then 'CommentNotAllowed' end"),
    "F16": (FilterConfig(unknown_policy="FailClosed", skimmer=SkimmerMetrics(snr_db=(20, 0), wpm=(20, 24))), "case when originator_kind = 'Skimmer' and not snr_db between 0 and 20 then 'SkimmerMetricNotMet' when originator_kind = 'Skimmer' and not wpm between 20 and 24 then 'SkimmerMetricNotMet' when originator_kind = 'Skimmer' and wpm is null then 'UnknownFieldFailed' end"),
}
ENTITIES = """with p as (select concat('K', n_nationkey % 3, case when n_nationkey < 3 then '' when n_nationkey < 6 then 'A' when n_nationkey < 9 then 'BC' else 'XX' end) as key, min(n_nationkey) as n from nation group by 1)
select key, n_name as entity, n_regionkey as cq_zone from p join nation on n_nationkey = n"""
RESOLVED = f"""select dx_call_norm, arg_max(entity, length(key)) as entity, arg_max(cq_zone, length(key)) as cq_zone from (select distinct dx_call_norm from ({KEYED}) k) c join ({ENTITIES}) e on starts_with(dx_call_norm, key) group by 1"""

_RESOLVED_FEWER = RESOLVED.replace("starts_with(dx_call_norm, key)", "starts_with(dx_call_norm, key) and key <> 'K0'")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    tail = F.when(F.col("n_nationkey") < 3, "").when(F.col("n_nationkey") < 6, "A").when(F.col("n_nationkey") < 9, "BC").otherwise("XX")
    key = F.concat(F.lit("K"), F.pmod("n_nationkey", F.lit(3)).cast("string"), tail)
    best = n.groupBy(key.alias("key")).agg(F.min_by(F.struct("n_name", "n_regionkey"), "n_nationkey").alias("e"))
    none = F.lit(None)
    return best.select("key", F.lit(False).alias("exact"), F.col("e.n_name").alias("entity"), F.lit("NA").alias("continent"), F.col("e.n_regionkey").cast("int").alias("cq_zone"), none.cast("int").alias("itu_zone"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.col("key").alias("primary_prefix"))


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Members among the calls: one row for each of some calls."""
    r = spark.read.parquet(f"{sf}/region.parquet")
    key = F.col("r_regionkey")
    call = F.concat(F.lit("K"), F.pmod(key, F.lit(3)).cast("string"), F.when(key % 2 == 0, "A").otherwise("B"), F.when(key < 2, "C").otherwise("D"))
    return r.select(call.alias("call"), (key % 2 == 0).alias("lotw"), (key < 3).alias("in_master_db"), F.lit(None).cast("boolean").alias("in_callbook"), F.when(key != 1, F.array(F.concat(F.lit("club"), key.cast("string")))).alias("memberships"))


ENRICHED = f"""select k.*, lotw, in_master_db, club from ({KEYED}) k left join (select concat('K', r_regionkey % 3, case when r_regionkey % 2 = 0 then 'A' else 'B' end, case when r_regionkey < 2 then 'C' else 'D' end) as call, r_regionkey % 2 = 0 as lotw, r_regionkey < 3 as in_master_db,
  case when r_regionkey <> 1 then concat('club', r_regionkey) end as club from region) e on e.call = k.dx_call_norm"""


# ---- queries ----


def _reasons(rules: FilterConfig) -> Query:
    def run(spark, sf):
        rows = observations.view(observations.keyed(obs(spark, sf)))
        return rows.groupBy(F.coalesce(drop_reason(rules), F.lit("Allow")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))

    return run


def _skims(spark: SparkSession, sf: str) -> DataFrame:
    return observations.keyed(obs(spark, sf)).where(F.col("originator_kind") == "Skimmer")


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return quality.tags(_skims(spark, sf), SkimmerQuality())


def _incarnations(spark: SparkSession, sf: str) -> DataFrame:
    return windows.incarnations(observations.keyed(obs(spark, sf)), origin_us=0)


def _running(spark: SparkSession, sf: str) -> DataFrame:
    return windows.running(_incarnations(spark, sf))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Lines -> spots -> keys -> one row a key."""
    rows = observations.keyed(obs(spark, sf))
    return rows.groupBy(*observations.KEY).agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_seen_us"), F.max("t_us").alias("last_seen_us"), F.count_distinct("spotter_call_norm").alias("originators"))


def _new(spark: SparkSession, sf: str) -> DataFrame:
    rows = _incarnations(spark, sf).withColumn("passes", F.col("freq_hz").between(1_800_000, 54_000_000))
    return windows.new_events(rows)


def _quiet() -> AggregatorConfig:
    return AggregatorConfig(dedupe=Dedupe(qsy_coalesce_us=None))


def _busy() -> AggregatorConfig:
    return AggregatorConfig(dedupe=Dedupe(emit_updates=True, min_update_interval_us=30_000_000, qsy_coalesce_us=None), skimmer=SkimmerQuality())


LOG = [*observations.KEY, "at_us", "seq", "kind", "revision", "freq_hz", "first_seen_us", "last_seen_us"]


def _events(config: AggregatorConfig, rules: FilterConfig = FilterConfig()) -> Query:
    return lambda spark, sf: pipeline.changelog(obs(spark, sf), config, rules).select(*LOG)


def _capped(config: AggregatorConfig) -> Query:
    return lambda spark, sf: serial.changelog(obs(spark, sf), config).select(*LOG)


def _content(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on a comment judge the spot's last one."""
    return _decisions(observations.view(_running(spark, sf)), FilterConfig(content=Content(suppress_split_qsy=True, cq_only=True)))


def _same_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources that number their lines alike, in threes that arrive at once."""
    rows = obs(spark, sf).withColumns({"t_us": F.lit(START) + F.floor(F.col("seq") / 3) * 3 * STEP, "seq": F.floor(F.col("seq") / 3)})
    rows = quality.tagged(observations.keyed(rows))
    return windows.running(windows.incarnations(rows)).select(*observations.ROW, "revision", "unique_originators", "last_comment", "skim_quality", "distinct_skimmers")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_lines(spark, sf)
    junk = raw.select("source_id", "seq", "t_us", F.when(F.col("seq") % 3 == 0, "no spot").when(F.col("seq") % 3 == 1, "").otherwise("login: ").alias("value"), "originator_policy")
    rules = FilterConfig(rf=Rf(band_deny=("B40",)))
    return pipeline.metrics(raw.unionByName(junk), AggregatorConfig(dedupe=Dedupe(qsy_coalesce_us=None)), rules)


def _spotter_geo(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of spotters: the prefixes of the DX side, moved to the calls that spot."""
    e = entities(spark, sf).withColumn("key", F.concat(F.lit("S"), "key"))
    rows = lookup.with_geo(observations.keyed(obs(spark, sf)), e, "spotter_call_norm", "spotter_geo")
    return _decisions(observations.view(rows), FilterConfig(geo=Geo(spotter=EntityRules(entity_deny=("NATION_1",), cq_zone_allow=(0, 1, 2)))))


_CLASSIFY = [("To ALL de W1AW: hi", "Announce"), ("WWV de VE7CC <00>: SFI=150", "Propagation"), ("login: ", "Prompt"), ("W1AW-2>", "Prompt"), ("hello", "Unknown"), ("   ", "Unknown")]


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % len(_CLASSIFY)).alias("i"))
    pick = F.element_at(F.array(*[F.lit(v) for v, _ in _CLASSIFY]), (F.col("i") + 1).cast("int"))
    both = e.select(pick.alias("value")).unionByName(raw_lines(spark, sf).select("value"))
    return lines.parse_lines(both).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _parses_anything(spark: SparkSession, sf: str) -> DataFrame:
    """Any text is some kind of line."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("value"))
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("text").alias("value"))
    return lines.parse_lines(d.unionByName(c)).agg(F.count("kind").alias("n"), F.count_if(F.col("kind") == "Spot").alias("spots"))


def _scalars(spark: SparkSession, sf: str) -> DataFrame:
    f = event_fields(spark, sf)
    call = F.concat(F.lower("dx_call"), F.when(F.col("seq") % 3 == 0, "/p").when(F.col("seq") % 3 == 1, "/qrp/mm").otherwise(""))
    f = f.withColumn("call", call).withColumn("wide", F.col("seq") * 15_013 % 150_000_000)
    e = scalar.band_edges(scalar.freq_to_band(F.col("wide")))
    return f.select(
        "seq", scalar.normalize_callsign(F.col("call")).alias("normal"), scalar.normalize_callsign(F.col("call"), portable_policy="StripCommonSuffixes").alias("bare"), scalar.normalize_callsign(F.col("call"), portable_policy="StripAllAfterSlash", strip_non_alnum=True).alias("cut"),
        scalar.base_callsign(F.col("call")).alias("base"), scalar.is_likely_skimmer(F.col("spotter_call")).alias("skimmer"), scalar.freq_to_band(F.col("wide")).alias("band"), scalar.freq_to_mode(F.col("wide")).alias("mode"),
        e["lo"].alias("lo"), e["hi"].alias("hi"), scalar.resolve_mode(F.col("wide"), F.col("said")).alias("resolved"), scalar.freq_bucket(F.col("wide"), scalar.freq_to_mode(F.col("wide"))).alias("bucket"),
        scalar.edit_distance(F.col("dx_call"), F.lit("K1AC")).alias("distance"), scalar.saturate(F.col("seq")).alias("capped"),
    )


_SCALARS = f"""with f as (select *, concat(lower(dx_call), case seq % 3 when 0 then '/p' when 1 then '/qrp/mm' else '' end) as call, seq * 15013 % 150000000 as freq_hz_w from ({OBS}) o)
select seq, upper(call) as normal, case seq % 3 when 0 then upper(dx_call) when 1 then upper(dx_call) || '/QRP' else upper(dx_call) end as bare, case seq % 3 when 1 then upper(dx_call) || '/QRP' else upper(dx_call) end as cut,
  lower(dx_call) as base, originator_kind = 'Skimmer' as skimmer, {_BAND.replace("freq_hz", "freq_hz_w")} as band, {_MODE.replace("freq_hz", "freq_hz_w")} as mode,
  {_ranges("freq_hz_w", [(lo, hi, str(lo)) for lo, hi, _ in _parts(_BANDS)]).replace("'Unknown'", "null")}::bigint as lo, {_ranges("freq_hz_w", [(lo, hi, str(hi)) for lo, hi, _ in _parts(_BANDS)]).replace("'Unknown'", "null")}::bigint as hi,
  coalesce(said, {_MODE.replace("freq_hz", "freq_hz_w")}) as resolved, case {_MODE.replace("freq_hz", "freq_hz_w")} when 'CW' then freq_hz_w // 200 * 200 when 'DIG' then freq_hz_w // 100 * 100 else freq_hz_w // 1000 * 1000 end as bucket,
  levenshtein(dx_call, 'K1AC') as distance, least(seq, 255)::int as capped from f"""


def _formats(spark: SparkSession, sf: str) -> DataFrame:
    k = observations.keyed(obs(spark, sf))
    return k.select("seq", format_freq(F.col("freq_hz")).alias("khz"), format_band(F.col("band")).alias("band"), format_age(F.col("seq")).alias("age"), format_mode(F.col("mode")).alias("mode"), truncate(F.col("spotter_call"), 4).alias("spotter"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """The busy changelog with a number that orders each key's events."""
    return _events(_busy())(spark, sf).withColumn("event_no", F.struct("at_us", F.col("seq").isNotNull(), F.col("kind") != "Withdraw"))


def _live(spark: SparkSession, sf: str) -> DataFrame:
    events = stored(_numbered(spark, sf))
    return windows.active_view(events, events.agg(F.max("at_us")).first()[0] or 0)


_GEO = FilterConfig(geo=Geo(dx=EntityRules(entity_deny=("NATION_1",), cq_zone_allow=(0, 1, 2))))
_RESOLVERS = FilterConfig(geo=Geo(dx=EntityRules(entity_deny=("NATION_1",)), require_resolvers=True))
_MEMBERS = FilterConfig(enrichment=Enrichment(lotw="RequireTrue", membership=(Membership("Deny", "club2"),)))
_OPEN = FilterConfig(unknown_policy="FailOpen", enrichment=Enrichment(membership=(Membership("Require", "club0"),)))
_CLOSED = FilterConfig(unknown_policy="FailClosed", enrichment=Enrichment(in_master_db="RequireFalse"))


def _decisions(rows: DataFrame, rules: FilterConfig) -> DataFrame:
    return rows.groupBy(F.coalesce(drop_reason(rules), F.lit("Allow")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def _geo(rules: FilterConfig, known: str = "true") -> Query:
    def run(spark, sf):
        rows = observations.keyed(obs(spark, sf))
        return _decisions(observations.view(lookup.with_geo(rows, entities(spark, sf).where(known), "dx_call_norm", "dx_geo")), rules)

    return run


def _members(rules: FilterConfig) -> Query:
    def run(spark, sf):
        return _decisions(observations.view(lookup.enrich(observations.keyed(obs(spark, sf)), enrichment(spark, sf))), rules)

    return run


def _aged(spark: SparkSession, sf: str) -> DataFrame:
    """Spots last seen up to 2,000 s ago."""
    rows = observations.keyed(obs(spark, sf)).withColumns({"now_us": F.col("t_us"), "last_seen_us": F.col("t_us") - F.pmod(F.col("seq"), F.lit(2000)) * 1_000_000})
    return _decisions(observations.view(rows), FilterConfig())


def _correlated(spark: SparkSession, sf: str) -> DataFrame:
    rules = FilterConfig(correlation=Correlation(min_unique_originators=2, min_unique_sources=2, min_observations=3))
    rows = observations.view(_running(spark, sf).withColumn("now_us", F.col("t_us")))
    return rows.groupBy(F.coalesce(drop_reason(rules), F.lit("Allow")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def table() -> dict[str, tuple[Query, str | None]]:
    keys = _K
    out: dict[str, tuple[Query, str | None]] = {
        "entry": (entry, f"select {keys}, count(*) as n, min(t_us) as first_seen_us, max(t_us) as last_seen_us, count(distinct spotter_call_norm) as originators from ({KEYED}) k group by {keys}"),
        "P01_classify": (_classified, "select kind, count(*) as n from (select case event_id % 6 when 0 then 'Announce' when 1 then 'Propagation' when 2 then 'Prompt' when 3 then 'Prompt' else 'Unknown' end as kind from events union all select 'Spot' from events) k group by kind"),
        "P01_any_text": (_parses_anything, "select (select count(*) from documents) + (select count(*) from conversations) as n, 0 as spots"),
        "P02_parse": (lambda s, d: lines.parse_lines(raw_lines(s, d)).select("seq", "spotter_call", "dx_call", "freq_hz", "comment", "utc_minute"), f"select seq, spotter_call, dx_call, freq_hz, comment, (seq % 1440)::int as utc_minute from ({OBS}) o"),
        "P06_skimmer_fields": (lambda s, d: obs(s, d).select("seq", F.col("skimmer_fields.snr_db").cast("int").alias("snr_db"), F.col("skimmer_fields.wpm").alias("wpm"), F.col("skimmer_fields.is_cq").alias("is_cq"), F.col("skimmer_fields.mode").alias("mode")), f"select seq, snr_db::int as snr_db, wpm, case when comment is not null then is_cq end as is_cq, said as mode from ({OBS}) o"),
        "P09_keys": (lambda s, d: observations.keyed(obs(s, d)).select("seq", "originator_kind", *observations.KEY), f"select seq, originator_kind, {keys} from ({KEYED}) k"),
        "P12_formats": (_formats, f"select seq, concat(freq_hz // 1000, '.', freq_hz % 1000 // 100) as khz, case when band = 'Unknown' then '?' else substr(band, 2) || 'm' end as band, case when seq < 60 then concat(seq, 's') when seq < 3600 then concat(seq // 60, 'm', lpad((seq % 60)::varchar, 2, '0'), 's') else concat(seq // 3600, 'h', lpad((seq % 3600 // 60)::varchar, 2, '0'), 'm') end as age, case when mode = 'Unknown' then '?' else mode end as mode, substr(spotter_call, 1, 4) as spotter from ({KEYED}) k"),
        "C_scalars": (_scalars, _SCALARS),
        "S09_fan_in": (lambda s, d: observations.fan_in(*[obs(s, d).where(F.col("source_id") == f"src{i}") for i in range(3)]).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), f"select source_id, count(*) as n from ({OBS}) o group by source_id"),
        "S10_announcements": (lambda s, d: observations.announcements(raw_lines(s, d).withColumn("value", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("To ALL de "), "value")).otherwise(F.col("value")))).select("source_id", "seq", "t_us"), f"select source_id, seq, t_us from ({OBS}) o where seq % 2 = 0"),
        "S10_statuses": (lambda s, d: observations.statuses(raw_lines(s, d).withColumns({"value": F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Reconnecting "), F.col("seq").cast("string"))).otherwise("Failed by peer"), "originator_policy": F.when(F.col("seq") % 3 == 0, "Status").otherwise("Auto")})).select("source_id", "seq", "state", "attempt", "reason"), f"select source_id, seq, case when seq % 2 = 0 then 'Reconnecting' else 'Failed' end as state, case when seq % 2 = 0 then seq::int end as attempt, case when seq % 2 = 1 then 'by peer' end as reason from ({OBS}) o where seq % 3 = 0"),
        "S17_raw_lines": (lambda s, d: observations.observations(raw_lines(s, d), keep_raw=True).select("seq", F.regexp_extract("raw", "^DX de ([^:]+):", 1).alias("said")), f"select seq, spotter_call as said from ({OBS}) o"),
        "P11_view": (_content, _COMMENTS),
        "K01_order": (_same_numbers, _SAME),
        "A13_metrics": (_metrics, f"select 2 * (select count(*) from events) - (select count(*) from events) as spots_received, (select count(*) from ({KEYED}) k where band = 'B40') as spots_filtered, (select count(*) from ({_machine(f"select *, freq_hz between 1800000 and 54000000 and band <> 'B40' as pass from ({KEYED}) k", None)}) e) as spots_emitted, (select count(*) from events where event_id % 3 = 0) as parse_errors"),
        "A14_unique_originators": (lambda s, d: observations.unique_originators(observations.keyed(obs(s, d)), ["dx_call_norm"], human_only=True), f"select dx_call_norm, least(count(distinct case when originator_kind = 'Human' then spotter_call_norm end), 255)::int as unique_originators from ({KEYED}) k group by 1"),
        "J02_spotter_entities": (_spotter_geo, f"select decision, count(*) as n from (select case when cq_zone is null then 'UnknownFieldFailed' when cq_zone not in (0, 1, 2) then 'GeoNotMet' when entity = 'NATION_1' then 'GeoNotMet' else 'Allow' end as decision from ({KEYED}) k left join (select spotter_call_norm as c, arg_max(entity, length(key)) as entity, arg_max(cq_zone, length(key)) as cq_zone from (select distinct spotter_call_norm from ({KEYED}) k) c join (select 'S' || key as key, entity, cq_zone from ({ENTITIES}) e) e on starts_with(spotter_call_norm, key) group by 1) r on r.c = k.spotter_call_norm) x group by decision"),
        "K02_evict": (_capped(AggregatorConfig(max_spots=40)), None),
        "K04_tracked": (_capped(AggregatorConfig(skimmer=SkimmerQuality(max_tracked=60))), None),
        "S12_json": (lambda s, d: json_lines(entry(s, d).select("dx_call_norm", "band", "n")), f"select '{{\"dx_call_norm\":\"' || dx_call_norm || '\",\"band\":\"' || band || '\",\"n\":' || count(*) || '}}' as value from ({KEYED}) k group by {keys}"),
        "F15_correlation": (_correlated, f"select decision, count(*) as n from (select case when unique_originators < 2 or unique_sources < 2 or total_observations < 3 then 'CorrelationNotMet' else 'Allow' end as decision from ({RUNNING}) r) x group by decision"),
        "F18_entity_rules": (_geo(_GEO), f"select decision, count(*) as n from (select case when cq_zone is null then 'UnknownFieldFailed' when cq_zone not in (0, 1, 2) then 'GeoNotMet' when entity = 'NATION_1' then 'GeoNotMet' else 'Allow' end as decision from ({KEYED}) k left join ({RESOLVED}) r using (dx_call_norm)) x group by decision"),
        "F19_enrichment_rules": (_members(_MEMBERS), f"select decision, count(*) as n from (select case when lotw is null then 'UnknownFieldFailed' when not lotw then 'EnrichmentNotMet' when club is null then 'UnknownFieldFailed' when club = 'club2' then 'EnrichmentNotMet' else 'Allow' end as decision from ({ENRICHED}) k) x group by decision"),
        "F01_age": (_aged, f"select decision, count(*) as n from (select case when seq % 2000 > 900 then 'TooOld' else 'Allow' end as decision from ({KEYED}) k) x group by decision"),
        "F17_resolvers": (_geo(_RESOLVERS, "key <> 'K0'"), f"select decision, count(*) as n from (select case when entity is null then 'UnknownFieldFailed' when entity = 'NATION_1' then 'GeoNotMet' else 'Allow' end as decision from ({KEYED}) k left join ({_RESOLVED_FEWER}) r using (dx_call_norm)) x group by decision"),
        "F20_membership_open": (_members(_OPEN), f"select decision, count(*) as n from (select case when club <> 'club0' then 'EnrichmentNotMet' else 'Allow' end as decision from ({ENRICHED}) k) x group by decision"),
        "F21_unknown_closed": (_members(_CLOSED), f"select decision, count(*) as n from (select case when in_master_db is null then 'UnknownFieldFailed' when in_master_db then 'EnrichmentNotMet' else 'Allow' end as decision from ({ENRICHED}) k) x group by decision"),
        "J03_longest_prefix": (lambda s, d: lookup.resolve(observations.keyed(obs(s, d)), entities(s, d), "dx_call_norm").select("dx_call_norm", "entity", "cq_zone"), RESOLVED),
        "J05_enrichment": (lambda s, d: lookup.enrich(observations.keyed(obs(s, d)), enrichment(s, d)).groupBy("dx_call_norm").agg(F.any_value("lotw").alias("lotw"), F.any_value("in_master_db").alias("in_master_db"), F.concat_ws(",", F.any_value("memberships")).alias("club")), f"select dx_call_norm, any_value(lotw) as lotw, any_value(in_master_db) as in_master_db, coalesce(any_value(club), '') as club from ({ENRICHED}) k group by dx_call_norm"),
        "J06_corroboration": (lambda s, d: quality.corroboration(_skims(s, d)).select("seq", "distinct_skimmers"), _CORROBORATED),
        "W03_previous_verified": (lambda s, d: _tags(s, d).select("seq", "previous_freq_hz"), f"select seq, previous_freq_hz from ({TAGS}) t"),
        "J07_similar_calls": (lambda s, d: _tags(s, d).where("skim_quality = 'Busted'").select("seq", "similar_call", "edit_distance"), f"select seq, similar_call, edit_distance from ({TAGS}) t where skim_quality = 'Busted'"),
        "G04_quality_tags": (lambda s, d: _tags(s, d).select("seq", "skim_quality", "distinct_skimmers"), f"select seq, skim_quality, distinct_skimmers from ({TAGS}) t"),
        "G07_gate": (lambda s, d: _tags(s, d).where(quality.should_emit(F.col("skim_quality"), F.lit("Skimmer"), SkimmerQuality(allow=("Valid", "Qsy")))).groupBy("skim_quality").agg(F.count(F.lit(1)).alias("n")), f"select skim_quality, count(*) as n from ({TAGS}) t where skim_quality in ('Valid', 'Qsy') group by 1"),
        "A_running": (lambda s, d: _running(s, d).select("seq", "incarnation", "unique_originators", "unique_human_originators", "unique_sources", "revision", "first_seen_us", "total_observations", "last_comment", "first_dx_call"), f"select seq, incarnation, unique_originators, unique_human_originators, unique_sources, revision, first_seen_us, total_observations, last_comment, first_dx_call from ({RUNNING}) r"),
        "A09_observations": (lambda s, d: _running(s, d).select("seq", F.array_join(F.transform("observations", lambda o: o["spotter_call"]), ",").alias("calls")), f"select seq, array_to_string(list(spotter_call) over (partition by {keys}, incarnation order by seq rows between 19 preceding and current row), ',') as calls from ({INCARNATIONS}) i"),
        "W01_incarnations": (lambda s, d: _incarnations(s, d).groupBy(*observations.KEY, "incarnation").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")), f"select {keys}, incarnation, count(*) as n, min(t_us) as first_us, max(t_us) as last_us from ({INCARNATIONS}) i group by {keys}, incarnation"),
        "G02_withdrawals": (lambda s, d: windows.withdrawals(_incarnations(s, d)).drop("incarnation"), f"select {keys}, last_seen_us, revision, at_us from (select {keys}, incarnation, max(t_us) as last_seen_us, count(*) as revision, (max(t_us) + 901000000 + 9999999) // 10000000 * 10000000 as at_us from ({INCARNATIONS}) i group by {keys}, incarnation) w where at_us <= (select max(t_us) from ({OBS}) o)"),
        "G08_new_events": (lambda s, d: _new(s, d).select("seq", *observations.KEY), f"select seq, {keys} from ({NEW}) n"),
        "G10_changelog_new": (lambda s, d: _events(_quiet())(s, d).where("kind = 'New'").select("seq", "at_us", *observations.KEY, "freq_hz"), f"select seq, t_us as at_us, {keys}, freq_hz from ({NEW}) n"),
        "G10_changelog": (_events(_quiet()), _QUIET),
        "G09_cooldown": (_events(_busy()), _BUSY),
        "G08_serial": (_capped(_busy()), _BUSY),
        "A12_event_counts": (lambda s, d: windows.event_counts(_events(_busy())(s, d)), f"select kind, count(*) as n from ({_BUSY}) e group by kind"),
        "S13_live_view": (_live, f"select {keys}, x.kind as kind, x.freq_hz as freq_hz, x.last_seen_us as last_seen_us, x.revision as revision from (select {keys}, arg_max({{'kind': kind, 'freq_hz': freq_hz, 'last_seen_us': last_seen_us, 'revision': revision}}, at_us * 4 + case when seq is null then 0 when kind = 'Withdraw' then 2 else 3 end) as x, max(max(at_us)) over () as now_us from ({_BUSY}) e group by {keys}) y where x.kind <> 'Withdraw' and x.last_seen_us >= now_us - 300000000"),
        "K02_newest": (lambda s, d: windows.newest(entry(s, d), 50).select(*observations.KEY, "last_seen_us"), f"select {keys}, max(t_us) as last_seen_us from ({KEYED}) k group by {keys} order by last_seen_us desc, {keys} limit 50"),
        "K05_page": (lambda s, d: windows.page(entry(s, d).withColumn("freq_hz", F.col("freq_bucket_hz")), 20, 30).select(*observations.KEY, "n"), f"select {keys}, count(*) as n from ({KEYED}) k group by {keys} order by freq_bucket_hz, {keys} limit 30 offset 20"),
        "K06_recent": (lambda s, d: windows.recent(_new(s, d).withColumn("event_no", F.col("seq"))).select("seq", *observations.KEY), f"select seq, {keys} from ({NEW}) n order by seq desc limit 500"),
        "F00_default_rules": (_reasons(FilterConfig()), f"select 'Allow' as decision, count(*) as n from ({KEYED}) k"),
    }
    for name, (rules, sql) in RULES.items():
        out[f"{name}_rule"] = (_reasons(rules), f"select decision, count(*) as n from (select coalesce({sql}, 'Allow') as decision from ({KEYED}) k) x group by decision")
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in table().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in table().items() if sql}
