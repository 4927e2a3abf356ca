"""Settings as frozen dataclasses: JSON in and out with defaults for what is missing, checked when compiled."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any, get_args, get_origin, get_type_hints

#: The closed domains, in their order.
BAND = ("B160", "B80", "B60", "B40", "B30", "B20", "B17", "B15", "B12", "B10", "B6", "B2", "Unknown")
MODE = ("CW", "SSB", "DIG", "AM", "FM", "Unknown")
CONTINENT = ("AF", "AN", "AS", "EU", "NA", "OC", "SA", "Unknown")
KIND = ("Human", "Skimmer", "Unknown")
TAG = ("Valid", "Busted", "Qsy", "Unknown")
EVENT = ("New", "Update", "Withdraw")
POLICY = ("Neutral", "FailClosed", "FailOpen")
TRISTATE = ("Any", "RequireTrue", "RequireFalse")
DROP_REASONS = (
    "TooOld", "FreqOutOfRange", "BandDenied", "ModeDenied", "FreqDenied", "FreqNotAllowed", "ProfileNoMatch", "DxCallDenied", "DxCallNotAllowed",
    "OriginatorKindDenied", "SpotterDenied", "SpotterNotAllowed", "SplitQsySuppressed", "CqRequired", "CommentDenied", "CommentNotAllowed",
    "CorrelationNotMet", "SkimmerMetricNotMet", "GeoNotMet", "EnrichmentNotMet", "UnknownFieldFailed",
)


class ConfigError(ValueError):
    """Settings that cannot be compiled."""


@dataclass(frozen=True)
class Patterns:
    globs: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    case_insensitive: bool = False


@dataclass(frozen=True)
class Normalization:
    uppercase: bool = True
    portable_policy: str = "KeepAsIs"
    strip_non_alnum: bool = False


@dataclass(frozen=True)
class Callsigns:
    allow: Patterns = Patterns()
    deny: Patterns = Patterns()
    normalization: Normalization = Normalization()


@dataclass(frozen=True)
class Profile:
    name: str = ""
    ranges_hz: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class Rf:
    band_allow: tuple[str, ...] = ()
    band_deny: tuple[str, ...] = ()
    mode_allow: tuple[str, ...] = ()
    mode_deny: tuple[str, ...] = ()
    freq_allow_hz: tuple[tuple[int, int], ...] = ()
    freq_deny_hz: tuple[tuple[int, int], ...] = ()
    profiles: tuple[Profile, ...] = ()
    mode_policy: str = "PreferUpstreamFallbackInfer"


@dataclass(frozen=True)
class Spotters:
    callsign: Callsigns = Callsigns()
    source_allow: tuple[str, ...] = ()
    source_deny: tuple[str, ...] = ()
    allow_human: bool = True
    allow_skimmer: bool = True
    allow_unknown_kind: bool = True


@dataclass(frozen=True)
class Content:
    comment_allow: Patterns = Patterns()
    comment_deny: Patterns = Patterns()
    cq_only: bool = False
    suppress_split_qsy: bool = False
    require_comment_when_allowlist_present: bool = True


@dataclass(frozen=True)
class Correlation:
    min_unique_originators: int = 1
    originators_human_only: bool = False
    min_unique_sources: int = 1
    min_observations: int = 1
    window_secs: int = 180
    min_repeats_same_key: int = 1


@dataclass(frozen=True)
class SkimmerMetrics:
    snr_db: tuple[int, int] | None = None
    wpm: tuple[int, int] | None = None
    drop_dupes: bool = False
    require_cq: bool = False


@dataclass(frozen=True)
class EntityRules:
    continent_allow: tuple[str, ...] = ()
    continent_deny: tuple[str, ...] = ()
    cq_zone_allow: tuple[int, ...] = ()
    cq_zone_deny: tuple[int, ...] = ()
    itu_zone_allow: tuple[int, ...] = ()
    itu_zone_deny: tuple[int, ...] = ()
    entity_allow: tuple[str, ...] = ()
    entity_deny: tuple[str, ...] = ()
    country_allow: tuple[str, ...] = ()
    country_deny: tuple[str, ...] = ()
    state_allow: tuple[str, ...] = ()
    state_deny: tuple[str, ...] = ()
    grid_allow: Patterns = Patterns()
    grid_deny: Patterns = Patterns()

    def any(self) -> bool:
        return self != EntityRules()


@dataclass(frozen=True)
class Geo:
    dx: EntityRules = EntityRules()
    spotter: EntityRules = EntityRules()
    require_resolvers: bool = False


@dataclass(frozen=True)
class Membership:
    rule: str = "Require"
    tag: str = ""


@dataclass(frozen=True)
class Enrichment:
    lotw: str = "Any"
    in_master_db: str = "Any"
    in_callbook: str = "Any"
    membership: tuple[Membership, ...] = ()


@dataclass(frozen=True)
class FilterConfig:
    max_age_secs: int = 900
    freq_sanity_hz: tuple[int, int] | None = (1_800_000, 54_000_000)
    unknown_policy: str = "Neutral"
    rf: Rf = Rf()
    dx: Callsigns = Callsigns()
    spotter: Spotters = Spotters()
    content: Content = Content()
    correlation: Correlation = Correlation()
    skimmer: SkimmerMetrics = SkimmerMetrics()
    geo: Geo = Geo()
    enrichment: Enrichment = Enrichment()

    def compiled(self) -> FilterConfig:
        """Checked: no zero age, no reversed frequency range, minima of 1 at least, reversed metric ranges put right, patterns valid."""
        from .patterns import compile_set

        if self.max_age_secs <= 0:
            raise ConfigError("max_age_secs must not be 0")
        ranges = [*self.rf.freq_allow_hz, *self.rf.freq_deny_hz, *[r for p in self.rf.profiles for r in p.ranges_hz], *([self.freq_sanity_hz] if self.freq_sanity_hz else [])]
        for lo, hi in ranges:
            if lo > hi:
                raise ConfigError(f"frequency range is reversed: {lo} > {hi}")
        for s in (self.dx.allow, self.dx.deny, self.spotter.callsign.allow, self.spotter.callsign.deny, self.content.comment_allow, self.content.comment_deny, *[x for e in (self.geo.dx, self.geo.spotter) for x in (e.grid_allow, e.grid_deny)]):
            compile_set(s)
        c = self.correlation
        up = {f.name: max(1, getattr(c, f.name)) for f in dataclasses.fields(c) if f.name.startswith("min_")}
        order = lambda r: r and (min(r), max(r))
        return dataclasses.replace(self, correlation=dataclasses.replace(c, **up), skimmer=dataclasses.replace(self.skimmer, snr_db=order(self.skimmer.snr_db), wpm=order(self.skimmer.wpm)))


@dataclass(frozen=True)
class Buckets:
    cw_hz: int = 200
    ssb_hz: int = 1000
    dig_hz: int = 100


@dataclass(frozen=True)
class Dedupe:
    emit_updates: bool = False
    min_update_interval_us: int | None = None
    detect_qsy: bool = True
    qsy_coalesce_us: int | None = 200_000


@dataclass(frozen=True)
class SkimmerQuality:
    """Corroboration by other skimmers; times in whole seconds."""

    enabled: bool = True
    required_distinct_skimmers: int = 3
    freq_window_hz: int = 300
    lookback_secs: int = 180
    compute_valid: bool = True
    compute_busted: bool = True
    busted_freq_hz: int = 100
    busted_max_edit: int = 1
    compute_qsy: bool = True
    qsy_freq_hz: int = 400
    max_tracked: int = 100_000
    gate: bool = True
    allow: tuple[str, ...] = ("Valid",)
    apply_only_to_skimmer: bool = True


@dataclass(frozen=True)
class AggregatorConfig:
    normalization: Normalization = Normalization()
    mode_policy: str = "PreferUpstreamFallbackInfer"
    buckets: Buckets = Buckets()
    dedupe: Dedupe = Dedupe()
    spot_ttl_secs: int = 900
    max_observations: int = 20
    max_spots: int = 50_000
    tick_secs: int = 10
    skimmer: SkimmerQuality | None = None


def _build(kind: Any, value: Any) -> Any:
    if dataclasses.is_dataclass(kind):
        if kind is Membership and isinstance(value, dict) and len(value) == 1:
            (rule, tag), = value.items()
            return Membership(rule, tag)
        known = get_type_hints(kind)
        return kind(**{k: _build(known[k], v) for k, v in value.items() if k in known})
    if value is None:
        return None
    if get_origin(kind) is tuple:
        inner = get_args(kind)[0]
        return tuple(_build(inner, v) for v in value)
    options = [k for k in get_args(kind) if k is not type(None)]
    return _build(options[0], value) if options else value


def from_json(text: str, kind: type = FilterConfig) -> Any:
    """Missing sections and fields take their defaults; unknown ones are left out."""
    try:
        return _build(kind, json.loads(text))
    except (TypeError, AttributeError, ValueError) as e:
        raise ConfigError(str(e)) from e


def _plain(x: Any) -> Any:
    if isinstance(x, Membership):
        return {x.rule: x.tag}
    if dataclasses.is_dataclass(x):
        return {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    return [_plain(v) for v in x] if isinstance(x, tuple) else x


def to_json(config: Any) -> str:
    return json.dumps(_plain(config), indent=2)


def replace(config: Any, **changes: Any) -> Any:
    """A setter on frozen settings; `section__field` reaches inside."""
    for path, value in changes.items():
        head, _, rest = path.partition("__")
        config = dataclasses.replace(config, **{head: replace(getattr(config, head), **{rest: value}) if rest else value})
    return config


