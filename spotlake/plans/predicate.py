"""The rule pipeline as one column: the first reason to drop a row, or null.

Only active rules make a branch.  Unknown fields follow the policy, which is settled while compiling; every comparison is made
safe against nulls.  Lists compile to literals.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import Correlation, EntityRules, FilterConfig
from .patterns import compile_set, matches

SPLIT = "(?Ui)\\b(UP|QSX|SPLIT|QSY)\\b"
CQ = "(?Ui)\\bCQ\\b"

def unknown_drops(policy: str, allowlist: bool) -> bool:
    """Whether a missing field drops the row, for a rule that lets only some values in or keeps some out."""
    return policy == "FailClosed" or (policy == "Neutral" and allowlist)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in_ranges(c: Column, ranges) -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | c.between(lo, hi)
    return _yes(out)


def entity_drop(geo: Column, rules: EntityRules, policy: str) -> Column:
    """The reason of the first field that fails, in order: missing where the policy drops it, denied, not allowed."""
    branches = []
    for name in ("continent", "cq_zone", "itu_zone", "entity", "country", "state", "grid"):
        allow, deny, c = getattr(rules, f"{name}_allow"), getattr(rules, f"{name}_deny"), geo[name]
        if name == "grid":
            has_allow, has_deny = (compile_set(x) is not None for x in (allow, deny))
            hit_allow, hit_deny = matches(c, allow), matches(c, deny)
        else:
            has_allow, has_deny = bool(allow), bool(deny)
            hit_allow, hit_deny = _yes(c.isin(*allow)) if allow else F.lit(False), _yes(c.isin(*deny)) if deny else F.lit(False)
        if not (has_allow or has_deny):
            continue
        if unknown_drops(policy, has_allow):
            branches.append(F.when(c.isNull(), "UnknownFieldFailed"))
        if has_deny:
            branches.append(F.when(c.isNotNull() & hit_deny, "GeoNotMet"))
        if has_allow:
            branches.append(F.when(c.isNotNull() & ~hit_allow, "GeoNotMet"))
    return F.coalesce(*branches) if branches else F.lit(None).cast("string")


def _tristate(c: Column, want: str, policy: str) -> Column | None:
    if want == "Any":
        return None
    return F.when(c.isNull() & F.lit(unknown_drops(policy, True)), "UnknownFieldFailed").when(c.isNotNull() & (c != F.lit(want == "RequireTrue")), "EnrichmentNotMet")


def correlation_drop(c: Correlation) -> Column:
    who = F.col("unique_human_originators" if c.originators_human_only else "unique_originators")
    short = (who < c.min_unique_originators) | (F.col("unique_sources") < c.min_unique_sources) | (F.col("total_observations") < c.min_observations) | (F.col("repeats") < c.min_repeats_same_key)
    return F.when(_yes(short), "CorrelationNotMet")


class Verdict(NamedTuple):
    """What the rules on a comment say of one text: whether it may pass, and whether it calls CQ."""

    ok: Column
    cq: Column


def _content(cfg: FilterConfig, text: Column, called: Column) -> list[Column]:
    """The content stage for a comment that is not null; `called` is whether the row or the text calls CQ."""
    out, c = [], cfg.content
    if c.suppress_split_qsy:
        out.append(F.when(text.rlike(SPLIT), "SplitQsySuppressed"))
    if c.cq_only:
        out.append(F.when(~called, "CqRequired"))
    if compile_set(c.comment_deny):
        out.append(F.when(matches(text, c.comment_deny), "CommentDenied"))
    if compile_set(c.comment_allow):
        missing = (text == "") if c.require_comment_when_allowlist_present else F.lit(False)
        out.append(F.when(missing | ~matches(text, c.comment_allow), "CommentNotAllowed"))
    return out


def comment_verdict(config: FilterConfig, comment: str = "comment") -> Verdict:
    """The content stage of a comment, apart from the row's own CQ mark: the state machine keeps it beside a spot's last comment."""
    cfg, text = config.compiled(), F.coalesce(F.col(comment), F.lit(""))
    reasons = _content(cfg, text, F.lit(True))
    return Verdict(F.coalesce(*reasons).isNull() if reasons else F.lit(True), text.rlike(CQ) if cfg.content.cq_only else F.lit(True))


def drop_reason(config: FilterConfig, correlation: bool = True, content: bool = True) -> Column:
    """The reason column over a view (`observations.view`); without `correlation` and `content` the stages that need a spot's running
    counts and comment are left to the caller."""
    cfg, out = config.compiled(), []
    policy, col = cfg.unknown_policy, F.col
    closed = policy == "FailClosed"

    def drop(when: Column, reason: str) -> None:
        out.append(F.when(_yes(when), reason))

    drop(col("now_us") - col("last_seen_us") > cfg.max_age_secs * 1_000_000, "TooOld")
    if cfg.freq_sanity_hz:
        drop(~col("freq_hz").between(*cfg.freq_sanity_hz), "FreqOutOfRange")
    for name, reason in (("band", "BandDenied"), ("mode", "ModeDenied")):
        allow, deny = getattr(cfg.rf, f"{name}_allow"), getattr(cfg.rf, f"{name}_deny")
        if deny:
            drop(col(name).isin(*deny), reason)
        if allow:
            drop(~col(name).isin(*allow), reason)
    if cfg.rf.freq_deny_hz:
        drop(_in_ranges(col("freq_hz"), cfg.rf.freq_deny_hz), "FreqDenied")
    if cfg.rf.freq_allow_hz:
        drop(~_in_ranges(col("freq_hz"), cfg.rf.freq_allow_hz), "FreqNotAllowed")
    if cfg.rf.profiles:
        drop(~_in_ranges(col("freq_hz"), [r for p in cfg.rf.profiles for r in p.ranges_hz]), "ProfileNoMatch")
    if compile_set(cfg.dx.deny):
        drop(matches(col("dx_call_norm"), cfg.dx.deny), "DxCallDenied")
    if compile_set(cfg.dx.allow):
        drop(~matches(col("dx_call_norm"), cfg.dx.allow), "DxCallNotAllowed")
    s = cfg.spotter
    kinds = [k for k, ok in (("Human", s.allow_human), ("Skimmer", s.allow_skimmer), ("Unknown", s.allow_unknown_kind)) if not ok]
    if kinds:
        drop(col("originator_kind").isin(*kinds), "OriginatorKindDenied")
    for c, deny, allow in (
        (col("source_id"), s.source_deny and _yes(col("source_id").isin(*s.source_deny)), s.source_allow and _yes(col("source_id").isin(*s.source_allow))),
        (col("spotter_call_norm"), compile_set(s.callsign.deny) and matches(col("spotter_call_norm"), s.callsign.deny), compile_set(s.callsign.allow) and matches(col("spotter_call_norm"), s.callsign.allow)),
    ):
        has_deny, has_allow = (not isinstance(x, (tuple, type(None))) for x in (deny, allow))
        if has_deny:
            drop(c.isNotNull() & deny, "SpotterDenied")
        if has_allow:
            drop(c.isNotNull() & ~allow, "SpotterNotAllowed")
        if closed and (has_deny or has_allow):
            drop(c.isNull(), "UnknownFieldFailed")
    text = F.coalesce(col("comment"), F.lit(""))
    if content:
        out += _content(cfg, text, _yes(col("is_skimmer_cq")) | text.rlike(CQ))
    if correlation:
        out.append(correlation_drop(cfg.correlation))
    m = cfg.skimmer
    skimmer = col("originator_kind") == "Skimmer"
    if m.drop_dupes:
        drop(skimmer & _yes(col("is_skimmer_dupe")), "SkimmerMetricNotMet")
    if m.require_cq:
        drop(skimmer & ~_yes(col("is_skimmer_cq")), "SkimmerMetricNotMet")
    for name, r in (("snr_db", m.snr_db), ("wpm", m.wpm)):
        if r:
            drop(skimmer & ~col(name).between(*r), "SkimmerMetricNotMet")
        if r and closed:
            drop(skimmer & col(name).isNull(), "UnknownFieldFailed")
    out += _geo(cfg)
    for name in ("lotw", "in_master_db", "in_callbook"):
        if (t := _tristate(col(name), getattr(cfg.enrichment, name), policy)) is not None:
            out.append(t)
    if cfg.enrichment.membership:
        drop(col("memberships").isNull() & F.lit(unknown_drops(policy, True)), "UnknownFieldFailed")
        for rule in cfg.enrichment.membership:
            has = _yes(F.array_contains("memberships", rule.tag))
            drop(col("memberships").isNotNull() & (~has if rule.rule == "Require" else has), "EnrichmentNotMet")
    return F.coalesce(*out)


def _geo(cfg: FilterConfig) -> list[Column]:
    """The geo stage.  A required but missing resolution settles the stage at once, either way."""
    g, policy = cfg.geo, cfg.unknown_policy
    if not (g.require_resolvers or g.dx.any() or g.spotter.any()):
        return []
    rules = F.coalesce(entity_drop(F.col("dx_geo"), g.dx, policy), entity_drop(F.col("spotter_geo"), g.spotter, policy))
    if not g.require_resolvers:
        return [rules]
    lost = F.col("dx_geo")["entity"].isNull() & F.col("dx_geo")["country"].isNull()
    verdict = F.lit("UnknownFieldFailed") if unknown_drops(policy, True) else F.lit(None).cast("string")
    return [F.when(lost, verdict).otherwise(rules)]
