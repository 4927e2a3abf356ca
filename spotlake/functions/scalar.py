"""Frequencies, modes, callsigns: pure Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges in Hz, inclusive.
BANDS = {
    "B160": (1_800_000, 2_000_000), "B80": (3_500_000, 4_000_000), "B60": (5_250_000, 5_450_000), "B40": (7_000_000, 7_300_000),
    "B30": (10_100_000, 10_150_000), "B20": (14_000_000, 14_350_000), "B17": (18_068_000, 18_168_000), "B15": (21_000_000, 21_450_000),
    "B12": (24_890_000, 24_990_000), "B10": (28_000_000, 29_700_000), "B6": (50_000_000, 54_000_000), "B2": (144_000_000, 148_000_000),
}
# The mode usual up to each frequency (Hz, inclusive) of a band.
MODES = {
    "B160": ((1_840_000, "CW"), (2_000_000, "SSB")), "B80": ((3_600_000, "CW"), (4_000_000, "SSB")), "B60": ((5_450_000, "DIG"),),
    "B40": ((7_125_000, "CW"), (7_300_000, "SSB")), "B30": ((10_140_000, "CW"), (10_150_000, "DIG")),
    "B20": ((14_100_000, "CW"), (14_112_000, "DIG"), (14_350_000, "SSB")), "B17": ((18_110_000, "CW"), (18_168_000, "SSB")),
    "B15": ((21_200_000, "CW"), (21_450_000, "SSB")), "B12": ((24_930_000, "CW"), (24_990_000, "SSB")), "B10": ((28_300_000, "CW"), (29_700_000, "SSB")),
    "B6": ((50_100_000, "CW"), (50_300_000, "SSB"), (50_400_000, "DIG"), (54_000_000, "SSB")),
    "B2": ((144_150_000, "CW"), (144_400_000, "SSB"), (148_000_000, "DIG")),
}
# Mode names in skimmer comments.
VOICE = {"CW": "CW", "SSB": "SSB", "LSB": "SSB", "USB": "SSB", "AM": "AM", "FM": "FM"}
DIGITAL = ("RTTY", "FT8", "FT4", "JT65", "JT9", "MFSK", "OLIVIA", "DOMINO", "MSK144", "FST4", "FST4W", "Q65", "THROB", "HELL", "ROS", "CONTESTI", "JS8", "WSPR")
# Suffixes of portable stations.
PORTABLE = ("P", "M", "QRP", "MM", "AM")
_A, _Z = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper_ascii(c: Column) -> Column:
    return F.translate(c, _A, _Z)


def freq_to_band(f: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for band, (lo, hi) in BANDS.items():
        out = out.when(f.between(lo, hi), band)
    return out.otherwise("Unknown")


def band_edges(band: Column) -> Column:
    """struct<lo, hi> in Hz, null for unknown bands."""
    out = F.when(F.lit(False), F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")))
    for name, (lo, hi) in BANDS.items():
        out = out.when(band == name, F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")))
    return out


def freq_to_mode(f: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for band, parts in MODES.items():
        lo = BANDS[band][0]
        for hi, mode in parts:
            out = out.when(f.between(lo, hi), mode)
            lo = hi + 1
    return out.otherwise("Unknown")


def resolve_mode(f: Column, upstream: Column, policy: str = "PreferUpstreamFallbackInfer") -> Column:
    if policy == "TrustUpstream":
        return F.coalesce(upstream, F.lit("Unknown"))
    if policy == "InferFromFrequency":
        return freq_to_mode(f)
    return F.coalesce(F.nullif(upstream, F.lit("Unknown")), freq_to_mode(f))


def freq_bucket(f: Column, mode: Column, cw: int = 200, ssb: int = 1000, dig: int = 100) -> Column:
    """f cut down to its mode's bucket; a bucket of 0 leaves f as it is."""

    def at(width: int) -> Column:
        return (f - F.pmod(f, F.lit(width))).cast("long") if width else f.cast("long")

    return F.when(mode == "CW", at(cw)).when(mode == "DIG", at(dig)).otherwise(at(ssb))


def strip_portable(call: Column, policy: str) -> Column:
    if policy == "StripCommonSuffixes":
        return F.regexp_replace(call, f"(?i)/({'|'.join(PORTABLE)})$", "")
    if policy == "StripAllAfterSlash":
        return F.regexp_replace(call, "/[^/]*$", "")
    return call


def normalize_callsign(call: Column, uppercase: bool = True, strip_non_alnum: bool = False, portable_policy: str = "KeepAsIs") -> Column:
    out = upper_ascii(call) if uppercase else call
    if strip_non_alnum:
        out = F.regexp_replace(out, "[^A-Za-z0-9/]", "")
    return strip_portable(out, portable_policy)


def base_callsign(call: Column) -> Column:
    """The longest part between slashes that has a digit, the last of equals; the call itself if none has."""
    parts = F.filter(F.split(call, "/"), lambda p: p.rlike("[0-9]"))
    best = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.octet_length(p) >= F.octet_length(a), p).otherwise(a))
    return F.when(F.instr(call, "/") == 0, call).when(F.size(parts) == 0, call).otherwise(best)


def is_likely_skimmer(call: Column) -> Column:
    return call.rlike("-(#|[0-9]{1,2})$")


def mode_token(t: Column) -> Column:
    u = upper_ascii(t)
    out = F.when(F.octet_length(t) > 16, F.lit(None).cast("string"))
    for name, mode in VOICE.items():
        out = out.when(u == name, mode)
    return out.when(u.isin(*DIGITAL) | u.startswith("PSK"), "DIG")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; -1 beyond `most`.  Counts characters (calls are ASCII)."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def whole_seconds(later_us: Column, earlier_us: Column) -> Column:
    """Age in whole seconds, cut towards zero."""
    gap = later_us - earlier_us
    return ((gap - gap % F.lit(1_000_000)) / F.lit(1_000_000)).cast("long")


def saturate(n: Column) -> Column:
    return F.least(n, F.lit(255)).cast("int")
