"""Lines of spotting nodes as columns: kind, spot, skimmer fields.  No Python runs per row and no input fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import is_likely_skimmer, mode_token

#: Unicode whitespace.
WHITE = "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# What a node asks for, and how long a line that ends in `>` may be to be a prompt.
PROMPTS = ("login:", "call:", "callsign:", "please enter your call", "password:")
PROMPT_BYTES = 30


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def _left(c: Column, n: Column) -> Column:
    return F.substring(c, F.lit(1), n)


def _from(c: Column, at: Column) -> Column:
    return F.substring(c, at, F.length(c))


def parse_freq(token: Column) -> Column:
    """kHz as text, less what is neither digit nor dot at its ends -> Hz, with whole numbers only; null if not numeric or too large."""
    s = token
    dot = F.instr(s, ".")
    whole = F.when(dot == 0, s).otherwise(_left(s, dot - 1))
    frac = F.when(dot == 0, F.lit("")).otherwise(_left(_from(s, dot + 1), F.lit(3)))
    khz = F.when((dot > 0) & (whole == ""), F.lit(0).cast("long")).when(whole.rlike("^[0-9]+$"), whole.try_cast("long"))
    digits = F.when(frac.rlike("^\\+?[0-9]+$"), frac.try_cast("long"))
    hz = F.when(frac == "", F.lit(0).cast("long")).otherwise(digits * F.element_at(F.array(F.lit(100), F.lit(10), F.lit(1)), F.greatest(F.length(frac), F.lit(1))))
    return F.try_add(F.try_multiply(khz, F.lit(1000).cast("long")), hz)


def _minute(hhmm: Column) -> Column:
    """Minute of the day of four digits, null if out of range."""
    h, m = F.substring(hhmm, 1, 2).try_cast("int"), F.substring(hhmm, 3, 2).try_cast("int")
    return F.when(hhmm.rlike("^[0-9]{4}$") & (h < 24) & (m < 60), h * 60 + m)


def comment_and_time(rest: Column) -> tuple[Column, Column]:
    """(comment, minute of the day) of what follows the call."""
    size, last5, last4 = F.octet_length(rest), F.right(rest, F.lit(5)), F.right(rest, F.lit(4))
    zulu = (size >= 5) & rest.rlike("[Zz]$")
    # a last character cut in two by the fifth byte from the end hides the time
    clear = (size == 4) | ((size >= 5) & (F.octet_length(last5) == 5))
    time = F.when(zulu, F.when(last5.rlike("^[0-9]{4}[Zz]$"), _minute(_left(last5, F.lit(4))))).when(clear & (size >= 4), _minute(last4))
    cut = F.when(time.isNull(), F.length(rest)).when(zulu, F.length(rest) - 5).otherwise(F.length(rest) - 4)
    return F.nullif(_trim(_left(rest, cut)), F.lit("")), time


def skimmer_fields(comment: Column) -> Column:
    """Signal, speed, CQ and mode of a comment's tokens; null without a comment."""
    text = F.coalesce(comment, F.lit(""))

    def last(unit: str, number: str, kind: str, lo: int, hi: int) -> Column:
        """The last number in range that stands before the unit."""
        found = F.regexp_extract_all(text, F.lit(f"(?U)(?<!\\S)({number})\\s+(?i:{unit})(?!\\S)"), F.lit(1))
        return F.try_element_at(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.between(lo, hi)), F.lit(-1)).cast(kind)

    snr, wpm = last("db", "[+-]?[0-9]+", "tinyint", -128, 127), last("wpm", "[+]?[0-9]+", "int", 0, 65535)
    cq, mode = text.rlike("(?U)(?<!\\S)(?i:cq)(?!\\S)"), mode_token(F.regexp_extract(text, "(?U)^\\s*(\\S+)", 1))
    return F.when(comment.isNotNull(), F.struct(snr.alias("snr_db"), wpm.alias("wpm"), cq.alias("is_cq"), mode.alias("mode")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once: a one-row generator keeps the optimizer from pasting them into every later use,
    which would outgrow what can be compiled."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    df = df.withColumn("_made", F.explode(F.array(made)))
    return df.select(*[c for c in df.columns if c != "_made"], *[F.col(f"_made.{n}").alias(n) for n in columns])


def parse_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """df with kind (Spot, Announce, Propagation, Prompt, Unknown), text, and the spot's columns, null for other kinds.

    What later parts share is worked out once; the rest are plain columns, which are not computed where nobody asks for them.
    """
    df = df.withColumn("text", F.coalesce(F.rtrim(F.col(value), F.lit(WHITE)), F.lit("")))
    after = _from(F.col("text"), F.lit(7))
    colon = F.instr(after, ":")
    is_dx = (F.lower(F.substring("text", 1, 6)) == "dx de ") & (F.octet_length(F.substring("text", 1, 6)) == 6) & (colon > 1)
    df = _once(df, _spotter=F.when(is_dx, _trim(_left(after, colon - 1))), _rest=F.when(is_dx, F.ltrim(_from(after, colon + 1), F.lit(WHITE))))
    number = F.regexp_replace(F.regexp_extract("_rest", "(?U)^(\\S+)", 1), "^[^0-9.]+|[^0-9.]+$", "")
    df = _once(df, _number=number, _dx=F.regexp_extract("_rest", "(?U)^\\S+\\s+(\\S+)", 1))
    df = _once(df, _hz=parse_freq(F.col("_number")))
    spot = F.coalesce((F.col("_spotter") != "") & F.col("_hz").isNotNull() & (F.col("_dx") != ""), F.lit(False))
    # the comment begins behind the first place where the call's text stands, be it inside the frequency
    tail = _trim(_from(F.col("_rest"), F.instr(F.col("_rest"), F.col("_dx")) + F.length("_dx")))
    df = _once(df, _spot=spot, _tail=F.when(spot, tail))
    comment, minute = comment_and_time(F.col("_tail"))
    df = _once(df, comment=comment, utc_minute=minute)
    low, text = F.lower("text"), F.col("text")
    prompt = text.endswith(">") & (F.octet_length(text) < PROMPT_BYTES)
    for cue in PROMPTS:
        prompt = prompt | F.contains(low, F.lit(cue))
    kind = (
        F.when(F.col("_spot"), "Spot")
        .when(text.startswith("To ") & F.contains(_from(text, F.lit(4)), F.lit(" de ")), "Announce")
        .when(text.startswith("WWV de ") | text.startswith("WCY de "), "Propagation")
        .when(prompt, "Prompt")
        .otherwise("Unknown")
    )
    pick = lambda c: F.when(F.col("_spot"), F.col(c))
    df = df.withColumns({"kind": kind, "spotter_call": pick("_spotter"), "dx_call": pick("_dx"), "freq_hz": pick("_hz"), "skimmer_fields": skimmer_fields(F.col("comment"))})
    return df.drop("_spotter", "_rest", "_number", "_hz", "_dx", "_spot", "_tail")


def originator(spotter: Column, policy: Column) -> Column:
    """Skimmer or Human: by the source's policy, or by the raw call."""
    return F.when(policy == "AllSkimmer", "Skimmer").when(policy == "AllHuman", "Human").otherwise(F.when(is_likely_skimmer(spotter), "Skimmer").otherwise("Human"))
