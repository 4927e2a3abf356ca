"""Lookups: entities by longest prefix, enrichment by call."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import CONTINENT, ConfigError

ENTITY = "key string, exact boolean, entity string, continent string, cq_zone int, itu_zone int, lat double, lon double, primary_prefix string"


def _records(text: str) -> list[tuple[str, str]]:
    """(header, prefixes) of a country file: a header begins its line, indented lines go on; blank lines and those that begin with # do not count."""
    out: list[list[str]] = []
    for line in text.splitlines():
        words = line.strip()
        if not words or words.startswith("#"):
            continue
        if line[0] in " \t":
            if out:
                out[-1].append(words)
        else:
            out.append([words])
    return [(r[0], " ".join(r[1:])) for r in out]


def parse_entities(text: str) -> list[tuple]:
    """Rows of `ENTITY` from the country file.  The first of equal keys counts."""
    out: dict[tuple[str, bool], tuple] = {}
    for header, prefixes in _records(text):
        name, colon, rest = header.partition(":")
        fields = rest.split()
        if not colon or len(fields) < 7:
            raise ConfigError(f"invalid header: {header}")
        try:
            cq, itu, lat, lon = int(fields[0]), int(fields[1]), float(fields[3]), float(fields[4])
        except ValueError as e:
            raise ConfigError(f"invalid header: {header}") from e
        if not (0 <= cq < 256 and 0 <= itu < 256):
            raise ConfigError(f"invalid header: {header}")
        if fields[2] not in CONTINENT[:-1]:
            raise ConfigError(f"unknown continent: {fields[2]}")
        prefix = fields[-1].rstrip(":")
        about = (name.strip().lstrip("*"), fields[2])
        out.setdefault((prefix.upper(), False), (*about, cq, itu, lat, lon, prefix))
        for raw in prefixes.split(","):
            raw = raw.strip().rstrip(";")
            exact = raw.startswith("=")
            raw = raw[exact:].split("~")[0]
            zones = {"(": cq, "[": itu}
            for mark, pattern in (("(", r"\(([^)]*)\)"), ("[", r"\[([^\]]*)\]")):
                found = re.findall(pattern, raw)
                if found and found[-1].isdigit() and int(found[-1]) < 256:
                    zones[mark] = int(found[-1])
            key = re.sub(r"\([^)]*\)|\[[^\]]*\]|<[^>]*>|\{[^}]*\}", "", raw).upper()
            if key:
                out.setdefault((key, exact), (*about, zones["("], zones["["], lat, lon, prefix))
    return [(k, exact, *v) for (k, exact), v in out.items()]


def counts(text: str) -> tuple[int, int]:
    """(entities, prefixes) of a country file; exact calls are not prefixes."""
    return len(_records(text)), sum(not exact for _, exact, *_ in parse_entities(text))


def entity_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_entities(text), ENTITY)


def resolve(calls: DataFrame, entities: DataFrame, call: str) -> DataFrame:
    """(call, entity columns) of every distinct call that resolves: an exact entry, else the longest prefix.

    A call becomes its prefixes, which meet the table by an equi-join, and the longest stays.
    """
    one = calls.select(F.col(call).alias("_call")).where("_call is not null").distinct()
    up = F.upper("_call")
    tries = one.select("_call", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_call"), F.lit(1)))).alias("n")).select("_call", "n", F.substring(up, F.lit(1), F.col("n")).alias("key"), (F.col("n") == F.length("_call")).alias("whole"))
    met = tries.join(entities, "key").where(F.col("whole") | ~F.col("exact"))
    cols = ["entity", "continent", "cq_zone", "itu_zone", "lat", "lon", "primary_prefix"]
    best = met.groupBy("_call").agg(F.max_by(F.struct(*cols), F.struct("exact", "n")).alias("e"))
    return best.select(F.col("_call").alias(call), *[f"e.{c}" for c in cols])


def with_geo(rows: DataFrame, entities: DataFrame, call: str, out: str) -> DataFrame:
    """rows with the struct `out`, null where the call does not resolve."""
    found = resolve(rows, entities, call)
    geo: Column = F.struct("continent", "cq_zone", "itu_zone", "entity", F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("grid"))
    return rows.join(found.select(call, geo.alias(out)), call, "left")


def enrich(rows: DataFrame, table: DataFrame | None, call: str = "dx_call_norm") -> DataFrame:
    """rows with lotw, in_master_db, in_callbook and memberships from table(call, ...); without a table all are null."""
    kinds = {"lotw": "boolean", "in_master_db": "boolean", "in_callbook": "boolean", "memberships": "array<string>"}
    if table is None:
        return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    one = table.groupBy(F.col("call").alias(call)).agg(*[F.any_value(c).alias(c) for c in kinds])
    return rows.join(one, call, "left")
