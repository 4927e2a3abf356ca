"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A cluster is a tree region -> rack -> shard; a node weighs what its shards weigh.  A row descends from the root: at each
node every child draws -ln(u) / weight, u hashed from the row's key and the child's name, and the least draw wins.  A
child is then chosen in proportion to its weight, and a child whose weight changes wins or loses rows only against its
own siblings: rows move into or out of the subtree whose weight changed and nowhere else.  `grow` hangs a new shard in
a region of its own, so the other subtrees keep their weights and rows move only into the new shard.

Defined cases: a null key is one key like any other; a null text has size 1 and checksum 0; equal rows get different slots
in either order; a text counts whole, however long; an empty table gives no rows; columns other than the key and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table

#: Slots are numbered within this many buckets of each shard, so no task sorts a whole shard.
BUCKETS = 512


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, each: int = 2) -> list[Shard]:
    """`shards` equal shards, `each` to a rack and `racks` to a region."""
    return [Shard(f"g{i // (racks * each)}", f"k{i // each}", i) for i in range(shards)]


def grow(cluster: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    n = max(s.number for s in cluster) + 1
    return [*cluster, Shard(f"new{n}", f"new{n}", n, weight)]


def _least(key: Column, children: dict[str, float]) -> Column:
    """The name of the child with the least draw; ties go to the smaller name."""
    names = sorted(n for n, w in children.items() if w > 0)
    if len(names) == 1:
        return F.lit(names[0])

    def draw(name: str) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
        return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(children[name]))

    return F.array_min(F.array(*[F.struct(draw(n).alias("d"), F.lit(n).alias("n")) for n in names]))["n"]


def _weights(cluster: list[Shard], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for s in cluster:
        out[name(s)] = out.get(name(s), 0.0) + s.weight
    return out


def _case(chosen: Column, options: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in options.items():
        out = F.when(chosen == name, value).otherwise(out)
    return out


def place(df: DataFrame, cluster: list[Shard], key: str, out: str) -> DataFrame:
    """df with the column `out`: the shard that `key` descends to."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))
    region, rack = f"__{out}_region", f"__{out}_rack"
    racks = {g: _weights([s for s in cluster if s.region == g], lambda s: s.rack) for g in {s.region for s in cluster}}
    # regions may give their racks the same names
    leaves = {(g, c): _weights([s for s in cluster if (s.region, s.rack) == (g, c)], lambda s: f"shard{s.number}") for g in racks for c in racks[g]}
    df = df.withColumn(region, _least(k, _weights(cluster, lambda s: s.region)))
    df = df.withColumn(rack, _case(F.col(region), {g: _least(k, racks[g]) for g in sorted(racks)}))
    leaf = _case(F.col(region), {g: _case(F.col(rack), {c: _least(k, leaves[g, c]) for c in sorted(racks[g])}) for g in sorted(racks)})
    return df.withColumn(out, F.substring(leaf, 6, 20).cast("int")).drop(region, rack)


def shard(df: DataFrame, cluster: list[Shard], grown: list[Shard] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot (gapless from 0 in each shard) and, with `grown`, grown_shard.

    Only the key, two numbers and the shard are shuffled, once; texts stay where they are read.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    rows = df.select(F.col(key).alias("__k"), size.alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = place(rows, cluster, "__k", "shard")
    # the size spreads the rows of one hot key, such as null, over the buckets
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("__k", "size"), F.lit(BUCKETS)).cast("int"))
    per = rows.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    # at most shards x BUCKETS rows, whatever the input
    before = W.partitionBy("shard").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    first = per.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(W.partitionBy("shard", "__b").orderBy("__k", "size", "text_crc32"))
    if grown:
        rows = place(rows, grown, "__k", "grown_shard")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    out = rows.withColumn("__r", rank).join(F.broadcast(first), ["shard", "__b"])
    return out.select(F.col("__k").alias(key), "size", "text_crc32", "shard", (F.col("__first") + F.col("__r") - 1).cast("long").alias("slot"), "grown_shard")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 7 under the law `key`."""
    cluster = tree(8)
    out = shard(table(spark, sf_dir, "documents"), cluster, grow(cluster))
    return out.withColumn("law", F.lit("key"))
