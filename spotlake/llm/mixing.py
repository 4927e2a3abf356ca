"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1.  Of all rates up to MOST whose token sums meet each source's target, those closest to the start in
relative entropy, sum(rate * log(rate) - rate), are exponentially tilted by the document's tokens: rate = min(MOST, exp(lambda[source] * tokens)),
tokens counted in units of the source's mean.  lambda minimises the convex dual, whose gradient is sum(tokens * rate) - target and whose Hessian,
sum(tokens^2 * rate) over the rates below MOST, is diagonal, as a document has one source.  Newton's iteration is distributed: each step
is one pass over the size classes of all documents (a class is a source and a size), and a step that leaves the bracket of the root halves it instead.
A target of MOST times the size, which a finite lambda does not reach, sets all rates to MOST.

Rates become whole copies by carrying the remainder through each source's size classes, from long documents to short ones, so
a source misses its target by about its shortest document at most.  Within a class the documents that get one copy more
are the first by hash.

Defined cases: a null source is a source, ordered last; a null or blank text has size 0 and is taken 0 times; a text counts whole, however long; a null id is
ordered before others; equal rows may differ by one copy; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: A document is taken this many times at most, and so a source's target is this many times its size at most.
MOST = 2
#: Rows of one hash bucket of a size class; ranks are taken bucket by bucket.
BUCKET_ROWS = 50_000
#: Newton stops once every source's tokens are this near their target, or after so many steps (halving alone would need some 50).
NEAR = 1e-7
NEWTON_STEPS = 100


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _named(source: Column) -> Column:
    """The source as a key that is never null: windows and joins on it agree on one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(totals: DataFrame, weights: Sequence[float], share: float, most: float = MOST) -> DataFrame:
    """totals(source, source_size) with each source's weight and target.

    A target is min(most * size, weight * level); the level rises, round by round, as capped sources leave an excess.
    Each round is one sum over the table of sources.
    """
    position = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(position, F.lit(len(weights))) + 1)
    totals = cut(totals.withColumn("weight", pick))
    full, level, capped = F.col("source_size") * most, 0.0, -1
    while True:
        over = full < F.col("weight") * level
        s = totals.agg(F.sum("source_size"), F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("int"))).first()
        if not s[0] or not s[2] or s[3] == capped:
            break
        capped = s[3]
        level = (share * s[0] - s[1]) / s[2]
    return totals.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.lit(level)))


def tilted(lam: Column, x: Column) -> Column:
    """A document's rate; x is its size in units of the source's mean."""
    return F.when(lam * x >= math.log(MOST), F.lit(float(MOST))).otherwise(F.exp(lam * x))


def balance(classes: DataFrame, totals: DataFrame) -> DataFrame:
    """classes(source, size, n) and totals(source, source_size, target) -> totals with mean and lam, lambda of each source.

    One row a source goes from step to step; nothing of it reaches the driver but how many sources are still off.
    """
    means = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    t, m = totals.alias("t"), means.alias("m")
    now = t.join(m, F.col("t.source").eqNullSafe(F.col("m.source")), "left").select("t.*", F.coalesce("m.mean", F.lit(1.0)).alias("mean"))
    now = cut(now.withColumns({"lam": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": (F.col("target") <= 0) | (F.col("target") >= MOST * F.col("source_size") * (1 - NEAR))}))
    for _ in range(NEWTON_STEPS):
        off = now.where("not done")
        if not off.head(1):
            break
        c, s = classes.where("size > 0").alias("c"), off.alias("s")
        x = F.col("c.size") / F.col("s.mean")
        rate = tilted(F.col("s.lam"), x)
        met = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", (F.col("c.n") * x * rate).alias("g"), F.when(rate < MOST, F.col("c.n") * x * x * rate).otherwise(0.0).alias("h"))
        fields = [f for f in now.columns]
        met = met.groupBy(*fields).agg((F.sum("g") - F.col("target") / F.col("mean")).alias("g"), F.sum("h").alias("h"))
        low, high = F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("low")), F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("high"))
        met = met.withColumns({"low": low, "high": high, "done": F.abs("g") * F.col("mean") <= NEAR * F.greatest("target", F.lit(1.0))})
        newton = F.when(F.col("h") > 0, F.col("lam") - F.col("g") / F.col("h"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        # without a bracket on one side the step is to twice the distance, at most
        half = F.when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.col("high") - 1)).when(F.col("high") == float("inf"), F.greatest(F.col("low") * 2, F.col("low") + 1)).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(half)
        now = cut(now.where("done").unionByName(met.withColumn("lam", step).select(*fields)))
    full = F.col("target") >= MOST * F.col("source_size") * (1 - NEAR)
    return now.withColumn("lam", F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(full, F.lit(float("inf"))).otherwise(F.col("lam"))).drop("low", "high", "done")


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size class of one source.  A class is a size, so the group is no longer than the distinct sizes."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    copies = np.zeros(len(pdf), np.int64)
    carried = 0.0
    for i, (z, n, rate) in enumerate(zip(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy())):
        if z > 0:
            want = carried + float(z) * n * rate
            copies[i] = min(max(int(np.floor(want / z + 0.5)), 0), MOST * int(n))
            carried = want - float(z) * copies[i]
    return pdf[["source", "size", "n", "rate"]].assign(copies=copies)


def mix(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, key: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """key, source, size, source_size, target, rate and copies of every row, and the columns named in `keep`."""
    spread = F.xxhash64(F.col(key), F.col(text))
    rows = df.select(F.col(key).alias("__id"), F.col(source).alias("source"), word_count(text).alias("size"), spread.alias("__h"), *[F.col(c).alias(f"__x_{c}") for c in keep])
    grouped = rows.groupBy("source", "size", F.pmod(F.col("__h"), F.lit(1 << 12)).cast("int").alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut(grouped)
    all_rows = cells.agg(F.sum("n")).first()[0] or 0
    fold = 1
    while fold < min(1 << 12, max(16, all_rows // BUCKET_ROWS)):
        fold *= 2
    classes = cut(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    totals = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    totals = balance(classes, totals)
    rate = F.when(F.col("c.size") > 0, tilted(F.col("t.lam"), F.col("c.size") / F.col("t.mean"))).otherwise(0.0)
    rated = classes.alias("c").join(totals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "c.size", "c.n", rate.alias("rate"))
    plan = rated.groupBy("source").applyInPandas(_carry, "source string, size long, n long, rate double, copies long")
    part = cells.groupBy("source", "size", F.pmod(F.col("__b"), F.lit(fold)).alias("__b")).agg(F.sum("n").alias("m"))
    before = W.partitionBy("source", "size").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("first", F.coalesce(F.sum("m").over(before), F.lit(0)))
    part, plan = part.alias("p"), plan.alias("q")
    quota = part.join(plan, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.size") == F.col("q.size"))).select("p.source", "p.size", "p.__b", "p.first", "q.n", "q.rate", "q.copies")
    quota, t = quota.alias("q"), totals.alias("t")
    quota = quota.join(t, F.col("q.source").eqNullSafe(F.col("t.source"))).select("q.*", "t.source_size", "t.target", _named(F.col("q.source")).alias("__s"))
    # rows are shuffled once: the ranks and the join with the quotas share the key
    rows = rows.withColumns({"__b": F.pmod(F.col("__h"), F.lit(fold)).cast("int"), "__s": _named(F.col("source"))})
    rank = F.row_number().over(W.partitionBy("__s", "size", "__b").orderBy("__h", "__id")) - 1
    r, q = rows.withColumn("__r", rank).alias("r"), quota.alias("q")
    out = r.join(q, (F.col("r.__s") == F.col("q.__s")) & (F.col("r.size") == F.col("q.size")) & (F.col("r.__b") == F.col("q.__b")))
    extra = F.when(F.col("q.first") + F.col("r.__r") < F.pmod(F.col("q.copies"), F.col("q.n")), 1).otherwise(0)
    copies = F.floor(F.col("q.copies") / F.col("q.n")).cast("long") + extra
    return out.select(F.col("r.__id").alias(key), F.col("r.source").alias("source"), F.col("r.size").alias("size"), "q.source_size", "q.target", "q.rate", copies.alias("copies"), *[F.col(f"r.__x_{c}").alias(c) for c in keep])


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """docs with every row as often as the mix takes it; columns as they come."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    held = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.col("source").alias("s"), row.alias("row"))
    out = mix(held, weights, share, "k", "t", "s", ["row"])
    out = out.where("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "row")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 3, 1, 2, repeating, and share 150 % of all words."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")
