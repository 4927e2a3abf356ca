"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training adds up, language by language, how often each hashed n-gram of 1 to 4 characters occurs; the sums of all tasks meet in
Spark's aggregation.  The log-probability matrix (BLOCK languages x BUCKETS, a fixed width) is broadcast and texts are scored in numpy, an
n-gram being a row of the matrix.  More languages are scored block by block, a pass over the texts each, which carries the best language and
the sum of the posterior on.  ASCII letters are lower-cased; digits and ASCII punctuation part words and are left out.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the smaller language by code point; a text counts whole,
however long; a null id is a row like any other; without a training row everything is `und`; equal texts get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, buffers, mix, segments
from .shared import cut, fold, table, tune

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
ALPHA = 0.5
#: Languages of one matrix; its broadcast is then 64 MB at most.
BLOCK = 256
LETTER = "\\p{L}"
#: Bytes that are kept: letters and all of longer code points; others become one space.
_KEEP = np.zeros(256, bool)
_KEEP[97:123] = _KEEP[128:] = True
_U = np.uint64


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of characters, text by text."""
    d = LOWER[data]
    d = np.where(_KEEP[d], d, np.uint8(32))
    edge = np.zeros(len(d) + 1, bool)
    edge[off] = True
    space = d == 32
    twice = space & np.concatenate([[False], space[:-1]]) & ~edge[:-1]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    d, doc = d[~twice], doc[~twice]
    lead = np.flatnonzero((d & 0xC0) != 0x80)
    if len(lead) == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    # a character's bytes (4 at most) make one number
    wide = np.concatenate([d, np.zeros(4, np.uint8)])
    size = np.diff(np.concatenate([lead, [len(d)]]))
    code = wide[lead].astype(_U)
    for i in (1, 2, 3):
        code = np.where(size > i, (code << _U(8)) | wide[lead + i], code)
    doc = doc[lead]
    out, owner = [], []
    h = code
    for k in ORDERS:
        if k > 1:
            if len(code) < k:
                break
            h = h[:-1] * _U(0x9E3779B97F4A7C15) + code[k - 1 :]
        same = doc[: len(h)] == doc[k - 1 :]
        out.append((mix(h + _U(k)) >> _U(48)).astype(np.int32)[same])
        owner.append(doc[: len(h)][same])
    return np.concatenate(out), np.concatenate(owner)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], DataFrame]:
    """Languages in order, and how often (lang, bucket, n) each n-gram occurs in them, from all rows with a language."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            data, off = buffers(b.column(0))
            for lo, d, o in segments(data, off, 1 << 20):
                g, doc = grams(d, o)
                mine = langs[lo : lo + len(o) - 1]
                names = sorted(set(mine))
                place = {x: i for i, x in enumerate(names)}
                code = np.array([place[x] for x in mine])
                # languages a few at a time: a dense table of them all would have no bound
                for first in range(0, len(names), 64):
                    some = names[first : first + 64]
                    on = (code[doc] >= first) & (code[doc] < first + 64)
                    n = np.bincount((code[doc][on] - first).astype(np.int64) * BUCKETS + g[on], minlength=len(some) * BUCKETS).reshape(-1, BUCKETS)
                    for i, x in enumerate(some):
                        held[x] = held[x] + n[i] if x in held else n[i]
                    if len(held) > 64:
                        yield from flush(held)
        yield from flush(held)

    def flush(held):
        for x, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])
        held.clear()

    rows = df.where(F.col(lang).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(lang).alias("l"))
    seen = sorted((r[0] for r in rows.select("l").distinct().collect()), key=lambda x: x.encode())
    return seen, cut(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def matrix(langs: list[str], sums: DataFrame) -> np.ndarray:
    """Log-probabilities (BUCKETS, languages) of some languages; a row of the matrix at a time reaches the driver."""
    packed = sums.where(F.col("lang").isin(*langs)).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m")).toArrow()
    total = np.zeros((BUCKETS, len(langs)))
    index = {x: i for i, x in enumerate(langs)}
    for b, m in zip(packed.column("bucket").to_pylist(), packed.column("m").to_pylist()):
        for x, n in m:
            total[b, index[x]] = n
    total += ALPHA
    return np.log(total / total.sum(axis=0)).astype(np.float32)


def _pass(langs: list[str], shared, others: int, last: bool):
    """One block of languages over all texts: the best language so far, its log-probability, and the others' odds against it."""

    def run(batches):
        m = shared.value
        for b in batches:
            data, off = buffers(b.column(others))
            n = len(off) - 1
            total = np.zeros((n, len(langs)))
            for lo, d, o in segments(data, off, 1 << 20):
                g, doc = grams(d, o)
                for j in range(len(langs)):
                    total[lo : lo + len(o) - 1, j] += np.bincount(doc, weights=m[g, j], minlength=len(o) - 1)
            best, top, odds = b.column(others + 2).to_pylist(), *(b.column(others + i).to_numpy(zero_copy_only=False) for i in (3, 4))
            mine = total.argmax(axis=1)
            high = total[np.arange(n), mine]
            new = np.maximum(top, high)
            odds = odds * np.exp(top - new) + np.exp(total - new[:, None]).sum(axis=1)
            best = [langs[i] if up else old for i, up, old in zip(mine, high > top, best)]
            kept = [*b.columns[:others], *([] if last else [b.column(others)]), b.column(others + 1)]
            names = [f"c{i}" for i in range(others)] + ([] if last else ["t"]) + ["l", "best", "top", "odds"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(new), pa.array(odds)], names=names)

    return run


def predict(df: DataFrame, model: tuple[list[str], DataFrame], text: str = "text") -> DataFrame:
    """df with lang_pred and score, the posterior of the language under equal priors."""
    tune(df.sparkSession)
    langs, sums = model
    others = [c for c in df.columns if c != text]
    head = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    lettered = F.coalesce(F.rlike(F.col(text), F.lit(LETTER)), F.lit(False))
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text).alias("t"), lettered.alias("l"), F.lit(None).cast("string").alias("best"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("odds"))
    blocks = [langs[i : i + BLOCK] for i in range(0, len(langs), BLOCK)]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        shared = df.sparkSession.sparkContext.broadcast(matrix(block, sums))
        rows = rows.mapInArrow(_pass(block, shared, len(others), last), f"{head}{'' if last else 't string, '}l boolean, best string, top double, odds double")
        if not last:
            rows = cut(rows)
    known = F.col("l") & F.col("best").isNotNull()
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.when(known, F.col("best")).otherwise("und").alias("lang_pred"), F.when(known, 1 / F.col("odds")).otherwise(0.0).alias("score"))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 3) != 1)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32(doc_id) modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    model = fit(training(docs).select("text", "lang"))
    rows = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return predict(rows, model)


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language, found with at least this posterior; columns as they come."""
    tune(docs.sparkSession)
    model = fit(training(docs).select("text", "lang"))
    held = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns], F.col("text").alias("__text"))
    out = predict(held, model, "__text").where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])
