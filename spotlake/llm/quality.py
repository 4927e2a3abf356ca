"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): every pairwise interaction in time linear in the
text.  A text's features are its distinct hashed words, each 1 / sqrt(their number), the standardised statistics of `STATS`, and
the binned length that the row states (n_chars, where the table has it).

Fitting takes at most SAMPLE labelled rows (ids first by hash, then rows by hash of their features); only their features reach the driver.
Scoring covers every row; the model (BUCKETS x (1 + FACTORS) numbers) is broadcast.

Defined cases: null and empty texts score as texts without words; a missing or null n_chars has a bin of its own; null labels and
labels without a text teach nothing; of labels of one id the largest counts; rows that repeat an id all teach, within the bound; a text counts
whole, however long; without a label every score is 0.5; columns with clashing names are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import buffers, counts_by, segments, span_hash, sums_by, words
from .shared import fold, table, tune

SAMPLE = 8_192
BUCKETS = 1 << 16
FACTORS = 4
EPOCHS = 30
THRESHOLD = 0.3
LENGTH_BINS = 64
_U = np.uint64
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:!?'\"()-", "space": b" ", "line": b"\n\r", "tab": b"\t\x0b\x0c",
    "bar": b"|", "hash": b"#", "dollar": b"$", "percent": b"%", "amp": b"&", "star": b"*", "other": b"<>{}[]=+/\\^_`~@",
}
STATS = [*_CLASSES, "high", "log_bytes", "log_words", "word_bytes", "distinct", "log_lines", "repeated_lines", "marked_words", "top_word"]


def _lut() -> np.ndarray:
    out = np.full(256, len(_CLASSES), np.uint8)
    for i, chars in enumerate(_CLASSES.values()):
        out[list(chars)] = i
    return out


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (texts, STATS), and the bucket and text of every distinct word."""
    n = len(off) - 1
    size = np.diff(off)
    stats = np.zeros((n, len(STATS)), np.float32)
    k = len(_CLASSES) + 1
    doc = np.repeat(np.arange(n), size)
    share = np.bincount(doc * k + _lut()[data], minlength=n * k).reshape(n, k)
    stats[:, :k] = share / np.maximum(size, 1)[:, None]
    d, s, e, owner = words(data, off)
    m, first = counts_by(owner, n)
    h = span_hash(d, s, e)
    key = (owner.astype(_U) << _U(32)) | (h >> _U(32))
    key, times = np.unique(key, return_counts=True)
    mine = (key >> _U(32)).astype(np.int64)
    bucket = (key & _U(BUCKETS - 1)).astype(np.int32)
    own, begin = counts_by(mine, n)
    top = np.zeros(n)
    full = own > 0
    if full.any():
        top[full] = np.maximum.reduceat(times, begin[full])
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    plain = np.concatenate([[0], np.cumsum(letter[d])])
    marked = (plain[e] - plain[s]) < (e - s) - 1
    line_part = np.zeros(256, bool)
    line_part[[10, 13]] = True
    ld, ls, le, lo = words(data, off, line_part)
    lines, _ = counts_by(lo, n)
    lkey = np.unique((lo.astype(_U) << _U(32)) | (span_hash(ld, ls, le) >> _U(32)))
    distinct = np.bincount((lkey >> _U(32)).astype(np.int64), minlength=n)
    rest = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(m), "word_bytes": np.minimum(sums_by((e - s).astype(np.float64), first, m) / np.maximum(m, 1), 64),
        "distinct": own / np.maximum(m, 1), "log_lines": np.log1p(lines), "repeated_lines": 1 - distinct / np.maximum(lines, 1),
        "marked_words": sums_by(marked.astype(np.float64), first, m) / np.maximum(m, 1), "top_word": top / np.maximum(m, 1),
    }
    for i, name in enumerate(STATS):
        if name in rest:
            stats[:, i] = rest[name]
    return stats, bucket, mine


def _length_bin(stated: np.ndarray) -> np.ndarray:
    """Bin of the stated length; the last bin is for rows without one."""
    bins = np.full(len(stated), LENGTH_BINS - 1)
    ok = ~np.isnan(stated)
    bins[ok] = np.clip(np.log2(np.maximum(stated[ok], 0) + 1) * 2, 0, LENGTH_BINS - 2)
    return bins


def _stated(df: DataFrame):
    return (F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")).alias("__n")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 5) -> dict:
    """The model from labels(doc_id, label) and their texts."""
    tune(docs.sparkSession)
    few = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` ids at most, so their broadcast is bounded
    rows = docs.select("doc_id", F.col("text"), _stated(docs)).join(F.broadcast(few), "doc_id").select("y", "__n", "text")

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(2))
            out = []
            for _, d, o in segments(data, off):
                stats, bucket, mine = features(d, o)
                n, first = counts_by(mine, len(o) - 1)
                out += [(stats[i].tobytes(), bucket[first[i] : first[i] + n[i]].tobytes()) for i in range(len(o) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), b.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["y", "n", "stats", "words"])

    got = rows.mapInArrow(run, "y int, n double, stats binary, words binary").orderBy(F.xxhash64("stats", "words"), "y").limit(sample).toArrow()
    y = got.column("y").to_numpy().astype(np.float64) > 0
    if len(y) == 0:
        return {"w0": 0.0, "w": np.zeros(_width(), np.float32), "v": np.zeros((_width(), FACTORS), np.float32), "mean": np.zeros(len(STATS)), "scale": np.ones(len(STATS))}
    stats = np.stack([np.frombuffer(x, np.float32) for x in got.column("stats").to_pylist()])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    ids = [np.frombuffer(x, np.int32) for x in got.column("words").to_pylist()]
    bins = _length_bin(got.column("n").to_numpy(zero_copy_only=False).astype(np.float64))
    z = np.clip((stats - mean) / scale, -5, 5) / np.sqrt(len(STATS))
    return {"mean": mean, "scale": scale} | _train(z, ids, bins, y, seed)


def _width() -> int:
    return BUCKETS + len(STATS) + LENGTH_BINS


def _sparse(z: np.ndarray, ids: list[np.ndarray], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, row) of every entry."""
    n = np.array([len(i) for i in ids], np.int64)
    rows = np.arange(len(ids))
    feature = np.concatenate([*ids, np.tile(BUCKETS + np.arange(len(STATS)), len(ids)), BUCKETS + len(STATS) + bins]).astype(np.int64)
    value = np.concatenate([np.repeat(1 / np.sqrt(np.maximum(n, 1)), n), z.ravel(), np.full(len(ids), 0.3)])
    return feature, value, np.concatenate([np.repeat(rows, n), np.repeat(rows, len(STATS)), rows])


def _margin(w0, w, v, feature, value, row, n):
    """The machine's value for n rows, with sum_i v_if x_i."""
    out = w0 + np.bincount(row, weights=w[feature] * value, minlength=n)
    sums = np.zeros((n, v.shape[1]))
    for f in range(v.shape[1]):
        t = v[feature, f] * value
        sums[:, f] = np.bincount(row, weights=t, minlength=n)
        out += 0.5 * (sums[:, f] ** 2 - np.bincount(row, weights=t * t, minlength=n))
    return out, sums


def _train(z, ids, bins, y, seed) -> dict:
    """Adagrad on the logistic loss, rows in a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    width = _width()
    w, v = np.zeros(width), rng.normal(0, 0.05, (width, FACTORS))
    gw, gv, g0 = np.full(width, 1e-2), np.full((width, FACTORS), 1e-2), 1e-2
    p = (y.sum() + 1) / (len(y) + 2)
    w0 = float(np.log(p / (1 - p)))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 128)):
            feature, value, row = _sparse(z[at], [ids[i] for i in at], bins[at])
            m, sums = _margin(w0, w, v, feature, value, row, len(at))
            err = (1 / (1 + np.exp(-m)) - y[at]) / len(at)
            g = err.sum()
            g0 += g * g
            w0 -= 0.2 * g / np.sqrt(g0)
            on, back = np.unique(feature, return_inverse=True)
            g = np.bincount(back, weights=err[row] * value) + 1e-5 * w[on]
            gw[on] += g * g
            w[on] -= 0.2 * g / np.sqrt(gw[on])
            for f in range(FACTORS):
                g = np.bincount(back, weights=err[row] * (value * sums[row, f] - v[feature, f] * value**2)) + 1e-5 * v[on, f]
                gv[on, f] += g * g
                v[on, f] -= 0.1 * g / np.sqrt(gv[on, f])
    return {"w0": w0, "w": w.astype(np.float32), "v": v.astype(np.float32)}


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df's columns without the text, and `score`."""
    tune(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    others = [c for c in df.columns if c not in (text, "__n")]

    def run(batches):
        m = shared.value
        for b in batches:
            data, off = buffers(b.column(len(others)))
            stated = b.column(len(others) + 1).to_numpy(zero_copy_only=False).astype(np.float64)
            out = np.zeros(len(off) - 1)
            for lo, d, o in segments(data, off, 1 << 20):
                n = len(o) - 1
                stats, bucket, mine = features(d, o)
                z = np.clip((stats - m["mean"]) / m["scale"], -5, 5) / np.sqrt(len(STATS))
                own = np.bincount(mine, minlength=n)
                rows = np.arange(n)
                feature = np.concatenate([bucket, np.tile(BUCKETS + np.arange(len(STATS)), n), BUCKETS + len(STATS) + _length_bin(stated[lo : lo + n])])
                value = np.concatenate([(1 / np.sqrt(np.maximum(own, 1)))[mine], z.ravel(), np.full(n, 0.3)])
                row = np.concatenate([mine, np.repeat(rows, len(STATS)), rows])
                out[lo : lo + n] = _margin(m["w0"], m["w"], m["v"], feature, value, row, n)[0]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names=[*names, "score"])

    names = [f"c{i}" for i in range(len(others))]
    head = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    stated = F.col("__n") if "__n" in df.columns else F.lit(None).cast("double").alias("__n")
    out = df.select(*others, text, stated).mapInArrow(run, f"{head}score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels whose crc32(doc_id) modulo 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text", _stated(docs))
    out = score(rows, model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
