"""Document fingerprints: improbable-feature digests.

Every window of WINDOW bytes has a collision entropy, read off the squares of its byte counts.  A first pass over all texts counts how
often each entropy level occurs; the rarer the level, the higher a window ranks.  A window is selected if it outranks all
windows within REACH bytes on either side (ties by content hash), so selection follows content, not position.  Selected windows enter Bloom
filters of FILTER bytes, HASHES bits each, in order of appearance; after PER_FILTER windows a new filter is chained.

Two digests are compared filter by filter: the overlap of set bits over what chance explains, as a share of the most possible, 0 to 1; each
filter of the digest with fewer filters meets its best match in the other, weighed by the windows it holds.

Scale: rows are parted into ranges of ids and sorted there, so a document and the next one pass by in one task; the ends of ranges, two rows each,
meet in a join.  A range is streamed, whatever its size.

Defined cases: null is an empty text; an empty text has the empty digest, like 1 to an empty one and 0 to any other; texts shorter than a
window are padded to one, and texts under SMALL bytes add all windows of SHORT bytes; a text counts whole, however long; equal texts have equal digests; ids may
be of any type, repeat or be null (null first, equal ids by text hash; equal rows are spread over ranges like others); a lone document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import _BYTE, _P, _PINV, buffers, mix, powers, segments
from .shared import cut, pack, sum_blobs, table, tune, unpack

WINDOW = 32
REACH = 16
#: Texts of fewer bytes add all their windows of SHORT bytes, so that small texts have more than one feature.
SMALL = 192
SHORT = 8
FILTER = 128
PER_FILTER = 64
HASHES = 5
LEVELS = 256
#: Text bytes of one range of ids, and the most ranges: beyond them ranges grow.
RANGE_BYTES = 24 << 20
RANGES = 8_192
_U = np.uint64


def levels(d: np.ndarray) -> np.ndarray:
    """Entropy level (0 to 255) of the window that begins at each byte of d; windows that run over the end are not listed.

    The collision entropy is -log2(sum of squared shares) over the 32 classes byte mod 32, which keep letters apart.
    """
    n = len(d) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint8)
    c = d & 31
    total = np.zeros(n, np.uint16)
    for k in range(32):
        w = (c == k).view(np.uint8)
        step = 1
        while step < WINDOW:
            w = w[:-step] + w[step:]
            step *= 2
        w16 = w.astype(np.uint16)
        w16 *= w16
        total += w16
    return _LEVEL[total]


_LEVEL = np.zeros(1 << 16, np.uint8)
_LEVEL[1 : WINDOW * WINDOW + 1] = np.clip((2 * np.log2(WINDOW) - np.log2(np.arange(1, WINDOW * WINDOW + 1))) / np.log2(WINDOW) * LEVELS, 0, LEVELS - 1)


def level_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many windows of all texts have each level."""

    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            data, off = buffers(b.column(0))
            for _, d, o in segments(data, off, 1 << 20):
                x = levels(d)
                inside = np.ones(len(x), bool)
                for e in o[1:-1]:
                    inside[max(0, e - WINDOW + 1) : e] = False
                total += np.bincount(x[inside], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(total)], pa.binary())], names=["slot", "blob"])

    got = sum_blobs(docs.select(text).mapInArrow(run, "slot int, blob binary"), 1, LEVELS).collect()
    return unpack(got[0]["blob"], np.int64) if got else np.zeros(LEVELS, np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """0 for the rarest level, LEVELS - 1 for the most frequent; ties by level."""
    out = np.empty(LEVELS, np.int64)
    out[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return out


class Digester:
    """Digests of single texts under one ranking of the levels."""

    def __init__(self, rank: np.ndarray):
        self.rank = rank.astype(_U) << _U(56)
        self.pw, self.inv = powers(_P, 1 << 16), powers(_PINV, 1 << 16)

    def windows(self, d: np.ndarray) -> np.ndarray:
        """Hashes of the selected windows, in order, each once."""
        if len(d) == 0:
            return np.zeros(0, _U)
        short = np.zeros(0, _U)
        if len(d) < SMALL:
            flat = np.concatenate([d, np.zeros(max(0, SHORT - len(d)), np.uint8)])
            short = mix(np.lib.stride_tricks.sliding_window_view(flat, SHORT).copy().view("<u8").ravel().astype(_U))
        if len(d) < WINDOW:
            d = np.concatenate([d, np.zeros(WINDOW - len(d), np.uint8)])
        n = len(d)
        if n >= len(self.pw):
            self.pw, self.inv = powers(_P, 2 * n), powers(_PINV, 2 * n)
        h = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[d] * self.pw[:n], out=h[1:])
        m = n - WINDOW + 1
        code = mix((h[WINDOW:] - h[:-WINDOW]) * self.inv[:m])
        key = self.rank[levels(d)] | (code >> _U(8))
        # the least key within REACH on both sides, by doubling
        low = np.concatenate([np.full(REACH, ~_U(0)), key, np.full(REACH, ~_U(0))])
        step, span = 1, 2 * REACH + 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: m], low[span - step : span - step + m])
        code = np.concatenate([code[key == low], short])
        _, first = np.unique(code, return_index=True)
        return code[np.sort(first)]

    def digest(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filters (chained, FILTER bytes) and how many windows each holds."""
        code = self.windows(d)
        if len(code) == 0:
            return np.zeros((0, FILTER), np.uint8), np.zeros(0, np.int64)
        k = -(-len(code) // PER_FILTER)
        bits = np.zeros((k, FILTER * 8), np.uint8)
        which = np.arange(len(code)) // PER_FILTER
        for i in range(HASHES):
            bits[which, ((code >> _U(10 * i + 4)) & _U(FILTER * 8 - 1)).astype(np.int64)] = 1
        return np.packbits(bits, axis=1), np.bincount(which, minlength=k)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; symmetric, 1 for equal digests."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    if (len(a[0]), int(a[1].sum()), a[0].tobytes()) > (len(b[0]), int(b[1].sum()), b[0].tobytes()):
        a, b = b, a
    x, y = a[0].view(_U), b[0].view(_U)
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    total = 0.0
    for i in range(len(x)):
        both = np.bitwise_count(x[i] & y).sum(1, dtype=np.int64)
        most = np.minimum(nx[i], ny)
        chance = nx[i] * ny / (FILTER * 8)
        total += a[1][i] * float(np.max(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)))
    return total / float(a[1].sum())


def text_of(d: tuple[np.ndarray, np.ndarray]) -> str:
    """Hexadecimal filters, each led by the number of its windows (2 digits)."""
    return "".join(f"{n:02x}{f.tobytes().hex()}" for f, n in zip(*d))


def in_order(docs: DataFrame) -> DataFrame:
    """docs(key, text) parted into ranges of ascending keys, each in order; equal rows may lie in two ranges."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(size // RANGE_BYTES, RANGES))
    order = [F.col("key").asc_nulls_first(), F.col("h"), F.col("m")]
    rows = docs.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")


class Pairs:
    """What op5 returns for a document and its successor; digests of the last texts are kept."""

    def __init__(self, rank: np.ndarray):
        self.digester = Digester(rank)
        self.known: list[tuple[str, tuple]] = []

    def digest(self, text: str) -> tuple:
        for t, d in self.known:
            if t == text:
                return d
        d = self.digester.digest(np.frombuffer(text.encode(), np.uint8))
        self.known.append((text, d))
        del self.known[:-2]
        return d

    def row(self, key, text: str, after: str) -> tuple:
        n = len(text)
        k = n // 4
        edited = text[: n - k] + after[:k]
        mine, other = self.digest(text), self.digest(after)
        new = mine if edited == text else self.digester.digest(np.frombuffer(edited.encode(), np.uint8))
        return key, n, hashlib.sha256(edited.encode()).hexdigest(), text_of(mine), text_of(new), likeness(mine, new), likeness(mine, other)


def successors(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """docs(key, text) -> key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    kind = docs.schema["key"].dataType.simpleString()
    result = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    cols = [c.split()[0] for c in result.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def give(rows, key_type, more=()):
        kinds = [key_type, *types, *more]
        names = [*cols, "part", "place", "text"][: len(kinds)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches):
        """Place 0: a row whose successor is in its range; 1 and 2: the text of the range's first row, and its last row."""
        pairs, part, last = Pairs(rank), TaskContext.get().partitionId(), None
        more = (pa.int32(), pa.int32(), pa.string())
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                out.append((None,) * 7 + (part, 1, text) if last is None else (*pairs.row(*last, text), part, 0, None))
                last = (key, text)
            key_type = b.column(0).type
            yield give(out, key_type, more)
        if last is not None:
            yield give([(last[0], *[None] * 6, part, 2, last[1])], key_type, more)

    def close(batches):
        pairs = Pairs(rank)
        for b in batches:
            yield give([pairs.row(*r) for r in zip(*[b.column(i).to_pylist() for i in range(3)])], b.column(0).type)

    # hexadecimal digits take half their bytes under zstd, and all of them under snappy
    made = cut(in_order(docs).mapInArrow(run, f"{result}, part int, place int, text string"), "zstd")
    heads, tails = made.where("place = 1").select("part", F.col("text").alias("after")), made.where("place = 2").select("part", "key", "text")
    # one row a range, of which there are RANGES at most
    w = W.orderBy("part")
    following = heads.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(w)).alias("following"))
    ends = tails.join(following, "part").join(heads.withColumnRenamed("part", "following"), "following").select("key", "text", "after")
    return made.where("place = 0").select(*cols).unionByName(ends.mapInArrow(close, result))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text, and their likeness."""
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rank = ranks(level_counts(docs))
    return successors(docs.withColumnRenamed("doc_id", "key"), rank).withColumnRenamed("key", "doc_id")
