"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (ASCII lower case; letters, digits and longer code points; the rest parts words).  An item of L
words leaks into a text if some stretch of the text is within floor(L * (1 - similarity)) word edits of it.

Windows of L words slide over every text.  A window is embedded by the CGK random walk, which turns edit distance into Hamming
distance: at each of 3L steps it puts out the word under its pointer and moves on by a hashed bit.  Each of REPEATS walks gives
one key, SAMPLES sampled places of the embedding; windows and items that share a key meet in a join and are verified by the edit distance of the
item to the best stretch of the words around.

The walks resynchronise by chance, rarely so at a text's edge or over hundreds of words, so blocks propose pairs as well: of an item's
L // q disjoint blocks of q = L // (k + 1) words, k edits spoil k at most.  A row of windows and an item that share all
the other blocks' number are verified too, so no leak within the allowed edits is left to chance.

A window is not embedded if it has fewer words, or runs of three words, of the benchmark than any leak must have: k edits leave
L - k words and, by the q-gram lemma, L - 2 - 3k runs in place, so this drops no leak.  The benchmark's words, its runs (with
the sizes of the items that have them) and the items' keys are broadcast as tables of fixed size; chance hits only cost time.

Defined cases: null and empty texts leak nothing, items without a word are found nowhere; equal texts get equal hits; a null id is carried like
any other; ids that repeat share their hits; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import NOT_ALNUM, buffers, counts_by, mix, segments, span_hash, words
from .shared import cut, table, tune

SIMILARITY = 0.8
REPEATS = 24
SAMPLES = 2
#: Bits of the broadcast tables of words, of keys and of runs.
WORD_BITS, KEY_BITS, RUN_BITS = 23, 25, 20
#: Windows embedded at a time.
FLUSH = 16_384
_U = np.uint64
_PAD = _U(0)


def allowed(size, similarity: float = SIMILARITY):
    """Word edits that an item of this size may differ by."""
    return np.floor(np.asarray(size) * (1 - similarity) + 1e-9).astype(np.int64)


def keys(w: np.ndarray, size: np.ndarray, repeats: int = REPEATS, samples: int = SAMPLES) -> np.ndarray:
    """(windows, repeats) LSH keys of windows w (windows, widest), each `size` words long and padded."""
    n, widest = w.shape
    out = np.empty((n, repeats), _U)
    if n == 0:
        return out
    flat, base = np.concatenate([w, np.full((n, 1), _PAD)], axis=1).ravel(), np.arange(n) * (widest + 1)
    for r in range(repeats):
        # which step of the walk each sample takes; the pointer moves on at every other step and is past the end, where all
        # embeddings agree, from about step 2 * size
        places = np.sort(np.random.default_rng((r, 17)).random(samples))
        at = (places[None, :] * (1.8 * size)[:, None]).astype(np.int64)
        step = mix(np.arange(3 * widest, dtype=_U) + _U(1000003 * (r + 1))) | _U(1)
        key = size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(r)
        p = np.zeros(n, np.int64)
        for j in range(int(at.max()) + 1):
            sym = flat[base + np.minimum(p, size)]
            sym = np.where(p < size, sym, _PAD)
            for c in range(samples):
                hit = at[:, c] == j
                if hit.any():
                    key[hit] = mix(key[hit] * _U(0xD6E8FEB86659FD93) + sym[hit])
            p += ((sym * step[j]) >> _U(63)).astype(np.int64)
        out[:, r] = mix(key)
    return out


def block(size: int, k: int) -> tuple[int, int]:
    """Words of a block of an item of this size, and how many of its disjoint blocks k edits leave at least."""
    q = max(1, size // (k + 1))
    return q, max(1, size // q - k)


def grams(h: np.ndarray, q: int, size: int) -> np.ndarray:
    """Keys, for items of this size, of the q words that begin at each word but the last q - 1."""
    n = len(h) - q + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, (size * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & (2**64 - 1), _U)
    for i in range(q):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[i : i + n])
    return out


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Word edits between item and the best stretch of text, and where that stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != x))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def runs(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of three words that begin at each word but the last two."""
    if len(h) < 3:
        return np.zeros(0, _U)
    return mix(h[:-2] * _U(0x9E3779B97F4A7C15) + h[1:-1] * _U(0xC2B2AE3D27D4EB4F) + h[2:])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & _U((1 << RUN_BITS) - 1)).astype(np.int64)


def _starts(at: np.ndarray, need: int, size: int, doc: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where windows of `size` words begin that hold at least `need` of the runs at the ascending places `at`.

    A window stays within its text: it is moved back from the text's end, and covers a shorter text whole.
    """
    a, z = at[: max(0, len(at) - need + 1)], at[need - 1 :]
    ok = (z - a <= size - 3) & (doc[a] == doc[z])
    a, z = a[ok], z[ok]
    low = z - (size - 3)
    n = a - low + 1
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    t = np.repeat(doc[a], n)
    return np.unique(np.maximum(np.minimum(at, first[t] + m[t] - size), first[t]))


def _item_words(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words) of every item with a word."""

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            d, s, e, doc = words(data, off, NOT_ALNUM)
            h = span_hash(d, s, e).view(np.int64)
            m, first = counts_by(doc, len(off) - 1)
            got = [h[a : a + n].tolist() for a, n in zip(first, m)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["item", "words"])

    kind = benchmark.schema[key].dataType.simpleString()
    return benchmark.select(F.col(key).alias("item"), F.col(text)).mapInArrow(run, f"item {kind}, words array<long>").where(F.size("words") > 0)


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    w = np.full((len(rows), int(size.max()) if len(rows) else 0), _PAD)
    for i, r in enumerate(rows):
        w[i, : len(r)] = r
    return w, size


def _bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which values of the column's low bits occur; 2**bits at most reach the driver."""
    got = rows.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("x")).distinct().toArrow().column("x").to_numpy()
    out = np.zeros(1 << bits, bool)
    out[got] = True
    return np.packbits(out, bitorder="little")


def _in(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    x = (h & _U((1 << bits) - 1)).astype(np.int64)
    return (bitmap[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`carry` columns of docs with item_id, n_words (of the item), edits and word (where the stretch ends, counted from 0): one row
    for each text and item, the nearest stretch."""
    tune(docs.sparkSession)
    items = cut(_item_words(benchmark, item, item_text))
    sizes = sorted(r[0] for r in items.select(F.size("words")).distinct().collect())

    def index(batches):
        for b in batches:
            rows = [np.array(x, np.int64).view(_U) for x in b.column(1).to_pylist()]
            w, size = _stack(rows)
            k = keys(w, size)
            blocks, need = [], []
            for x in rows:
                q, left = block(len(x), int(allowed(len(x), similarity)))
                blocks.append(grams(x, q, len(x))[::q])
                need.append(left)
            count = [len(x) for x in blocks]
            at = np.concatenate([np.repeat(np.arange(len(rows)), REPEATS), np.repeat(np.arange(len(rows)), count)])
            share = np.concatenate([np.ones(k.size), np.repeat(1 / np.array(need, float), count)])
            key = np.concatenate([k.ravel(), *blocks])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(at)), pa.array(share)], names=["key", "item", "share"])

    kind = items.schema["item"].dataType.simpleString()
    indexed = cut(items.mapInArrow(index, f"key long, item {kind}, share double"))
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(_bitmap(items.select(F.explode("words").alias("w")), "w", WORD_BITS))
    held = sc.broadcast(_bitmap(indexed, "key", KEY_BITS))
    place = {L: i % 64 for i, L in enumerate(sizes)}

    def triple(batches):
        """Which sizes of items have a run, by the run's slot."""
        for b in batches:
            rows = [np.array(x, np.int64).view(_U) for x in b.column(0).to_pylist()]
            slot = np.concatenate([np.zeros(0, np.int32), *[_slot(runs(x)) for x in rows]])
            mask = np.concatenate([np.zeros(0, _U), *[np.full(max(0, len(x) - 2), 1 << place[len(x)], _U) for x in rows]])
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    got = items.select("words").mapInArrow(triple, "slot int, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(1 << RUN_BITS, _U)
    masks[got.column("slot").to_numpy()] = got.column("mask").to_numpy().view(_U)
    masks = sc.broadcast(masks)
    k_of = {int(L): int(allowed(L, similarity)) for L in sizes}
    names = [f"c{i}" for i in range(len(carry))]
    fields = [docs.schema[c].dataType for c in carry]

    def windows(batches):
        vocab, three, known = vocabulary.value, masks.value, held.value
        waiting: list[tuple] = []

        def flush():
            w, size = _stack([x[2] for x in waiting])
            # the size that counts is the item's: shorter windows are padded
            size = np.array([x[1] for x in waiting], np.int64)
            if w.shape[1] < size.max():
                w = np.concatenate([w, np.full((len(w), int(size.max()) - w.shape[1]), _PAD)], axis=1)
            k = keys(w, size)
            hit = _in(known, k.ravel(), KEY_BITS).reshape(k.shape)
            # windows that begin close together share one row: their keys, the blocks and the words around them all
            rows: dict[tuple, tuple] = {}
            for i, (own, L, _, around, at, begin, serial) in enumerate(waiting):
                if (serial, L, at) not in rows:
                    x = grams(around, block(L, k_of[L])[0], L)
                    rows[serial, L, at] = (own, around, begin, [x[_in(known, x, KEY_BITS)]])
                rows[serial, L, at][3].append(k[i][hit[i]])
            rows = {r: v for r, v in rows.items() if any(len(x) for x in v[3])}
            waiting.clear()
            got = list(rows.values())
            cols = [pa.array([r[0][c] for r in got], kinds[c]) for c in range(len(names))]
            lists = pa.array([np.unique(np.concatenate(r[3])).view(np.int64).tolist() for r in got], pa.list_(pa.int64()))
            around = pa.array([r[1].view(np.int64).tolist() for r in got], pa.list_(pa.int64()))
            number = pa.array([f"{part}-{serial}-{L}-{at}-{made}" for serial, L, at in rows], pa.string())
            return pa.RecordBatch.from_arrays([*cols, number, pa.array([r[2] for r in got], pa.int64()), lists, around], names=[*names, "row", "begin", "keys", "around"])

        part, made, read = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            kinds = [b.column(i).type for i in range(len(names))]
            own = list(zip(*[b.column(i).to_pylist() for i in range(len(names))]))
            data, off = buffers(b.column(len(names)))
            for lo, d, o in segments(data, off):
                d, s, e, doc = words(d, o, NOT_ALNUM)
                h = span_hash(d, s, e)
                m, first = counts_by(doc, len(o) - 1)
                total = np.concatenate([[0], np.cumsum(_in(vocab, h, WORD_BITS))]).astype(np.int32)
                of = np.zeros(len(h), _U)
                if len(h) > 2:
                    of[:-2] = np.where(doc[:-2] == doc[2:], three[_slot(runs(h))], _U(0))
                some = np.flatnonzero(of)
                for L in sizes:
                    k = k_of[L]
                    need = L - 2 - 3 * k
                    if need > 0:
                        at = some[(of[some] >> _U(place[L])) & _U(1) == 1]
                        enough = _starts(at, need, L, doc, first, m)
                        enough = enough[total[np.minimum(enough + L, (first + m)[doc[enough]])] - total[enough] >= L - k]
                    else:
                        enough = np.flatnonzero(total[L:] - total[:-L] >= L - k) if len(h) >= L else np.zeros(0, np.int64)
                        enough = enough[doc[enough] == doc[enough + L - 1]]
                        small = np.flatnonzero((m < L) & (m >= L - k) & (m > 0))
                        small = small[total[first[small] + m[small]] - total[first[small]] >= L - k]
                        enough = np.unique(np.concatenate([enough, first[small]]))
                    for i, t in zip(enough.tolist(), doc[enough].tolist()):
                        a, z = int(first[t]), int(first[t] + m[t])
                        at = (i - a) // (k + 1)
                        x, y = max(a, a + at * (k + 1) - 2 * k - 1), min(z, a + at * (k + 1) + L + 4 * k + 1)
                        waiting.append((own[lo + t], L, h[i : min(z, i + L)].copy(), h[x:y].copy(), at, x - a, read + lo + t))
                        if len(waiting) >= FLUSH:
                            yield flush()
                            made += 1
            read += len(own)
        if waiting:
            yield flush()

    head = "".join(f"{n} {t.simpleString()}, " for n, t in zip(names, fields))
    found = cut(docs.select(*carry, text).mapInArrow(windows, f"{head}row string, begin long, keys array<long>, around array<long>"))
    # keys meet in narrow rows; the words join what has met by one walk or by as many blocks as the edits must leave
    met = found.select("row", F.explode("keys").alias("key")).join(indexed, "key").groupBy("row", "item").agg(F.sum("share").alias("share"))
    met = met.where("share > 0.999999").select("row", "item")
    met = met.join(found.drop("keys"), "row").join(items, met["item"].eqNullSafe(items["item"])).drop(items["item"])
    met = met.select(*names, "item", F.size("words").alias("n_words"), "begin", "around", "words")

    def verify(batches):
        for b in batches:
            t, w = b.column("around").to_pylist(), b.column("words").to_pylist()
            got = [distance(np.array(x), np.array(y)) for x, y in zip(w, t)]
            begin = b.column("begin").to_numpy()
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in (*names, "item", "n_words")], pa.array([g[0] for g in got], pa.int64()), pa.array(begin + np.array([g[1] for g in got], np.int64))], names=[*names, "item", "n_words", "edits", "word"])

    out = met.mapInArrow(verify, f"{head}item {kind}, n_words int, edits long, word long")
    out = out.where(F.col("edits") <= F.floor(F.col("n_words") * (1 - similarity) + 1e-9))
    best = out.groupBy(*names, "item", "n_words").agg(F.min(F.struct("edits", "word")).alias("s"))
    return best.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], F.col("item").alias(item), "n_words", "s.edits", "s.word")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs into which no item leaks; columns as they come."""
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    bad = cut(leaks(keyed, benchmark, ["doc_id", "__t"], similarity=similarity).select(F.col("doc_id").alias("__d"), F.col("__t").alias("__h")).distinct())
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["__d"]) & (keyed["__t"] == bad["__h"]), "left_anti").drop("__t")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of the benchmark leak into which documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
