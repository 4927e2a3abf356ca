"""SimHash near-duplicates by vantage-point trees.

Every text's word shingles are hashed by XXH64; a fingerprint bit is set if it is set in over half the hashes.  The distinct fingerprints
are parted into shards in which every pair within the radius meets:

1. Of radius + 1 blocks of bits, a pair within the radius agrees in one at least.  A fingerprint goes to a shard for each block, named by the
   block's first bits, as many as bring a shard to about CELL fingerprints.
2. A shard of more than SHARD is cut by Hamming distance to a vantage point of its own, at the median: the nearer ones go to one side, the rest
   to the other.  By the triangle bound a pair within the radius that straddles the cut has its nearer end within the radius of the cut, so
   only those fingerprints are copied to the far side.  This goes on until no shard is too large, or a cut would shed less than a tenth.
3. What will not be cut is compared in pairs of blocks of SHARD / 2.

A shard goes on as a vantage-point tree in memory down to small leaves, whose pairs are compared in blocks.  Which vantage points are drawn
decides balance, never results.  A shard returns a spanning forest, not pairs; `components` joins the forests.  Work grows in proportion to the
distinct fingerprints as long as the blocks have bits left (some 10^8 fingerprints of evenly spread bits), and beyond it by cuts and pair blocks.
At the wide radius of `near_groups` the bound prunes little, and the shards are bands of like shingle counts.

Defined cases: a null, empty or blank text has fingerprint 0, linked like any other; equal texts always share a component; a text counts
whole, however long; a null id is a row like any other and never the smallest; repeated rows all come out; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernels import buffers, counts_by, mix, segments, words
from .shared import cut, table, tune

#: Distinct fingerprints a shard is meant to hold, and the most that one task compares.
CELL = 8_192
SHARD = 32_768
LEAF = 1_024
_U = np.uint64


def shingle_hashes(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each shingle of k words, and the text it belongs to; a shorter text is one shingle."""
    d, s, e, doc = words(data, off)
    if len(s) == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size = e - s
    to = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    joined = np.full(int(to[-1] + size[-1]), 0x20, np.uint8)
    n = int(size.sum())
    step = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.repeat(np.arange(len(s)), size)
    inner = np.arange(n) - step[at]
    joined[to[at] + inner] = d[s[at] + inner]
    m, first = counts_by(doc, len(off) - 1)
    whole = np.flatnonzero(doc[: max(0, len(s) - k + 1)] == doc[k - 1 :])
    short = np.flatnonzero((m > 0) & (m < k))
    a = np.concatenate([whole, first[short]])
    z = np.concatenate([whole + k - 1, first[short] + m[short] - 1])
    order = np.argsort(a, kind="stable")
    a, z = a[order], z[order]
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[x:y], 42) for x, y in zip(to[a].tolist(), (to[z] + size[z]).tolist())), _U, len(a))
    return h, doc[a]


def majority(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n fingerprints: bit i is 1 if set in over half of a text's hashes."""
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, len(h), 1 << 16):
        x, y = h[lo : lo + (1 << 16)], doc[lo : lo + (1 << 16)]
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        ones[y[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    total = np.bincount(doc, minlength=n)
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(_U)


def fingerprints(df: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the 64-bit fingerprint `fp` of every row."""

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            fp = np.zeros(len(off) - 1, _U)
            for lo, d, o in segments(data, off):
                h, doc = shingle_hashes(d, o, k)
                fp[lo : lo + len(o) - 1] = majority(h, doc, len(o) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["k", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text)).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hamming distance along the last axis of 64-bit words."""
    return np.bitwise_count(x ^ p).sum(-1, dtype=np.int16)


def _block_pairs(x: np.ndarray, at: np.ndarray, r: int):
    y = x[at]
    step = max(16, (1 << 21) // max(1, len(at)))
    for lo in range(0, len(at), step):
        rows = y[lo : lo + step]
        near = np.bitwise_count(rows[:, None, 0] ^ y[None, lo:, 0]).astype(np.int16 if x.shape[1] > 1 else np.uint8, copy=False)
        for c in range(1, x.shape[1]):
            near += np.bitwise_count(rows[:, None, c] ^ y[None, lo:, c])
        i, j = np.nonzero(near <= r)
        up = j > i
        yield at[lo + i[up]], at[lo + j[up]]


def pairs(x: np.ndarray, r: int):
    """All pairs of rows of x (n, words) within Hamming distance r, as blocks of two index arrays; a pair may come twice."""
    rng = np.random.default_rng(7)
    stack = [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) > LEAF:
            for _ in range(3):
                d = distance(x[at], x[at[rng.integers(len(at))]])
                cut_at = int(np.median(d))
                near, far = d < cut_at, d >= cut_at - r
                if near.any() and far.sum() <= 0.9 * len(at):
                    stack += [at[near], at[far]]
                    break
            else:
                yield from _block_pairs(x, at, r)
        else:
            yield from _block_pairs(x, at, r)


def _find(parent: np.ndarray, a: np.ndarray) -> np.ndarray:
    a = parent[a]
    while True:
        up = parent[a]
        if (up == a).all():
            return a
        a = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; the smaller root stays."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        on = a != b
        a, b = np.minimum(a[on], b[on]), np.maximum(a[on], b[on])
        np.minimum.at(parent, b, a)


def forest(x: np.ndarray, r: int) -> np.ndarray:
    """The smallest row of each row's component."""
    parent = np.arange(len(x))
    for a, b in pairs(x, r):
        unite(parent, a, b)
    return _find(parent, parent)


def shards(fps: DataFrame, r: int) -> DataFrame:
    """fps(fp), distinct -> (shard, i, j, fp): every pair within distance r meets in a shard of at most SHARD fingerprints."""
    n, width = fps.count(), 64 // (r + 1)
    bits = min(width, max(0, math.ceil(math.log2(max(1, n) / CELL))))
    top = lambda k: F.shiftrightunsigned("fp", (k + 1) * width - bits).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(k << bits)
    cells = [top(k).cast("long") for k in range(r + 1)] if bits else [F.lit(0).cast("long")]
    rows = cut(fps.select(F.explode(F.array(*cells)).alias("shard"), "fp", F.lit(True).alias("open")))
    level = 0
    while True:
        level += 1
        big = rows.where("open").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("p"))
        big = cut(big.where(F.col("n") > SHARD))
        if not big.head(1):
            break
        far_off = F.bit_count(F.col("fp").bitwiseXOR(F.col("p")))
        some = rows.where("open").join(big, "shard").withColumn("d", far_off)
        middle = some.groupBy("shard").agg(F.percentile_approx("d", 0.5).alias("c"))
        sides = some.join(middle, "shard").groupBy("shard", "p", "c", "n").agg(F.count_if(F.col("d") < F.col("c")).alias("near"), F.count_if(F.col("d") >= F.col("c") - r).alias("far"))
        plan = cut(sides.select("shard", "p", "c", ((F.col("near") > 0) & (F.col("far") <= 0.9 * F.col("n"))).alias("splits")))
        stay = lambda on: F.struct(F.col("shard").alias("shard"), F.lit(on).alias("open"))
        side = lambda k: F.struct(F.xxhash64("shard", F.lit(k), F.lit(level)).alias("shard"), F.lit(True).alias("open"))
        near, far = F.when(far_off < F.col("c"), side(0)), F.when(far_off >= F.col("c") - r, side(1))
        to = F.when(F.col("splits").isNull(), F.array(F.struct(F.col("shard").alias("shard"), F.col("open").alias("open")))).when(~F.col("splits"), F.array(stay(False))).otherwise(F.array_compact(F.array(near, far)))
        rows = cut(rows.join(plan, "shard", "left").select(F.explode(to).alias("to"), "fp").select("to.shard", "fp", "to.open"))
    half = max(1, SHARD // 2)
    left = cut(rows.where("not open").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("g")))
    rows = rows.join(left, "shard", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    rows = rows.select("shard", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    return rows.select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")


def links(fps: DataFrame, r: int) -> DataFrame:
    """fps(fp), distinct -> (a, b): a spanning forest of the pairs within distance r, shard by shard."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["fp"].to_numpy())
        root = forest(x.view(_U).reshape(-1, 1), r)
        on = root != np.arange(len(x))
        return pd.DataFrame({"a": x[on], "b": x[root[on]]})

    return shards(fps.select("fp"), r).groupBy("shard", "i", "j").applyInPandas(link, "a long, b long")


def dedup_components(df: DataFrame, k: int = 3, r: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the smallest key reachable over links of at most r differing bits) of every row."""
    tune(df.sparkSession)
    rows = cut(fingerprints(df, k, key, text))
    fps = cut(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(fps, r))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp")


# ---- near duplicates by verified similarity ----

#: Bits of the wide fingerprint of `near_groups` and its radius: at similarity 0.8 a pair differs in 19.3 of 128 bits on average
#: with a deviation of 4.1, so 31 misses about 2 pairs in 1,000 at the very threshold; two unrelated texts come that near about once in 10^8.
WIDE_RADIUS = 31
#: Sets of at most so many shingles are compared exactly as well: so few make a fingerprint too coarse.
SHORT = 14
#: Rows of one block of a band; a larger band is compared block by block.
BLOCK = 16_384


def wide(df: DataFrame, k: int, text: str) -> DataFrame:
    """df's other columns (first) with f0, f1, n (distinct shingles) and their sorted 32-bit hashes `sh`.

    The fingerprints are those of the set, as the similarity is: how often a shingle comes does not count.
    """
    others = [c for c in df.columns if c != text]

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(len(others)))
            f0, f1, n, sh = [], [], [], []
            for _, d, o in segments(data, off):
                m = len(o) - 1
                h, doc = shingle_hashes(d, o, k)
                key = np.unique((doc.astype(_U) << _U(32)) | (mix(h) >> _U(32)))
                doc, low = (key >> _U(32)).astype(np.int64), key.astype(np.uint32)
                f0.append(majority(mix(low ^ _U(0x2545F4914F6CDD1D)), doc, m))
                f1.append(majority(mix(low ^ _U(0x5851F42D4C957F2D)), doc, m))
                count = np.bincount(doc, minlength=m)
                n.append(count)
                ends = np.cumsum(count)
                sh += [low[z - c : z].tobytes() for z, c in zip(ends.tolist(), count.tolist())]
            cols = [np.concatenate(v) if v else np.zeros(0, t) for v, t in ((f0, _U), (f1, _U), (n, np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int64)), pa.array(sh, pa.binary())], names=[*others, "f0", "f1", "n", "sh"])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*others, text).mapInArrow(run, f"{head}, f0 long, f1 long, n long, sh binary")


def _cells(rows: DataFrame, similarity: float) -> DataFrame:
    """rows with the cells (band, i, j) where they meet every row whose shingle count allows the similarity.

    A pair that is similar enough has counts within that ratio, so it lies in one band or two adjoining ones; a row is in its own
    and the next.  Blocks keep a hot band from meeting in one task; the table of bands is as long as the logarithm of the longest text.
    """
    width = -math.log(similarity)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1)))
    blocks = {b: -(-c // BLOCK) for b, c in rows.groupBy("band").count().collect()}
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in blocks.items() for v in kv]), F.col("band")), F.lit(1)) if blocks else F.lit(1)
    rows = rows.withColumn("g", count).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("g") - 1).cast("int"))))
    return rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("g", "other")


def _short_links(rows: DataFrame, similarity: float) -> DataFrame:
    """rows(id, n, sh) of at most SHORT shingles -> (a, b): links by which all pairs that are similar enough hang together.

    Sets that share s shingles, with d and e others, are similar enough if s >= similarity * (s + d + e).  A set gives a key for each way to
    leave out d of its shingles, so such a pair meets under what it shares; and whoever is linked there is linked to the set with
    the fewest others.
    """
    most = [int(s * (1 / similarity - 1) + 1e-9) for s in range(SHORT + 1)]

    def run(batches):
        for b in batches:
            got = []
            for i, sh in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = mix(np.frombuffer(sh, np.uint32) ^ _U(0x9E3779B97F4A7C15))
                for d in range(len(h)):
                    if d > most[len(h) - d]:
                        break
                    left = np.array(list(itertools.combinations(range(len(h)), d)), np.int64).reshape(math.comb(len(h), d), d)
                    key = mix(h.sum(dtype=_U) - h[left].sum(1, dtype=_U))
                    got.append((np.full(len(key), i), key.view(np.int64), np.full(len(key), d), np.full(len(key), most[len(h) - d])))
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*got)] if got else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "key", "d", "most"])

    keys = cut(rows.where(F.col("n").between(1, SHORT)).select("id", "sh").mapInArrow(run, "id long, key long, d long, most long"))
    first = keys.groupBy("key").agg(F.min(F.struct("d", "id")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    met = keys.join(first, "key").where((F.col("id") != F.col("f.id")) & (F.col("d") + F.col("f.d") <= F.col("most")))
    return met.select(F.col("id").alias("a"), F.col("f.id").alias("b"))


def near_groups(texts: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """texts(id long, text), ids distinct -> (node, root): groups of texts linked by Jaccard similarity of their shingle sets.

    Fingerprints propose pairs; each link is verified on the shingle sets, unless its ends are joined already.  Short texts are linked
    by their sets alone, too.
    """
    rows = cut(wide(texts, k, "text"))

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([pdf["f0"].to_numpy(), pdf["f1"].to_numpy()], axis=1).view(_U)
        seen = np.zeros(len(x), bool)
        for a, b in pairs(x, WIDE_RADIUS):
            seen[a] = seen[b] = True
        return pd.DataFrame({"id": pdf["id"].to_numpy()[seen]})

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([pdf["f0"].to_numpy(), pdf["f1"].to_numpy()], axis=1).view(_U)
        ids, n, sets = pdf["id"].to_numpy(), pdf["n"].to_numpy(), [np.frombuffer(b, np.uint32) for b in pdf["sh"]]
        parent = np.arange(len(x))
        for a, b in pairs(x, WIDE_RADIUS):
            fits = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
            a, b = a[fits], b[fits]
            for i in np.unique(a):
                near = b[a == i]
                near = near[_find(parent, near) != _find(parent, np.array([i]))[0]]
                if len(near) == 0:
                    continue
                both = _common(sets[i], [sets[j] for j in near])
                ok = near[both >= similarity * (n[i] + n[near] - both)]
                unite(parent, np.full(len(ok), i), ok)
        root = _find(parent, parent)
        on = root != np.arange(len(x))
        return pd.DataFrame({"a": ids[on], "b": ids[root[on]]})

    slim = _cells(rows.select("id", "f0", "f1", "n").where("n > 0"), similarity)
    found = cut(slim.groupBy("band", "i", "j").applyInPandas(candidates, "id long").distinct())
    some = rows.where("n > 0").join(found, "id")
    verified = _cells(some, similarity).groupBy("band", "i", "j").applyInPandas(verify, "a long, b long")
    return components(verified.unionByName(_short_links(rows, similarity)))


def _common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many members of `one` each of the sorted sets holds."""
    flat = np.concatenate(many)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    hit = one[at] == flat
    ends = np.cumsum([len(m) for m in many])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id stays (nulls last, then by text hash).

    Equal texts are one node: rows are grouped by the text itself, and its hash only deals them.  Copies fold into one row while they are still
    spread over the tasks.  Texts without a word are all alike and form one group.  Of rows equal in every column one stays.  Null, empty and very
    long texts count like others; other columns go along whatever their names; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    blank = ~F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    same = F.when(blank, F.lit("")).otherwise(F.col("text"))
    # a text goes along once, as the key; only one without a word is kept beside it
    row = F.struct(*[(F.when(blank, F.col(c)) if c == "text" else F.col(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    tie = F.xxhash64(*[F.col(c) for c in docs.columns])
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), tie.alias("r"))
    kept = docs.select(same.alias("__text"), order.alias("__order"), row.alias("__row")).groupBy(F.xxhash64("__text").alias("__h"), "__text")
    kept = kept.agg(F.min(F.struct("__order", "__row")).alias("__first"))
    # a number of its own for every text, fixed by being written
    first = cut(kept.select(F.monotonically_increasing_id().alias("__node"), "__first.__order", "__text", "__first.__row"))
    nodes = first.select("__node", "__order")
    groups = near_groups(first.select(F.col("__node").alias("id"), F.col("__text").alias("text")), k, similarity)
    best = groups.join(nodes, groups["node"] == nodes["__node"]).groupBy("root").agg(F.min("__order").alias("o"))
    of_root = groups.select("root").distinct().join(nodes, F.col("root") == nodes["__node"]).select("root", F.col("__order").alias("o"))
    best = best.unionByName(of_root).groupBy("root").agg(F.min("o").alias("o"))
    members = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    gone = members.join(best, "root").join(nodes, F.col("node") == F.col("__node")).where(F.col("o") != F.col("__order")).select(F.col("node").alias("__node"))
    back = [F.when(F.col("__text") == "", F.col(f"__row.c{i}")).otherwise(F.col("__text")) if c == "text" else F.col(f"__row.c{i}") for i, c in enumerate(docs.columns)]
    return first.join(gone, "__node", "left_anti").select(*[v.alias(c) for v, c in zip(back, docs.columns)])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, links at three or fewer differing bits."""
    out = dedup_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
