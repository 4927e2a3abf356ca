"""LM scoring by a hierarchical Pitman-Yor model of words in context.

A text is a row of words and one end, which is a word without letters.  Every token is a customer, ordering its word, in the restaurant of its
context: the word before it, hashed to one of CONTEXTS restaurants (at the start of a text the end of the one before).  All context restaurants
share one parent, the restaurant of words; a table there sends one customer up.  The parent's base measure spells the word: a hierarchy of restaurants
over symbol classes (ORDER symbols deep), in which the restaurant of a context has that of the context less its oldest symbol as
parent, down to the uniform distribution.  Words that training never saw are one class, as in the base score: its probability is what the base
measure leaves beside the known words, so in every context all known words and that class sum to 1.

Gibbs sampling: a sweep takes the customers of each dish out of its restaurant and seats them again one by one, given the tables of all other dishes
as the last sweep left them: join one's own tables by customers less d each, open one by (theta + d * tables) * the parent's probability.  Levels follow from
contexts to words to symbols, each sending its tables to the next.  Between two openings the waiting time is drawn at once from its exact law, which is
a geometric one whose rate is beta distributed; that law is one and the same for every count.  After BURN sweeps SAMPLES more are kept, and predictive
probabilities are averaged over them, and rounded to STEP in their logarithm (31 decimal places at most).  Discounts are estimated from counts of counts.

Scale: a chunk of texts becomes a dictionary of its distinct words and a list of numbers.  Distinct words of chunks, with the contexts they stand in, meet by
hash bucket, hot words once a chunk.  What grows with the corpus, words and words in context, stays in buckets; the driver and the broadcast hold one
number a context restaurant and a symbol cell, tables of fixed size.  Seating depends on nothing but a bucket's words, the sweeps' tables and their
seeds, and is played again from the first sweep wherever it is needed, so a lost task repeats itself exactly.  There is a row for each chunk and
bucket, so the rows between them, not their bytes, grow with the square of the input.

Defined cases: null and blank texts are just the end token; a null id counts as empty text for the fold and is carried, of whatever type; a text counts whole, however
long; repeated rows are all scored; an empty table gives no rows; without training rows everything is the unknown class, of probability 1; equal texts get equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import buffers, counts_by, release, segments, span_hash, words
from .shared import cut, fold, table, tune

ORDER = 4
BURN, SAMPLES = 1, 2
#: Strength of the restaurants of symbols and words, and of those of contexts.
THETA, CONTEXT_THETA = 10.0, 2.0
#: Context restaurants: words that share one are one context.
CONTEXT_BITS = 20
CONTEXTS = 1 << CONTEXT_BITS
#: Customers of a dish that are drawn one by one before waiting times are.
SINGLY = 12
#: Steps of a log10 probability that a chunk gets back.
STEP = 1 / 1024
#: Text bytes of a chunk; chunks per hash bucket.
CHUNK = 5 << 20
PER_BUCKET = 3
_SLOTS = 16
_UNIT = 1 << 50
_U = np.uint64

#: Symbol classes of bytes: letters, digits, `.`, `,`, other ASCII, the lead byte of Latin letters, other leads, and continuation bytes by
#: their low bits; then the end of a word and the context before its start.
_CLASS = np.zeros(256, np.int64)
_CLASS[:128] = 29
_CLASS[97:123] = np.arange(26)
_CLASS[48:58] = 26
_CLASS[46], _CLASS[44] = 27, 28
_CLASS[128:192] = 32 + (np.arange(128, 192) & 7)
_CLASS[192:] = 31
_CLASS[0xC3] = 30
END, START = 40, 41
SYMBOLS = 42
CELLS = SYMBOLS**ORDER
#: log of the chance of a byte within its class
_WITHIN = -np.log(np.bincount(_CLASS, minlength=SYMBOLS)[_CLASS])


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _pick(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans flat[start : start + size], joined."""
    first = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))] if len(sizes) else flat[:0]


def _hash(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return span_hash(flat, ends - sizes, ends)


# ---- spelling ----


def cells(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words joined in flat: the cell of each symbol of each word with its end, the word's number, and the words' log class terms."""
    n = len(sizes)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    sym = np.full(int(sizes.sum()) + n, END, np.int64)
    owner = np.repeat(np.arange(n), sizes + 1)
    inner = np.ones(len(sym), bool)
    inner[starts + sizes] = False
    sym[inner] = _CLASS[flat]
    at = np.arange(len(sym)) - starts[owner]
    cell = sym.copy()
    for back in range(1, ORDER):
        before = np.full(len(sym), START, np.int64)
        before[back:] = sym[:-back]
        before[at < back] = START
        cell += before * SYMBOLS**back
    term = np.bincount(owner[inner], weights=_WITHIN[flat], minlength=n) if n else np.zeros(0)
    return cell, owner, term


def spelled(flat: np.ndarray, sizes: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probability of each word's spelling."""
    cell, owner, term = cells(flat, sizes)
    return term + np.bincount(owner, weights=logp[cell], minlength=len(sizes)) if len(sizes) else term


# ---- seating ----


def seat(c: np.ndarray, opening: np.ndarray, d: float, rng, more=0.0) -> np.ndarray:
    """Tables of dishes with c customers each, who sit down one by one: with n seated at t tables the next one opens a table by the weight
    opening + more * t and joins one by n - d * t.

    With those weights the chance that the next k customers all join is the mean of (1 - v)^k over v from Beta(opening, n - d * t), so the
    number that join before one opens is geometric given v.  A dish's first few customers are cheaper to draw singly, by the same weights.
    """
    t = (c > 0).astype(np.int64)
    opening, more = np.broadcast_to(opening, c.shape), np.broadcast_to(more, c.shape)
    on = np.flatnonzero(c > 1)
    for i in range(1, SINGLY):
        if len(on) == 0:
            break
        w = opening[on] + more[on] * t[on]
        t[on] += rng.random(len(on)) * (i - d * t[on] + w) < w
        on = on[c[on] > i + 1]
    n = np.full(len(on), float(SINGLY))
    while len(on):
        tables = t[on]
        v = rng.beta(np.maximum(opening[on] + more[on] * tables, 1e-300), n - d * tables)
        with np.errstate(divide="ignore", over="ignore"):
            joined = np.floor(np.log(1 - rng.random(len(on))) / np.log1p(-np.minimum(v, 1 - 1e-16)))
        joined[np.isnan(joined)] = np.inf
        n = n + joined + 1
        opened = n <= c[on]
        on, n = on[opened], n[opened]
        t[on] += 1
        left = n < c[on]
        on, n = on[left], n[left]
    return t


def discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 else 0.5


class Spelling:
    """The restaurants of symbols, dense by cell; level k has contexts of k - 1 symbols."""

    def __init__(self):
        self.p = [np.full(SYMBOLS**k, 1 / SYMBOLS) for k in range(ORDER + 1)]
        self.tables = [np.zeros(SYMBOLS ** (k - 1)) if k else None for k in range(ORDER + 1)]

    def sweep(self, customers: np.ndarray, rng) -> None:
        """Seat the customers of the deepest level, their tables at the parent, and so on; then renew the probabilities from the root."""
        kept, c = [], customers
        for k in range(ORDER, 0, -1):
            at = np.flatnonzero(c)
            d = discount((c[at] == 1).sum(), (c[at] == 2).sum())
            # a cell less its oldest symbol is the parent's cell
            parent = at % SYMBOLS ** (k - 1) if k > 1 else np.zeros(len(at), np.int64)
            p0 = self.p[k - 1][parent] if k > 1 else np.full(len(at), 1 / SYMBOLS)
            t = seat(c[at], (THETA + d * np.maximum(self.tables[k][at // SYMBOLS] - 1, 0)) * p0, d, rng, d * p0)
            kept.append((k, at, c[at], t, d))
            c = np.bincount(parent, weights=t, minlength=SYMBOLS ** (k - 1)).astype(np.int64)
        for k, at, c, t, d in reversed(kept):
            context = at // SYMBOLS
            n = SYMBOLS ** (k - 1)
            total = np.bincount(context, weights=c, minlength=n)
            self.tables[k] = np.bincount(context, weights=t, minlength=n)
            up = np.tile(self.p[k - 1], SYMBOLS) if k > 1 else np.full(SYMBOLS, 1 / SYMBOLS)
            p = np.repeat((THETA + d * self.tables[k]) / (THETA + total), SYMBOLS) * up
            p[at] += (c - d * t) / (THETA + total[context])
            self.p[k] = p


# ---- chunks and their words ----


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, held_out, text) as chunks: dictionary (flat, sizes; the empty word is the end), training counts, the words' context
    restaurants, and the texts as numbers of words, each text closed by an end."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush(ids_type):
            nonlocal number
            flat = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0, *[len(x[0]) for x in held]])
            s = np.concatenate([x[1] + o for x, o in zip(held, shift)])
            e = np.concatenate([x[2] + o for x, o in zip(held, shift)])
            n = np.concatenate([x[3] for x in held]) + 1
            out = np.concatenate([x[4] for x in held])
            ids = pa.concat_arrays([x[5] for x in held])
            _, first, back = np.unique(span_hash(flat, s, e), return_index=True, return_inverse=True)
            word = np.full(int(n.sum()), len(first), np.int64)
            last = np.zeros(len(word), bool)
            last[np.cumsum(n) - 1] = True
            word[~last] = back
            times = np.bincount(word, minlength=len(first) + 1)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            num = place[word]
            trained = np.bincount(num[np.repeat(~out, n)], minlength=len(order))
            starts, w = np.append(s[first], 0)[order], np.append((e - s)[first], 0)[order]
            letters = _pick(flat, starts, w)
            cell = _restaurant(_hash(letters, w))
            num = num.astype("<u4").view(np.uint8).reshape(-1, 4)
            row = [[(part << 24) + number], [_zip(letters)], [_zip(w.astype(np.int32))], [_zip(trained.astype(np.int32))], [_zip(cell)], [[_zip(num[:, i]) for i in range(4)]], [ids.to_pylist()], [out.tolist()], [n.tolist()]]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [*kinds[:6], pa.list_(ids_type), *kinds[6:]])], names=names)

        for b in batches:
            data, off = buffers(b.column(2))
            out = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, x, o in segments(data, off, CHUNK // 4):
                d, s, e, doc = words(x, o)
                hi = lo + len(o) - 1
                held.append((d, s, e, counts_by(doc, hi - lo)[0], out[lo:hi], b.column(0).slice(lo, hi - lo)))
                size += len(d)
                if size >= CHUNK:
                    yield flush(b.column(0).type)
                    size = 0
                    release()
        if held:
            yield flush(held[0][5].type)
        release()

    names = ["chunk", "flat", "sizes", "trained", "cells", "numbers", "doc_ids", "held_out", "n"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", text).mapInArrow(run, f"chunk long, flat binary, sizes binary, trained binary, cells binary, numbers array<binary>, doc_ids array<{key}>, held_out array<boolean>, n array<long>")


def _restaurant(h: np.ndarray) -> np.ndarray:
    """The context restaurant that a word opens for the next one."""
    return (h >> _U(64 - CONTEXT_BITS)).astype(np.int32)


def _numbers(planes) -> np.ndarray:
    return np.stack([_unzip(x, np.uint8) for x in planes], axis=1).view("<u4").ravel().astype(np.int64)


def _released(f, *args):
    """f(*args), whose working memory goes back to the system."""
    out = f(*args)
    release()
    return out


def _in_context(num: np.ndarray, cell: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (word, context restaurant) of a chunk's tokens, ordered by place[word] and restaurant, and which of them each token is."""
    end = num[-1]
    before = np.concatenate([[end], num[:-1]])
    key, back = np.unique((place[num] << 32) | cell[before], return_inverse=True)
    return key >> 32, (key & 0xFFFFFFFF).astype(np.int32), back


def _requests(chunked: DataFrame, buckets: int) -> DataFrame:
    """A chunk's dictionary by hash bucket: (bucket, chunk, at: places in the dictionary, flat, sizes, and of each word in turn: how many context
    restaurants it is in, which (as differences), and how often in training)."""

    names = ["bucket", "chunk", "at", "flat", "sizes", "per", "context", "learnt"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]

    def split(chunk, flat, sizes, cell, planes, held, n):
        flat, sizes, cell, num = _unzip(flat, np.uint8), _unzip(sizes, np.int32).astype(np.int64), _unzip(cell, np.int32), _numbers(planes)
        bucket = ((_hash(flat, sizes) >> _U(20)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        word, context, back = _in_context(num, cell, place)
        learnt = np.bincount(back[np.repeat(~np.array(held, bool), n)], minlength=len(word)).astype(np.int32)
        del num, back
        starts = np.cumsum(sizes) - sizes
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        per = np.bincount(word, minlength=len(order)).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(per)])
        for k in range(buckets):
            lo, hi = int(ends[k - 1]) if k else 0, int(ends[k])
            at = order[lo:hi]
            if len(at):
                x, y = int(upto[lo]), int(upto[hi])
                row = [k, chunk, _zip(at.astype(np.int32)), _zip(_pick(flat, starts[at], sizes[at])), _zip(sizes[at].astype(np.int32)), _zip(per[lo:hi]), _zip(np.diff(context[x:y], prepend=np.int32(0))), _zip(learnt[x:y])]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from split(*[b.column(j)[i].as_py() for j in range(7)])
                release()

    rows = chunked.select("chunk", "flat", "sizes", "cells", "numbers", "held_out", "n")
    return rows.mapInArrow(run, "bucket int, chunk long, at binary, flat binary, sizes binary, per binary, context binary, learnt binary")


class Words:
    """A bucket's training words: letters, and of each in turn its context restaurants and how often it is in them."""

    def __init__(self, bucket: int, flat: np.ndarray, sizes: np.ndarray, per: np.ndarray, context: np.ndarray, c: np.ndarray):
        self.bucket, self.flat, self.sizes, self.per, self.context, self.c = int(bucket), flat, sizes, per, context, c
        self.word = np.repeat(np.arange(len(per)), per)
        self.count = np.bincount(self.word, weights=c, minlength=len(per)).astype(np.int64)
        self._letters = None

    @classmethod
    def read(cls, bucket, flat, sizes, per, context, c) -> Words:
        return cls(bucket, _unzip(flat, np.uint8), _unzip(sizes, np.int32).astype(np.int64), _unzip(per, np.int32).astype(np.int64), _unzip(context, np.int32), _unzip(c, np.int64))

    @classmethod
    def merge(cls, pdf: pd.DataFrame) -> Words:
        """Each word and each of its restaurants once, out of the chunks that have them."""
        flat = np.concatenate([_unzip(x, np.uint8) for x in pdf["flat"]])
        sizes = np.concatenate([_unzip(x, np.int32) for x in pdf["sizes"]]).astype(np.int64)
        per = np.concatenate([_unzip(x, np.int32) for x in pdf["per"]]).astype(np.int64)
        context = np.concatenate([np.cumsum(_unzip(x, np.int32), dtype=np.int64) for x in pdf["context"]])
        c = np.concatenate([_unzip(x, np.int32) for x in pdf["learnt"]]).astype(np.int64)
        _, first, back = np.unique(_hash(flat, sizes), return_index=True, return_inverse=True)
        key, at = np.unique((np.repeat(back, per) << 32) | context, return_inverse=True)
        c = np.bincount(at, weights=c, minlength=len(key)).astype(np.int64)
        key, c = key[c > 0], c[c > 0]
        known, per = np.unique(key >> 32, return_counts=True)
        starts = np.cumsum(sizes) - sizes
        first = first[known]
        return cls(pdf["bucket"].iloc[0], _pick(flat, starts[first], sizes[first]), sizes[first], per, (key & 0xFFFFFFFF).astype(np.int32), c)

    def write(self) -> dict:
        per, c = self.per, self.c
        return {
            "bucket": self.bucket, "flat": _zip(self.flat), "sizes": _zip(self.sizes.astype(np.int32)), "per": _zip(per.astype(np.int32)), "context": _zip(self.context), "c": _zip(c), "tokens": c.sum(),
            "types": len(per), "n1": (c == 1).sum(), "n2": (c == 2).sum(), "m1": (per == 1).sum(), "m2": (per == 2).sum(),
        }

    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol cells of the words, worked out once."""
        if self._letters is None:
            self._letters = cells(self.flat, self.sizes)
        return self._letters

    def spelt(self, state: dict) -> np.ndarray:
        cell, owner, term = self.letters()
        return np.exp(term + np.bincount(owner, weights=state["logp"][cell], minlength=len(self.sizes))) if len(self.sizes) else term

    def play(self, states: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After each sweep (states as packed): tables of each word in each context restaurant, customers and tables of each word in the restaurant of words."""
        t2 = np.ones(len(self.c), np.int64)
        c1, t1 = self.per, np.ones(len(self.per), np.int64)
        out = []
        for st in map(_unpack, states):
            rng = np.random.default_rng((st["seed"], self.bucket))
            base = self.spelt(st)
            p1 = (c1 - st["d1"] * t1 + (THETA + st["d1"] * st["tables"]) * base) / (THETA + st["customers"])
            here = p1[self.word]
            t2 = seat(self.c, (CONTEXT_THETA + st["d2"] * (st["t2"][self.context] - t2)) * here, st["d2"], rng, st["d2"] * here)
            c1 = np.bincount(self.word, weights=t2, minlength=len(self.per)).astype(np.int64)
            t1 = seat(c1, (THETA + st["d1"] * (st["tables"] - t1)) * base, st["d1"], rng, st["d1"] * base)
            out.append((t2, c1, t1))
        return out

    def predictive(self, seats, state: dict, after: dict):
        """A sweep's probability of words (numbers; -1 is the unknown class) in context restaurants, as a function of them and of their place among
        the words in context, or -1."""
        t2, c1, t1 = seats
        rest = (THETA + state["d1"] * after["tables"]) / (THETA + after["customers"])
        p1 = np.append((c1 - state["d1"] * t1) / (THETA + after["customers"]) + rest * self.spelt(state), rest * after["unknown"])
        own = np.append(self.c - state["d2"] * t2, 0)
        c2, t2, d2 = state["c2"], after["t2"], state["d2"]
        return lambda word, context, pair: (own[pair] + (CONTEXT_THETA + d2 * t2[context].astype(np.float64)) * p1[word]) / (CONTEXT_THETA + c2[context].astype(np.float64))


def _pack(states: list[dict]) -> list[dict]:
    """Tables compressed, for a broadcast: most of their cells are alike."""
    return [{k: (_zip(v), str(v.dtype)) if isinstance(v, np.ndarray) else v for k, v in st.items()} for st in states]


def _unpack(packed: dict) -> dict:
    return {k: _unzip(*v) if isinstance(v, tuple) else v for k, v in packed.items()}


_LEXICON = "bucket int, flat binary, sizes binary, per binary, context binary, c binary, tokens long, types long, n1 long, n2 long, m1 long, m2 long"
_WORDS = ["bucket", "flat", "sizes", "per", "context", "c"]
#: Where a sweep's sums stand: symbol cells, tables (or customers) of the context restaurants, then three totals.
_SUMS = CELLS + CONTEXTS + 3


def _sum(lexicon: DataFrame, of, states: list[dict]) -> np.ndarray:
    """What of(words, states, sums) adds to the sums (see _SUMS) for all buckets."""
    shared = lexicon.sparkSession.sparkContext.broadcast(_pack(states))

    def run(batches):
        total = np.zeros(_SUMS, np.int64)
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(len(_WORDS))]):
                of(Words.read(*row), shared.value, total)
                release()
        yield from give(enumerate(np.array_split(total, _SLOTS)))
        total = None
        release()

    def give(parts):
        for slot, x in parts:
            at = np.flatnonzero(x)
            row = (slot, len(x), _zip(at.astype(np.int32)), _zip(x[at]))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["slot", "size", "at", "x"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, size, at, x in zip(*[b.column(i).to_pylist() for i in range(4)]):
                total = held.setdefault(slot, np.zeros(size, np.int64))
                total[_unzip(at, np.int32)] += _unzip(x, np.int64)
        yield from give(held.items())
        held.clear()
        release()

    schema = "slot int, size long, at binary, x binary"
    got = lexicon.select(*_WORDS).mapInArrow(run, schema).repartition(_SLOTS, "slot").mapInArrow(add, schema).collect()
    total = np.zeros(_SUMS, np.int64)
    begin = np.cumsum([0, *[len(x) for x in np.array_split(np.zeros(_SUMS, np.int8), _SLOTS)]])
    for r in got:
        total[begin[r["slot"]] + _unzip(r["at"], np.int32)] += _unzip(r["x"], np.int64)
    shared.destroy()
    return total


def train(lexicon: DataFrame, seed: int) -> tuple[list[dict], list[dict]]:
    """(what each sweep started from, what it left), from the merged words of all buckets."""
    s = lexicon.agg(*[F.sum(c) for c in ("types", "n1", "n2", "m1", "m2")]).first()
    types = s[0] or 0

    def first(w: Words, _, total: np.ndarray) -> None:
        np.add.at(total, CELLS + w.context, w.c)

    def open_once(w: Words, _, total: np.ndarray) -> None:
        np.add.at(total, CELLS + w.context, 1)
        total[-2] += len(w.c)

    def sweep(w: Words, known: list[dict], total: np.ndarray) -> None:
        t2, _, t1 = w.play(known)[-1]
        cell, owner, _ = w.letters()
        total[:CELLS] += np.bincount(cell, weights=t1[owner], minlength=CELLS).astype(np.int64)
        np.add.at(total, CELLS + w.context, t2)
        total[-3] += t1.sum()
        total[-2] += t2.sum()
        total[-1] += int(w.spelt(_unpack(known[-1])).sum() * _UNIT)

    c2 = _sum(lexicon, first, [])[CELLS : CELLS + CONTEXTS]
    once = _sum(lexicon, open_once, [])
    spelling, rng = Spelling(), np.random.default_rng(seed)
    state = {"d1": discount(s[3] or 0, s[4] or 0), "d2": discount(s[1] or 0, s[2] or 0), "tables": float(types), "customers": float(once[-2]), "c2": c2.astype(np.float32), "t2": once[CELLS : CELLS + CONTEXTS].astype(np.float32)}
    states, left = [], []
    for i in range(BURN + SAMPLES):
        states.append(state | {"seed": seed * 1000 + i, "logp": np.log(spelling.p[ORDER]).astype(np.float32)})
        if not types:
            left.append({"tables": 0.0, "customers": 0.0, "unknown": 1.0, "t2": state["t2"]})
            continue
        total = _sum(lexicon, sweep, states)
        spelling.sweep(total[:CELLS], rng)
        state = state | {"tables": float(total[-3]), "customers": float(total[-2]), "t2": total[CELLS : CELLS + CONTEXTS].astype(np.float32)}
        left.append({k: state[k] for k in ("tables", "customers", "t2")} | {"unknown": max(1 - total[-1] / _UNIT, 1e-9)})
    return states, left


def score(docs: DataFrame, seed: int = 3) -> DataFrame:
    """docs(doc_id, held_out boolean, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row;
    the rows that are not held out are learnt from."""
    tune(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    chunked = cut(chunks(docs))
    buckets = max(1, chunked.count() // PER_BUCKET)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([Words.merge(pdf).write()])

    # made twice rather than stored: they are as large as the chunks
    requests = _requests(chunked, buckets)
    lexicon = cut(requests.select("bucket", "flat", "sizes", "per", "context", "learnt").groupBy("bucket").applyInPandas(lambda pdf: _released(merge, pdf), _LEXICON))
    s = lexicon.agg(F.sum("tokens"), F.sum("types")).first()
    total, types = s[0] or 0, s[1] or 0
    shared = sc.broadcast([_pack(x) for x in train(lexicon, seed)])
    bottom = np.log10(total + 0.1 * (types + 1))

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """For each chunk's words of a bucket their counts, for each word in context its averaged log10 probability."""
        states, left = shared.value
        w = Words.read(*known[_WORDS].iloc[0]) if len(known) else Words(0, *[np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.int32, np.int64)])
        plays = w.play(states) if len(w.per) else [(w.c, w.per, w.per)] * len(states)
        h = _hash(w.flat, w.sizes)
        order = np.argsort(h)
        pairs = (w.word << 32) | w.context
        kept = [w.predictive(seats, _unpack(st), _unpack(after)) for seats, st, after in list(zip(plays, states, left))[BURN:]]
        plays = w._letters = None
        out = []
        for bucket, chunk, at, flat, sizes, per, context in asked[["bucket", "chunk", "at", "flat", "sizes", "per", "context"]].itertuples(index=False):
            x = _hash(_unzip(flat, np.uint8), _unzip(sizes, np.int32).astype(np.int64))
            word = np.full(len(x), -1)
            if len(h):
                i = order[np.minimum(np.searchsorted(h, x, sorter=order), len(h) - 1)]
                word = np.where(h[i] == x, i, -1)
            each, context = np.repeat(word, _unzip(per, np.int32)), np.cumsum(_unzip(context, np.int32), dtype=np.int64)
            key = (each << 32) | context
            pair = np.full(len(key), -1)
            if len(pairs):
                i = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                pair = np.where((pairs[i] == key) & (each >= 0), i, -1)
            p = sum(of(each, context, pair) for of in kept) / len(kept)
            c = np.where(word >= 0, np.append(w.count, 0)[word], 0)
            out.append((bucket, chunk, at, _zip(c.astype(np.int64)), _zip(np.rint(np.maximum(np.log10(p), -31) / STEP).astype(np.int16))))
        return pd.DataFrame(out, columns=["bucket", "chunk", "at", "c", "p"])

    ask = requests.select("bucket", "chunk", "at", "flat", "sizes", "per", "context").groupBy("bucket")
    answers = ask.cogroup(lexicon.select(*_WORDS).groupBy("bucket")).applyInPandas(lambda asked, known: _released(answer, asked, known), "bucket int, chunk long, at binary, c binary, p binary")
    key = docs.schema["doc_id"].dataType.simpleString()

    def finish(text: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("bucket")
        order = np.concatenate([_unzip(x, np.int32) for x in got["at"]]).astype(np.int64)
        place, c = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        c[order] = np.concatenate([_unzip(x, np.int64) for x in got["c"]])
        p = np.concatenate([_unzip(x, np.int16) for x in got["p"]]) * STEP
        row = text.iloc[0]
        n, num = np.asarray(row["n"], np.int64), _numbers(row["numbers"])
        back = _in_context(num, _unzip(row["cells"], np.int32), place)[2]
        doc = np.repeat(np.arange(len(n)), n)
        known, b, q = (np.bincount(doc, weights=v, minlength=len(n)) for v in ((c > 0)[num], (np.log10(c + 0.1) - bottom)[num], p[back]))
        ids = list(row["doc_ids"])
        ids = pd.array(ids, "Int64") if key == "bigint" else ids
        return pd.DataFrame({"doc_id": ids, "held_out": list(row["held_out"]), "n_tokens": n, "n_known": known.astype(np.int64), "train_tokens": total, "base_score": b, "score": q})

    whole = chunked.select("chunk", "cells", "numbers", "doc_ids", "held_out", "n").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return whole.applyInPandas(lambda text, got: _released(finish, text, got), f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base by held_out."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from those whose crc32(doc_id) modulo 10 is not 0."""
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "text"))
