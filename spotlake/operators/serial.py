"""The whole feed in one order: exact where a global cap decides, which no partitioning can be.

The distributed paths keep every spot until its TTL and every report of the lookback.  A table with `max_spots`, or tracking with
`max_tracked`, drops the oldest of all, and which one that is depends on every row before.  This path streams all rows by in order, in
slices of time that run side by side and are checked against each other; a task's memory is what the caps allow.  Parsing, keys, lookups and
the rules on single rows stay distributed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import AggregatorConfig, FilterConfig, SkimmerQuality
from .observations import ORDER
from .pipeline import judged
from .quality import edits
from .state import ARROW, COLUMNS, EVENT, SpotMachine, batch_of, frame, needed, rows_in, rows_of
from .store import stored

_S = 1_000_000


def whole(us: int) -> int:
    """Whole seconds, cut towards zero."""
    return us // _S if us >= 0 else -(-us // _S)


class Corroboration:
    """Reports by call, and the last verification of each call."""

    def __init__(self, cfg: SkimmerQuality):
        self.cfg, self.reports, self.verified, self.size = cfg, defaultdict(list), {}, 0

    def _shed(self) -> None:
        """Forget the call whose first report is the oldest (ties by call)."""
        oldest = min(self.reports, key=lambda c: (self.reports[c][0][0], c), default=None)
        if oldest is not None:
            self.size -= len(self.reports.pop(oldest))

    def configure(self, cfg: SkimmerQuality) -> None:
        self.cfg = cfg
        while self.size > cfg.max_tracked:
            self._shed()

    def tick(self, now: int) -> None:
        keep = self.cfg.lookback_secs
        age = (keep + 1) * _S
        for call in list(self.reports):
            left = [r for r in self.reports[call] if now - r[0] < age]
            self.size -= len(self.reports[call]) - len(left)
            if left:
                self.reports[call] = left
            else:
                del self.reports[call]
        self.verified = {c: v for c, v in self.verified.items() if whole(now - v[0]) <= 2 * keep}

    def tag(self, call: str, freq: int, who: str, now: int) -> str:
        """Record a report and say what it is."""
        if self.size >= self.cfg.max_tracked:
            self._shed()
        self.reports[call].append((now, freq, who))
        self.size += 1
        c = self.cfg
        age = (c.lookback_secs + 1) * _S
        near = {w for t, f, w in self.reports[call] if now - t < age and abs(f - freq) <= c.freq_window_hz}
        if c.compute_valid and len(near) >= c.required_distinct_skimmers:
            before = self.verified.get(call)
            self.verified[call] = (now, freq)
            return "Qsy" if c.compute_qsy and before and abs(before[1] - freq) > c.qsy_freq_hz else "Valid"
        similar = c.compute_busted and any(v != call and abs(f - freq) <= c.busted_freq_hz and edits(call, v, c.busted_max_edit) is not None for v, (_, f) in self.verified.items())
        return "Busted" if similar else "Unknown"

    def lets_out(self, tag: str | None, kind: str) -> bool:
        c = self.cfg
        if (c.apply_only_to_skimmer and kind != "Skimmer") or not (c.enabled and c.gate):
            return True
        return (tag or "Unknown") in c.allow


class SerialFeed:
    """All keys' machines, one clock, and the caps; settings may change between rows and take effect at once."""

    def __init__(self, config: AggregatorConfig, rules: FilterConfig = FilterConfig(), origin_us: int = 0):
        self.cfg, self.rules, self.origin = config, rules, origin_us
        self.blank = SpotMachine(config, rules, origin_us)
        self.machines: dict[tuple, SpotMachine] = {}
        self.quality = Corroboration(config.skimmer) if config.skimmer else None
        self.size, self.clock = 0, None
        #: (last seen, key, bucket) and (due, key, bucket), one or more for each entry and none too late: what came after is looked up when one is taken
        self.ages: list[tuple] = []
        self.dues: list[tuple] = []

    def _queue(self) -> None:
        """Both queues anew, from what there is."""
        there = [(k, b, m, e["last"]) for k, m in self.machines.items() for b, e in m.entries.items()]
        self.ages = [(last, k, b) for k, b, _, last in there]
        self.dues = [(m._due(last), k, b) for k, b, m, last in there]
        self.size = len(there)
        heapq.heapify(self.ages)
        heapq.heapify(self.dues)

    def configure(self, config: AggregatorConfig | None = None, rules: FilterConfig | None = None) -> None:
        """New settings for what is there already: a lower cap sheds the oldest spots in silence; without skimmer settings tags end."""
        self.cfg, self.rules = config or self.cfg, rules or self.rules
        self.blank = SpotMachine(self.cfg, self.rules, self.origin)
        for m in self.machines.values():
            m.configure(self.blank.cfg, self.blank.rules)
        if config:
            if config.skimmer is None:
                self.quality = None
            elif self.quality:
                self.quality.configure(config.skimmer)
            elif config.skimmer.enabled:
                self.quality = Corroboration(config.skimmer)
            self._queue()
            while self.size > self.cfg.max_spots:
                self._shed()

    def _forget(self, key: tuple) -> None:
        if not self.machines[key].entries:
            del self.machines[key]

    def _entry(self, key: tuple, bucket: int) -> dict | None:
        machine = self.machines.get(key)
        return machine and machine.entries.get(bucket)

    def _shed(self) -> None:
        """Drop the spot seen longest ago (ties by key)."""
        while self.ages:
            last, key, bucket = self.ages[0]
            entry = self._entry(key, bucket)
            if entry is None:
                heapq.heappop(self.ages)
            elif entry["last"] != last:
                heapq.heapreplace(self.ages, (entry["last"], key, bucket))
            else:
                heapq.heappop(self.ages)
                self.machines[key].drop(bucket)
                self.size -= 1
                self._forget(key)
                return

    def tick(self, now: int) -> list[tuple[tuple, dict]]:
        """Withdrawals of all ticks up to now."""
        out, touched = [], set()
        while self.dues and self.dues[0][0] <= now:
            due, key, bucket = heapq.heappop(self.dues)
            entry = self._entry(key, bucket)
            if entry is not None:
                due = self.machines[key]._due(entry["last"])
                if due > now:
                    heapq.heappush(self.dues, (due, key, bucket))
                else:
                    touched.add(key)
        for key in sorted(touched):
            gone = self.machines[key].tick(now)
            self.size -= len(gone)
            out += [(key, e) for e in gone]
            self._forget(key)
        if self.quality:
            self.quality.tick(now)
        if max(len(self.ages), len(self.dues)) > 2 * self.size + 1000:
            # places of spots that ended otherwise
            self._queue()
        return out

    def observe(self, r: dict) -> list[tuple[tuple, dict]]:
        key, bucket, t, out = (r["dx_call_norm"], r["band"], r["mode"]), r["freq_bucket_hz"], r["t_us"], []
        grid = t - (t - self.origin) % (self.cfg.tick_secs * _S)
        if self.clock is None or grid > self.clock:
            self.clock = grid
            out += self.tick(grid)
        entry = self._entry(key, bucket)
        if entry is None and self.size >= self.cfg.max_spots:
            self._shed()
        machine = self.machines.get(key)
        if machine is None:
            machine = self.machines[key] = self.blank.fresh()
        if self.quality:
            if r["originator_kind"] == "Skimmer":
                r = r | {"skim_quality": self.quality.tag(r["dx_call_norm"], r["freq_hz"], r["spotter_call_norm"], t)}
            r = r | {"passes": r["passes"] and self.quality.lets_out(r["skim_quality"], r["originator_kind"])}
        if entry is None or t < entry["last"]:
            heapq.heappush(self.ages, (t, key, bucket))
            heapq.heappush(self.dues, (machine._due(t), key, bucket))
        before = len(machine.entries)
        out += [(key, e) for e in machine.observe(r)]
        self.size += len(machine.entries) - before
        return out

    # -- from one slice of time to the next --

    def dump(self) -> str:
        """All that later rows depend on; equal states have equal texts."""
        machines = sorted([list(k), json.loads(m.dump())] for k, m in self.machines.items())
        quality = self.quality and {"reports": {c: r for c, r in self.quality.reports.items() if r}, "verified": self.quality.verified}
        return json.dumps({"clock": self.clock, "machines": machines, "quality": quality}, sort_keys=True)

    def load(self, text: str) -> SerialFeed:
        state = json.loads(text)
        self.clock = state["clock"]
        self.machines = {tuple(k): self.blank.fresh().load(json.dumps(m)) for k, m in state["machines"]}
        if self.quality:
            self.quality.reports = defaultdict(list, state["quality"]["reports"])
            self.quality.verified = state["quality"]["verified"]
            self.quality.size = sum(map(len, self.quality.reports.values()))
        self._queue()
        return self


#: a state travels in pieces of so many characters
_PIECE = 1 << 20
SLICED = f"{EVENT}, slice int, began string, ended string, piece int, state string"


def slices_of(cells: list[tuple[int, int]], width: int, warm_us: int, rows: int) -> list[tuple[int, int, bool]]:
    """(cell, slice, warm): consecutive slices of (cell of time, its rows), of `rows` rows and twice the warm-up's time or more, each after its warm-up."""
    starts, n = [], 0
    for cell, k in sorted(cells):
        if not starts or (n >= rows and (cell - starts[-1]) * width >= 2 * warm_us):
            starts.append(cell)
            n = 0
        n += k
    out, back = [], -(-warm_us // width)
    for cell, _ in cells:
        own = bisect_right(starts, cell) - 1
        out.append((cell, own, False))
        out += [(cell, i, True) for i in range(own + 1, bisect_right(starts, cell + back))]
    return out


def changelog(obs: DataFrame, config: AggregatorConfig = AggregatorConfig(), rules: FilterConfig = FilterConfig(), entities: DataFrame | None = None, enrichment: DataFrame | None = None, origin_us: int = 0, end_us: int | None = None, slice_rows: int = 50_000, warm_us: int | None = None) -> DataFrame:
    """The changelog with `max_spots` and `max_tracked` exactly as one consumer of all rows would apply them.

    Slices of time run side by side, each from an empty feed some lifetimes earlier.  Where the state it came to is the one that the slice before
    ended with, its events are those of the one consumer; where not, it runs again from that state.  What a few rounds do not settle runs in one task.
    """
    from ..plans.config import replace

    rows = stored(needed(judged(obs, replace(config, skimmer=None), rules, entities, enrichment, origin_us)))
    n, first_us, last_us = rows.agg(F.count(F.lit(1)), F.min("t_us"), F.max("t_us")).first()
    if end_us is None:
        end_us = last_us or 0
    if n <= slice_rows:
        return rows.repartition(1).sortWithinPartitions(*ORDER).mapInArrow(_player(config, rules, origin_us, end_us), EVENT)
    if warm_us is None:
        warm_us = 4 * (config.spot_ttl_secs + config.tick_secs + 1 + (3 * config.skimmer.lookback_secs if config.skimmer else 0)) * _S
    # cells are a part of a slice of even rows, and 1,000 slices are enough
    wanted = min(1000, -(-n // slice_rows))
    width = max(1, (last_us - first_us) // (16 * wanted) + 1)
    cell = F.floor((F.col("t_us") - first_us) / width).cast("long")
    cells = [tuple(r) for r in rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1))).collect()]
    plan = slices_of(cells, width, warm_us, -(-n // wanted))
    count = max(s for _, s, _ in plan) + 1
    spark = rows.sparkSession
    places = spark.createDataFrame(plan, "cell long, slice int, warm boolean")
    dealt = rows.withColumn("cell", cell).join(F.broadcast(places), "cell").drop("cell").withColumns({"piece": F.lit(None).cast("int"), "state": F.lit(None).cast("string")})

    def play(part: DataFrame, tasks: int, last: int) -> tuple[DataFrame, dict[int, tuple[str, str]]]:
        task = F.pmod("slice", F.lit(tasks))
        order = part.repartitionById(tasks, task).sortWithinPartitions("slice", F.col("piece").asc_nulls_last(), *ORDER)
        made = stored(order.mapInArrow(_slice_player(config, rules, origin_us, end_us, last), SLICED))
        return made, {r["slice"]: (r["began"], r["ended"]) for r in made.where("piece = 0").select("slice", "began", "ended").collect()}

    made, told = play(dealt, count, count - 1)
    # the tables, and which of them holds a slice's last run
    tables, holder = [made], dict.fromkeys(range(count), 0)

    def states(wanted: dict[int, int]) -> DataFrame:
        """State pieces of the slices wanted, as the first rows of others."""
        out = None
        for i in {holder[s] for s in wanted}:
            to = spark.createDataFrame([(s, t) for s, t in wanted.items() if holder[s] == i], "slice int, target int")
            got = tables[i].where("piece is not null").join(F.broadcast(to), "slice").select(F.col("target").alias("slice"), "piece", "state", F.lit(False).alias("warm"))
            out = got if out is None else out.unionByName(got)
        return out

    rounds, spent = 0, 0
    while wrong := [i for i in range(1, count) if told[i][0] != told[i - 1][1]]:
        rounds, spent = rounds + 1, spent + len(wrong)
        if rounds <= 8 and spent <= 2 * count:
            again = dealt.where(~F.col("warm")).join(F.broadcast(spark.createDataFrame([(i,) for i in wrong], "slice int")), "slice")
            made, new = play(again.unionByName(states({i - 1: i for i in wrong}), allowMissingColumns=True), count, count - 1)
        else:
            i = wrong[0]
            rest = dealt.where(~F.col("warm") & (F.col("slice") >= i)).withColumn("slice", F.lit(i))
            made, new = play(rest.unionByName(states({i - 1: i}), allowMissingColumns=True), 1, i)
            holder, count = {s: h for s, h in holder.items() if s < i}, i + 1
        tables.append(made)
        told |= new
        holder |= dict.fromkeys(new, len(tables) - 1)
    out = None
    for i in sorted(set(holder.values())):
        valid = spark.createDataFrame([(s,) for s, h in holder.items() if h == i], "slice int")
        got = tables[i].where("piece is null").join(F.broadcast(valid), "slice", "left_semi").select(*COLUMNS)
        out = got if out is None else out.unionByName(got)
    return out


def _player(config: AggregatorConfig, rules: FilterConfig, origin_us: int, end_us: int):
    """All rows in one task."""

    def run(batches):
        feed = SerialFeed(config, rules, origin_us)
        for batch in batches:
            yield batch_of([e for r in rows_in(batch) for e in feed.observe(r)])
        yield batch_of(feed.tick(end_us))

    return run


def _slice_player(config: AggregatorConfig, rules: FilterConfig, origin_us: int, end_us: int, last: int):
    """Slices one after the other: events after the warm-up, then the state at the end in pieces, with digests of it and of the state the slice began with."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def out(number, events, began=None, ended=None, state=None):
        batch = batch_of(events)
        n = len(events)
        if state is None:
            tail = [[number] * n, [None] * n, [None] * n, [None] * n, [None] * n]
            columns = batch.columns
        else:
            pieces = [state[i : i + _PIECE] for i in range(0, len(state), _PIECE)]
            n = len(pieces)
            columns = [pa.nulls(n, f.type) for f in ARROW]
            tail = [[number] * n, [began] * n, [ended] * n, list(range(n)), pieces]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(v, k) for v, k in zip(tail, kinds)]], names=[*COLUMNS, "slice", "began", "ended", "piece", "state"])

    def run(batches):
        number = feed = began = None
        pieces: list[str] = []

        def ending():
            if number == last:
                yield out(number, feed.tick(end_us))
            text = feed.dump()
            yield out(number, [], began, digest(text), text)

        for batch in batches:
            events: list = []
            marks = zip(*[batch.column(c).to_pylist() for c in ("slice", "warm", "piece", "state")])
            for (s, warm, piece, state), r in zip(marks, rows_in(batch)):
                if s != number:
                    if feed:
                        yield out(number, events)
                        events = []
                        yield from ending()
                    number, feed, began, pieces = s, SerialFeed(config, rules, origin_us), None, []
                if piece is not None:
                    pieces.append(state)
                    continue
                if not warm and began is None:
                    if pieces:
                        feed.load("".join(pieces))
                    began = digest(feed.dump())
                got = feed.observe(r)
                if not warm:
                    events += got
            yield out(number, events)
        if feed:
            yield from ending()

    return run


def played(rows: pd.DataFrame, config: AggregatorConfig, rules: FilterConfig = FilterConfig()) -> pd.DataFrame:
    """The same over a local frame of `state.INPUT`."""
    feed = SerialFeed(config, rules)
    return frame([e for r in rows_of(rows) for e in feed.observe(r)])
