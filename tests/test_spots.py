"""The spot engine: lines, rules, sequences, sources, and the stream against the batch."""

import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from spotlake import queries
from spotlake.functions import lines, scalar
from spotlake.operators import lookup, observations, pipeline, quality, serial
from spotlake.operators.serial import Corroboration, SerialFeed
from spotlake.operators.state import SpotMachine
from spotlake.plans.config import AggregatorConfig, ConfigError, Content, Dedupe, FilterConfig, Patterns, Rf, SkimmerMetrics, SkimmerQuality, from_json, replace, to_json
from spotlake.plans.patterns import compile_set, glob, regex
from spotlake.plans.predicate import drop_reason
from spotlake.sources import files, telnet
from spotlake.streaming.feed import LINE, FeedBuilder

S = 1_000_000
LINES = [
    ("DX de W1AW:     14025.0  JA1ABC  CW 15 dB  22 WPM  CQ  1830Z", ("Spot", "W1AW", "JA1ABC", 14_025_000, "CW 15 dB  22 WPM  CQ", 1110)),
    ("dx de K1-#: 25.5 25 hello 1230", ("Spot", "K1-#", "25", 25_500, ".5 25 hello", 750)),
    ("DX de A: -1.0 X 9999Z", ("Spot", "A", "X", 1_000, "9999Z", None)),
    ("DX de A: 14025.1234 K1 \u00e91230", ("Spot", "A", "K1", 14_025_123, "\u00e91230", None)),
    ("DX de A: 14025 K1 1830Z JA", ("Spot", "A", "K1", 14_025_000, "1830Z JA", None)),
    ("DX de A: 99999999999999999999 K1", ("Unknown", None, None, None, None, None)),
    ("DX de : 1 K", ("Unknown", None, None, None, None, None)),
    ("To ALL de W1AW: hi", ("Announce", None, None, None, None, None)),
    ("WCY de DK0WCY-1 <14>", ("Propagation", None, None, None, None, None)),
    ("Please enter your call", ("Prompt", None, None, None, None, None)),
    ("", ("Unknown", None, None, None, None, None)),
    (None, ("Unknown", None, None, None, None, None)),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(LINES)], "i int, value string")
    got = lines.parse_lines(df).orderBy("i").select("kind", "spotter_call", "dx_call", "freq_hz", "comment", "utc_minute").collect()
    assert [tuple(r) for r in got] == [w for _, w in LINES]


def test_calls(spark):
    df = spark.createDataFrame([("ea8/k1abc/p",), ("K1ABC",), ("vp2e/k1",)], "c string")
    got = df.select(scalar.normalize_callsign(F.col("c"), portable_policy="StripCommonSuffixes"), scalar.normalize_callsign(F.col("c"), portable_policy="StripAllAfterSlash"), scalar.base_callsign(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("EA8/K1ABC", "EA8/K1ABC", "k1abc"), ("K1ABC", "K1ABC", "K1ABC"), ("VP2E/K1", "VP2E", "vp2e")]


def test_patterns():
    assert compile_set(Patterns()) is None
    for bad in ("[a", "{a,b"):
        with pytest.raises(ConfigError):
            glob(bad)
    for bad in ("(?=x)", "(a)\\1", "("):
        with pytest.raises(ConfigError):
            regex(bad)


def test_settings():
    c = from_json('{"skimmer": {"snr_db": [80, 10]}, "enrichment": {"membership": [{"Require": "club"}]}}')
    assert c.compiled().skimmer.snr_db == (10, 80) and c.max_age_secs == 900 and from_json(to_json(c)) == c and from_json("{}") == FilterConfig()
    with pytest.raises(ConfigError):
        FilterConfig(max_age_secs=0).compiled()
    with pytest.raises(ConfigError):
        FilterConfig(rf=Rf(freq_deny_hz=((2, 1),))).compiled()
    assert replace(AggregatorConfig(), dedupe__emit_updates=True).dedupe.emit_updates


def test_missing_fields_follow_the_policy(spark):
    row = observations.view(spark.sql("select 0L t_us, 14025000L freq_hz, 'B20' band, 'CW' mode, 'K1' dx_call_norm, 'A' spotter_call_norm, cast(null as string) source_id, 'Skimmer' originator_kind, cast(null as string) comment, cast(null as struct<snr_db:tinyint,wpm:int,is_cq:boolean,mode:string>) skimmer_fields"))
    rules = FilterConfig(skimmer=SkimmerMetrics(snr_db=(0, 9)))
    lotw = from_json('{"enrichment": {"lotw": "RequireTrue"}}')
    got = row.select(*[drop_reason(replace(r, unknown_policy=p)) for r in (rules, lotw) for p in ("Neutral", "FailClosed", "FailOpen")]).first()
    assert tuple(got) == (None, "UnknownFieldFailed", None, "UnknownFieldFailed", "UnknownFieldFailed", None)


def _row(seq, t, f, **k):
    return dict(dx_call_norm="K", band="B40", mode="CW", freq_bucket_hz=f // 200 * 200, seq=seq, t_us=t, source_id="s", originator_kind="Human", spotter_call_norm="A", dx_call="K", freq_hz=f, comment=None, skim_quality=None, passes=True, text_ok=True, text_cq=True, row_cq=False) | k


def _play(dedupe, steps, ttl=900):
    m = SpotMachine(AggregatorConfig(dedupe=dedupe, spot_ttl_secs=ttl))
    return [[e["kind"] for e in m.observe(_row(i, t, f))] for i, (t, f) in enumerate(steps)]


@pytest.mark.parametrize(
    ("dedupe", "steps", "want"),
    [
        (Dedupe(), [(0, 7_043_000), (1, 7_043_000)], [["New"], []]),
        (Dedupe(emit_updates=True), [(0, 7_043_000), (1, 7_043_000)], [["New"], ["Update"]]),
        (Dedupe(emit_updates=True, min_update_interval_us=30 * S), [(0, 7_043_000), (10 * S, 7_043_000), (35 * S, 7_043_000)], [["New"], [], ["Update"]]),
        (Dedupe(emit_updates=True, min_update_interval_us=10 * S), [(0, 7_043_000), (15 * S, 7_043_000), (20 * S, 7_043_000), (26 * S, 7_043_000)], [["New"], ["Update"], [], ["Update"]]),
        (Dedupe(), [(0, 7_043_000), (5 * S, 7_044_000), (10 * S, 7_043_000)], [["New"], ["Withdraw", "New"], ["Withdraw", "New"]]),
        (Dedupe(detect_qsy=False), [(0, 7_043_000), (5 * S, 7_044_000)], [["New"], ["New"]]),
        (Dedupe(), [(0, 7_043_000), (50_000, 7_044_000)], [["New"], ["New"]]),
        (Dedupe(), [(0, 7_043_000), (250_000, 7_044_000)], [["New"], ["Withdraw", "New"]]),
        (Dedupe(qsy_coalesce_us=None), [(0, 7_043_000), (1_000, 7_044_000)], [["New"], ["Withdraw", "New"]]),
        (Dedupe(), [(0, 7_043_000), (1000 * S, 7_044_000)], [["New"], ["Withdraw", "New"]]),
    ],
)
def test_sequences(dedupe, steps, want):
    assert _play(dedupe, steps) == want


def test_state_survives_the_store():
    m = SpotMachine(AggregatorConfig())
    m.observe(_row(0, 0, 7_043_000))
    again = SpotMachine(AggregatorConfig()).load(m.dump())
    assert [e["kind"] for e in again.observe(_row(1, 5 * S, 7_044_000))] == ["Withdraw", "New"]


def test_entities(spark):
    text = "Here:  05 08 NA 37.53 -97.00 5.0 K:\n  K,K5(4)[7],=W9X;\n*There: 14 27 EU 51.5 1.2 0.0 K5A:\n  K5A;\n"
    got = lookup.resolve(spark.createDataFrame([("k5abc",), ("K5Z",), ("W9X",), ("W9XY",), ("",)], "c string"), lookup.entity_table(spark, text), "c").collect()
    assert {r["c"]: (r["entity"], r["cq_zone"]) for r in got} == {"k5abc": ("There", 14), "K5Z": ("Here", 4), "W9X": ("Here", 5)}


def test_telnet_bytes():
    assert telnet.strip_options(bytes([65, 255, 253, 1, 66, 255, 255, 67, 255, 250, 9, 9, 255, 240, 68, 255])) == (b"AB\xffCD\xff", [bytes([255, 252, 1])])
    b = telnet.Backoff(jitter=0.0)
    assert [b.next_delay() for _ in range(8)] == [2, 4, 8, 16, 32, 64, 120, 120]


def test_login_over_a_socket():
    server = socket.create_server(("127.0.0.1", 0))
    heard = []

    def serve():
        con, _ = server.accept()
        with con:
            con.sendall(b"login:\r\n")
            heard.append(con.recv(99))
            con.sendall(b"password:\r\n")
            heard.append(con.recv(99))
            con.sendall("welcome\r\nDX de A: 7001.0 K1 caf\u00e9 1200Z\r\n\r\n".encode("latin-1"))

    threading.Thread(target=serve, daemon=True).start()
    node = telnet.Node("127.0.0.1", server.getsockname()[1], "N0CALL", "x", "pw", login_timeout=5, idle_timeout=5)
    with socket.create_connection((node.host, node.port)) as sock:
        assert list(telnet.read_lines(node, sock)) == ["DX de A: 7001.0 K1 caf\u00e9 1200Z"]
    assert heard == [b"N0CALL\r\n", b"pw\r\n"]


def test_content_rules_judge_the_last_comment():
    """A spot whose last comment must not pass is not let out by a row without one."""
    m = SpotMachine(AggregatorConfig())
    assert m.observe(_row(0, 0, 7_043_000, comment="UP 2", text_ok=False)) == []
    assert m.observe(_row(1, S, 7_043_000)) == [] and m.dropped == 2
    assert [e["kind"] for e in m.observe(_row(2, 2 * S, 7_043_000, comment="fine"))] == ["New"]


def test_content_rules_in_the_changelog(spark):
    raw = spark.createDataFrame([("a", 0, 0, "DX de W1AW: 7025.0 K1ABC UP 2 1200Z", "Auto"), ("b", 0, S, "DX de W2AW: 7025.0 K1ABC 1200Z", "Auto"), ("b", 1, 2 * S, "DX de W2AW: 7025.0 K1ABC tnx 1200Z", "Auto")], LINE)
    got = pipeline.changelog(observations.observations(raw), AggregatorConfig(), FilterConfig(content=Content(suppress_split_qsy=True))).where("kind = 'New'").collect()
    assert [(r["source_id"], r["seq"], r["comment"], r["revision"]) for r in got] == [("b", 1, "tnx", 3)]


def test_numbers_are_unique_within_a_source_only(spark):
    rows = [(f"s{i % 2}", i // 2, (i // 2) * 7 * S, f"DX de SK{i % 5}-1: 7025.{i % 3} K1ABC CW 10 dB 20 WPM 1200Z", "Auto") for i in range(40)]
    obs = observations.observations(spark.createDataFrame(rows, LINE))
    got = pipeline.judged(obs, AggregatorConfig(skimmer=SkimmerQuality())).collect()
    assert len(got) == 40 and len({(r["source_id"], r["seq"]) for r in got}) == 40


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_takes_one_shuffle_and_no_join(spark):
    """A busy call's reports are met in passing: none is joined with its neighbours."""
    obs = observations.observations(spark.createDataFrame([("s", 0, 0, "DX de SK1-1: 7025.0 K1ABC CW 1200Z", "Auto")], LINE))
    plan = _plan(pipeline.judged(obs, AggregatorConfig(skimmer=SkimmerQuality())))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_quality_of_all_sources_needs_no_join(spark):
    assert "Join" not in _plan(queries._same_numbers(spark, "/root/testdata/sf0.001"))


def test_tags_where_slices_meet(spark):
    """Reports at either side of every slice's edge see each other, and verifications reach as far as they stand."""
    cfg = SkimmerQuality(required_distinct_skimmers=2, lookback_secs=30)
    edge = 8 * (3 * 30 + 12) * S
    rng, rows = random.Random(3), []
    for i in range(300):
        t = edge * (1 + i // 100) + rng.randrange(-110, 110) * S
        rows.append((t, "s", i, rng.choice(["K1AB", "K1AC", "W9XX"]), rng.choice([7_043_000, 7_043_050, 7_044_000]), f"S{rng.randrange(5)}"))
    skims = spark.createDataFrame(rows, "t_us long, source_id string, seq long, dx_call_norm string, freq_hz long, spotter_call_norm string")
    got = {r["seq"]: r["skim_quality"] for r in quality.tags(skims, cfg).collect()}
    one, want, clock = Corroboration(cfg), {}, None
    for t, _, i, call, f, who in sorted(rows):
        if clock != t // (10 * S):
            clock = t // (10 * S)
            one.tick(clock * 10 * S)
        want[i] = one.tag(call, f, who, t)
    assert got == want and len(set(want.values())) == 4


# ---- a plain model of the whole feed, one row after the other ----


class Plain:
    """Spots and reports in lists, looked through from end to end for every row."""

    def __init__(self, cfg):
        self.cfg, self.spots, self.out, self.reports, self.verified, self.clock = cfg, {}, {}, [], {}, None

    def _tick(self, now):
        got = []
        for key, e in sorted(self.spots.items()):
            if (now - e["last"]) // S > self.cfg.spot_ttl_secs:
                got.append(("Withdraw", key, e["rev"]))
                del self.spots[key]
                self.out = {c: k for c, k in self.out.items() if k != key}
        q = self.cfg.skimmer
        if q:
            self.reports = [r for r in self.reports if (now - r[0]) // S <= q.lookback_secs]
            self.verified = {c: v for c, v in self.verified.items() if (now - v[0]) // S <= 2 * q.lookback_secs}
        return got

    def _tag(self, r):
        q = self.cfg.skimmer
        if len(self.reports) >= q.max_tracked:
            firsts = {}
            for t, c, *_ in self.reports:
                firsts.setdefault(c, t)
            gone = min(firsts, key=lambda c: (firsts[c], c))
            self.reports = [x for x in self.reports if x[1] != gone]
        t, call, f = r["t_us"], r["dx_call_norm"], r["freq_hz"]
        self.reports.append((t, call, f, r["spotter_call_norm"]))
        who = {w for u, c, g, w in self.reports if c == call and abs(g - f) <= q.freq_window_hz and (t - u) // S <= q.lookback_secs}
        if len(who) >= q.required_distinct_skimmers:
            old, self.verified[call] = self.verified.get(call), (t, f)
            return "Qsy" if old and abs(old[1] - f) > q.qsy_freq_hz else "Valid"
        one_off = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        return "Busted" if any(one_off(c, call) and abs(g - f) <= q.busted_freq_hz for c, (_, g) in self.verified.items()) else "Unknown"

    def observe(self, r):
        got, t, d = [], r["t_us"], self.cfg.dedupe
        grid = t // (10 * S) * 10 * S
        for now in range(grid if self.clock is None else self.clock + 10 * S, grid + 1, 10 * S):
            got += self._tick(now)
        self.clock = grid
        group = (r["dx_call_norm"], r["band"], r["mode"])
        key = (*group, r["freq_bucket_hz"])
        if key not in self.spots and len(self.spots) >= self.cfg.max_spots:
            old = min(self.spots, key=lambda k: (self.spots[k]["last"], k))
            del self.spots[old]
            self.out = {c: k for c, k in self.out.items() if k != old}
        e = self.spots.setdefault(key, {"rev": 0, "emitted": None})
        e["rev"], e["last"] = e["rev"] + 1, t
        if self.cfg.skimmer and r["originator_kind"] == "Skimmer" and self._tag(r) != "Valid":
            return got
        if e["emitted"] is not None and not (d.emit_updates and t - e["emitted"] >= (d.min_update_interval_us or 0)):
            return got
        kind = "New" if e["emitted"] is None else "Update"
        e["emitted"] = t
        if kind == "New":
            old, self.out[group] = self.out.get(group), key
            if old and old != key:
                if not 0 <= t - self.spots[old]["emitted"] < d.qsy_coalesce_us:
                    got.append(("Withdraw", old, self.spots[old]["rev"]))
                del self.spots[old]
        return got + [(kind, key, e["rev"])]


def _random_rows(rng, n):
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 50_000, S, 5 * S, 40 * S, 300 * S])
        f = rng.choice([7_043_000, 7_043_050, 7_043_400, 7_044_000])
        call, skimmer = rng.choice(["K1AB", "K1AC", "W9XX"]), rng.random() < 0.7
        out.append(_row(i, t, f, dx_call_norm=call, dx_call=call, spotter_call_norm=f"S{rng.randrange(5)}", originator_kind="Skimmer" if skimmer else "Human"))
    return out


@pytest.mark.parametrize("caps", [(50_000, 100_000), (3, 100_000), (50_000, 6), (2, 4)])
def test_serial_feed_matches_a_plain_model(caps):
    for seed in range(25):
        rng = random.Random(seed)
        quality = SkimmerQuality(required_distinct_skimmers=rng.choice([2, 3]), lookback_secs=rng.choice([30, 180]), max_tracked=caps[1]) if seed % 3 else None
        config = AggregatorConfig(dedupe=Dedupe(emit_updates=seed % 2 == 0, min_update_interval_us=rng.choice([0, 30 * S])), max_spots=caps[0], skimmer=quality)
        feed, plain = SerialFeed(config), Plain(config)
        for r in _random_rows(rng, 200):
            got = [(e["kind"], (*k, e["freq_bucket_hz"]), e["revision"]) for k, e in feed.observe(r)]
            want = plain.observe(r)
            assert sorted(got) == sorted(want), (seed, r)


def test_random_sequences_distributed(spark):
    """Joins and partitioned machines against the plain model, over some hundred rows at a time."""
    for seed in (100, 101, 102):
        rng = random.Random(seed)
        config = AggregatorConfig(dedupe=Dedupe(emit_updates=True, min_update_interval_us=30 * S), skimmer=SkimmerQuality(required_distinct_skimmers=2))
        rows = _random_rows(rng, 300)
        lines = [("s", r["seq"], r["t_us"], f"DX de {r['spotter_call_norm']}{'-1' if r['originator_kind'] == 'Skimmer' else ''}: {r['freq_hz'] / 1000:.2f} {r['dx_call']} CW 1200Z", "Auto") for r in rows]
        obs = observations.observations(spark.createDataFrame(lines, LINE))
        got = sorted((r["kind"], r["dx_call_norm"], r["freq_bucket_hz"], r["revision"]) for r in pipeline.changelog(obs, config).collect())
        plain, want = Plain(config), []
        for r in rows:
            r["spotter_call_norm"] += "-1" if r["originator_kind"] == "Skimmer" else ""
            want += plain.observe(r)
        assert got == sorted((kind, key[0], key[3], rev) for kind, key, rev in want)


@pytest.mark.parametrize(("caps", "warm_us"), [((3, 100_000), 3600 * S), ((50_000, 6), 10 * S), ((2, 4), 0), ((50_000, 100_000), 0)])
def test_slices_of_time_are_one_feed(spark, monkeypatch, caps, warm_us):
    """Slices that begin too late run again from the right state, so that caps cut as in one run; with long warm-ups none has to."""
    rng, played, play = random.Random(7), [], serial._slice_player
    monkeypatch.setattr(serial, "_slice_player", lambda *a: played.append(a) or play(*a))
    config = AggregatorConfig(dedupe=Dedupe(emit_updates=True, min_update_interval_us=30 * S), max_spots=caps[0], skimmer=SkimmerQuality(required_distinct_skimmers=2, max_tracked=caps[1]), spot_ttl_secs=120)
    rows = _random_rows(rng, 400)
    lines = [("s", r["seq"], r["t_us"], f"DX de {r['spotter_call_norm']}{'-1' if r['originator_kind'] == 'Skimmer' else ''}: {r['freq_hz'] / 1000:.2f} {r['dx_call']} CW 1200Z", "Auto") for r in rows]
    obs = observations.observations(spark.createDataFrame(lines, LINE))
    got = sorted((r["kind"], r["dx_call_norm"], r["freq_bucket_hz"], r["revision"], r["at_us"]) for r in serial.changelog(obs, config, slice_rows=40, warm_us=warm_us).collect())
    feed, want, last = SerialFeed(config), [], max(r["t_us"] for r in rows)
    for r in rows:
        r["spotter_call_norm"] += "-1" if r["originator_kind"] == "Skimmer" else ""
        want += feed.observe(r)
    want += feed.tick(last)
    assert got == sorted((e["kind"], k[0], e["freq_bucket_hz"], e["revision"], e["at_us"]) for k, e in want)
    assert len(played) == 1 if warm_us == 3600 * S else len(played) > 1


def test_what_rounds_do_not_settle_runs_in_one_task(spark):
    """A spot that never expires carries its count through all slices."""
    lines = [("s", i, i * 60 * S, "DX de W1AW: 7025.0 K1ABC 1200Z", "Auto") for i in range(60)]
    obs = observations.observations(spark.createDataFrame(lines, LINE))
    got = serial.changelog(obs, AggregatorConfig(dedupe=Dedupe(emit_updates=True)), slice_rows=5, warm_us=0).collect()
    assert sorted(r["revision"] for r in got) == list(range(1, 61))


def test_slices_hold_every_row_once():
    cells = [(c, 1 + c % 7) for c in range(200) if c % 11]
    plan = serial.slices_of(cells, 10, 25, 30)
    assert sorted(c for c, _, warm in plan if not warm) == [c for c, _ in cells] and max(s for _, s, _ in plan) > 5
    first = {s: min(c for c, t, warm in plan if t == s and not warm) for _, s, _ in plan}
    assert all(first[s] - 3 <= c < first[s] for c, s, warm in plan if warm)


def test_queues_of_a_feed_stay_small():
    """One place for each spot, not for each row."""
    feed = SerialFeed(AggregatorConfig(spot_ttl_secs=5, tick_secs=1))
    for i in range(6000):
        feed.observe(_row(i, i * S // 4, 7_043_000 + i % 40 * 400))
    assert max(len(feed.ages), len(feed.dues)) <= 2 * feed.size + 1100


def test_caps_that_shrink():
    feed = SerialFeed(AggregatorConfig(skimmer=SkimmerQuality(gate=False)))
    for i in range(10):
        feed.observe(_row(i, i * S, 7_043_000, dx_call_norm=f"K{i}", originator_kind="Skimmer"))
    feed.configure(replace(feed.cfg, max_spots=4, skimmer__max_tracked=3))
    assert sorted(k[0] for k in feed.machines) == ["K6", "K7", "K8", "K9"] and sorted(feed.quality.reports) == ["K7", "K8", "K9"]
    feed.configure(replace(feed.cfg, skimmer=None))
    assert feed.quality is None


def test_country_file_goes_by_indentation():
    text = "# made by hand\nHere:  05 08 NA 37.53 -97.00 5.0 K:\n  K,K5(4)[7],\n\t=W9X;\n# between\n\n*There: 14 27 EU 51.5 1.2 0.0 K5A:\n  K5A{EU}<1/2>~3~\nThird: 1 2 AS 0 0 0 X:\n"
    rows = {(k, exact): (e, cq, itu) for k, exact, e, _, cq, itu, *_ in lookup.parse_entities(text)}
    assert rows == {("K", False): ("Here", 5, 8), ("K5", False): ("Here", 4, 7), ("W9X", True): ("Here", 5, 8), ("K5A", False): ("There", 14, 27), ("X", False): ("Third", 1, 2)}
    assert lookup.counts(text) == (3, 4)
    for bad in ("no colon here\n", "A: 1 2 XX 0 0 0 P:\n", "A: x 2 EU 0 0 0 P:\n", "A: 300 2 EU 0 0 0 P:\n"):
        with pytest.raises(ConfigError):
            lookup.parse_entities(bad)


class Node:
    """A node on a socket of our own: what it says on each connection, in pieces with pauses; None waits for an answer."""

    def __init__(self, *talks):
        self.server, self.connections = socket.create_server(("127.0.0.1", 0)), 0
        threading.Thread(target=self._serve, args=(talks,), daemon=True).start()
        self.port = self.server.getsockname()[1]

    def _serve(self, talks):
        for talk in talks:
            con, _ = self.server.accept()
            self.connections += 1
            with con:
                for piece in talk:
                    if piece is None:
                        con.recv(99)
                    elif isinstance(piece, float):
                        time.sleep(piece)
                    else:
                        con.sendall(piece)


def test_last_line_without_a_newline():
    node = Node([b"login:\r\n", None, b"hi\r\nfirst\r\nlast"])
    with socket.create_connection(("127.0.0.1", node.port)) as sock:
        assert list(telnet.read_lines(telnet.Node("127.0.0.1", node.port, "N0CALL", "x", login_timeout=5, idle_timeout=5), sock)) == ["first", "last"]


def test_reader_lives_through_silence_and_reconnects():
    """Quiet batches keep the connection; a closed one is made again, and the source says so."""
    node = Node([b"login:\r\n", None, b"hi\r\none\r\n", 1.2, b"two\r\n"], [b"login:\r\n", None, b"hi\r\nthree\r\n", 3.0])
    reader = telnet.SpotReader({"host": "127.0.0.1", "port": str(node.port), "batch_seconds": "0.2", "source_id": "n"})
    rows, at = [], reader.initialOffset()
    for _ in range(40):
        got, end = reader.read(at)
        got = list(got)
        assert list(reader.readBetweenOffsets(at, end)) == got
        rows, at = rows + got, end
        if any(r[3] == "three" for r in rows):
            break
    reader.commit(at)
    reader.stop()
    assert [r[3] for r in rows if r[4] == "Auto"] == ["one", "two", "three"] and node.connections == 2
    assert [r[3] for r in rows if r[4] == "Status"] == ["Connecting", "Connected", "Reconnecting 1", "Connecting", "Connected"]
    assert [r[1] for r in rows] == list(range(len(rows)))


def test_supervised_backs_off():
    waits, said = [], []
    node = telnet.Node("127.0.0.1", 1, "N0CALL", "x", backoff=telnet.Backoff(jitter=0.0))

    def refuse(_):
        raise ConnectionRefusedError("no")

    for kind, what in telnet.supervised(node, lambda: len(waits) >= 3, refuse, waits.append):
        said.append(what)
    assert waits == [2, 4, 8] and said[:3] == ["Connecting", "Reconnecting 1", "Failed no"] and said[-1] == "Shutdown"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("DX de W1AW: 7025.0 K1ABC 1200Z\n\nhello\n")
    rows = files.text_lines(spark, str(tmp_path / "in"), "f", start_us=5).collect()
    assert [(r["seq"], r["t_us"], r["value"][:5]) for r in rows] == [(0, 5, "DX de"), (2, 5 + 2 * S, "hello")]
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'
    assert spark.createDataFrame([(b"caf\xe9",)], "b binary").select(files.latin1(F.col("b"))).first()[0] == "caf\u00e9"


def _feed(spark, tmp_path, config, rules=FilterConfig()):
    (tmp_path / "in").mkdir()
    seen = []
    stream = spark.readStream.schema(LINE).parquet(str(tmp_path / "in"))
    feed = FeedBuilder(spark).add_source(stream).aggregator(config).filter(rules).start(lambda df, n: seen.append([r.asDict() for r in df.collect()]), str(tmp_path / "c"))

    def send(rows):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = len(seen)
        feed.query.processAllAvailable()
        return sorted((e for batch in seen[before:] for e in batch), key=lambda e: (e["at_us"], e["seq"] or 0, e["step"]))

    return feed, send


def _told(events):
    return sorted((e["kind"], e["dx_call_norm"], e["freq_bucket_hz"], e["revision"], e["at_us"], e["comment"] or "") for e in events)


def test_stream_equals_batch(spark, tmp_path):
    """Quality, updates and rules over several batches, the state carried on; then a late row, which is taken as it comes."""
    config = AggregatorConfig(dedupe=Dedupe(emit_updates=True, min_update_interval_us=30 * S), skimmer=SkimmerQuality(required_distinct_skimmers=2), spot_ttl_secs=120)
    rng, start = random.Random(1), 1_700_000_000 * S
    lines, t = [], start
    for i in range(160):
        t += rng.choice([S, 9 * S, 60 * S])
        lines.append((f"s{i % 2}", i // 2, t, f"DX de SK{rng.randrange(4)}{rng.choice(['-1', ''])}: {rng.choice(['7043.0', '7044.0'])} K{rng.randrange(3)}AB {rng.choice(['CW 9 dB', 'UP 1', ''])} 1200Z", "Auto"))
    rules = FilterConfig(content=Content(suppress_split_qsy=True))
    want = _told(pipeline.changelog(observations.observations(spark.createDataFrame(lines, LINE)), config, rules).collect())
    feed, send = _feed(spark, tmp_path, config, rules)
    try:
        got = [e for lo in (0, 50, 110) for e in send(lines[lo : {0: 50, 50: 110, 110: 160}[lo]])]
        assert _told(got) == want and {e["kind"] for e in got} == {"New", "Update", "Withdraw"}
        late = send([("late", 0, start, "DX de HUMAN: 14025.0 W9LATE 1200Z", "Auto")])
        assert [e["kind"] for e in late if e["dx_call_norm"] == "W9LATE"] == ["New"]
        assert feed.metrics.spots_received == 161 and feed.metrics.spots_emitted == len(got) + len(late)
    finally:
        feed.shutdown()


def test_settings_change_on_a_running_feed(spark, tmp_path):
    """Setters act on the next batch and keep the state; a rule set that is not valid changes nothing."""
    feed, send = _feed(spark, tmp_path, AggregatorConfig())
    line = lambda i, khz="7025.0", call="K1ABC": ("s", i, i * 1000 * 1000, f"DX de W1AW: {khz} {call} 1200Z", "Auto")
    try:
        assert [e["kind"] for e in send([line(0)])] == ["New"]
        assert send([line(1)]) == []
        feed.set(dedupe__emit_updates=True)
        assert [(e["kind"], e["revision"]) for e in send([line(2)])] == [("Update", 3)]
        feed.update_filter(FilterConfig(freq_sanity_hz=(14_000_000, 15_000_000)))
        assert send([line(3)]) == []
        with pytest.raises(ConfigError):
            feed.update_filter(FilterConfig(rf=Rf(freq_deny_hz=((2, 1),))))
        assert send([line(4)]) == [] and feed.metrics.spots_filtered == 2
        feed.update_filter(FilterConfig())
        feed.set(max_spots=2)
        assert [e["kind"] for e in send([line(5), line(6, call="K2"), line(7, call="K3"), line(8, call="K4")])] == ["Update", "New", "New", "New"]
        # the two spots seen last are left: another K2 is new, another K4 is not
        assert feed.metrics.spot_table_size == 2
        assert [e["kind"] for e in send([line(9, call="K4"), line(10, call="K2")])] == ["Update", "New"]
        feed.update_skimmer(SkimmerQuality(required_distinct_skimmers=2))
        skim = lambda i, who: ("s", i, i * 1000 * 1000, f"DX de {who}-1: 7030.0 K9 CW 1200Z", "Auto")
        assert send([skim(11, "A")]) == []
        assert [e["skim_quality"] for e in send([skim(12, "B")])] == ["Valid"]
        feed.disable_skimmer()
        assert [e["kind"] for e in send([skim(13, "A")])] == ["Update"]
        send([("s", 14, 14 * S, "Reconnecting 1", "Status"), ("s", 15, 15 * S, "what is this", "Auto")])
        assert feed.metrics.reconnects == 1 and feed.metrics.parse_errors == 1
    finally:
        feed.shutdown()
