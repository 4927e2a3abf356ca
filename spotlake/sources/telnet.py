"""Lines from telnet nodes: option bytes, login, reconnects, and a Spark streaming source over them."""

from __future__ import annotations

import math
import queue
import socket
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

# What a node asks for before it takes a call, and the prompts it may go on with.
CALL_CUES = ("login", "call", "enter your", "your call")
PASSWORD_CUE = "password"
PROMPTS = ("login:", "call:", "callsign:", "please enter your call", "password:")
PROMPT_BYTES = 30
# The pseudo-random share that stretches the delay of an attempt is |sin(attempt * 7.3)|.
JITTER_STEP = 7.3
# Telnet command bytes.
IAC, DONT, DO, WONT, WILL, SB, SE = 255, 254, 253, 252, 251, 250, 240


def strip_options(raw: bytes) -> tuple[bytes, list[bytes]]:
    """Text without telnet commands, and a refusal for each request.  A lone command byte at the end stays; cut commands go."""
    out, replies, rest = bytearray(), [], raw
    while rest:
        text, mark, after = rest.partition(bytes([IAC]))
        out += text
        if not mark:
            break
        if not after:
            out.append(IAC)
            break
        command = after[0]
        if command == IAC:
            out.append(IAC)
            rest = after[1:]
        elif command in (DO, DONT, WILL, WONT):
            if command == DO and len(after) > 1:
                replies.append(bytes([IAC, WONT, after[1]]))
            rest = after[2:]
        elif command == SB:
            rest = after[1:].partition(bytes([IAC, SE]))[2]
        else:
            rest = after[1:]
    return bytes(out), replies


def decode(raw: bytes) -> str:
    return raw.decode("latin-1")


@dataclass
class Backoff:
    """Delays that double up to a most, each stretched by a fixed pseudo-random share."""

    initial: float = 2.0
    most: float = 120.0
    multiplier: float = 2.0
    jitter: float = 0.25
    attempt: int = 0
    _now: float | None = None

    def next_delay(self) -> float:
        self.attempt += 1
        delay = self.initial if self._now is None else self._now
        self._now = min(delay * self.multiplier, self.most)
        return min(delay * (1 + abs(math.sin(self.attempt * JITTER_STEP)) * max(self.jitter, 0.0)), self.most)

    def reset(self) -> None:
        self.attempt, self._now = 0, None


class SourceFailed(Exception):
    """A connection that ended other than by its peer's wish."""


@dataclass
class Node:
    host: str
    port: int
    callsign: str
    source_id: str
    password: str | None = None
    policy: str = "Auto"
    login_timeout: float = 30.0
    idle_timeout: float = 300.0
    backoff: Backoff = field(default_factory=Backoff)


def is_prompt(line: str) -> bool:
    low = line.rstrip().lower()
    return any(x in low for x in PROMPTS) or (low.endswith(">") and len(line.rstrip().encode()) < PROMPT_BYTES)


class Login:
    """What to answer to the lines before the feed; `done` after the first line that is no prompt, which is not passed on."""

    def __init__(self, node: Node):
        self.node, self.named, self.asked, self.done = node, False, False, False

    def answer(self, line: str) -> str | None:
        low = line.lower()
        if not self.named and any(x in low for x in CALL_CUES):
            self.named = True
            return self.node.callsign
        if self.named and not self.asked and PASSWORD_CUE in low:
            self.asked = True
            return self.node.password
        self.done = self.named and not is_prompt(line)
        return None


def read_lines(node: Node, sock: socket.socket) -> Iterator[str]:
    """The feed's lines after the login, until the peer closes; what is left without a newline then is a line, too."""

    def text_of(raw: bytes) -> str:
        text, replies = strip_options(raw)
        for r in replies:
            sock.sendall(r)
        return decode(text).rstrip("\r\n")

    login, held, deadline = Login(node), b"", time.monotonic() + node.login_timeout
    while True:
        sock.settimeout(max(0.01, deadline - time.monotonic()) if not login.done else node.idle_timeout)
        try:
            got = sock.recv(65536)
        except TimeoutError as e:
            raise SourceFailed("login timeout" if not login.done else "inactivity timeout") from e
        if not got:
            if not login.done:
                raise SourceFailed("connection closed during login")
            if held:
                try:
                    line = text_of(held)
                except OSError:  # nobody is there to be answered
                    line = decode(strip_options(held)[0]).rstrip("\r\n")
                if line:
                    yield line
            return
        *whole, held = (held + got).split(b"\n")
        for raw in whole:
            line = text_of(raw)
            if login.done:
                if line:
                    yield line
                continue
            reply = login.answer(line)
            if reply is not None:
                sock.sendall(f"{reply}\r\n".encode("latin-1"))


def supervised(node: Node, stop: Callable[[], bool], connect=None, sleep=time.sleep) -> Iterator[tuple[str, str | int | None]]:
    """("line", text) and ("status", state) for ever: reconnects with growing delays, at once after a clean end."""
    connect = connect or (lambda n: socket.create_connection((n.host, n.port), timeout=n.login_timeout))
    while not stop():
        yield "status", "Connecting"
        try:
            with connect(node) as sock:
                yield "status", "Connected"
                for line in read_lines(node, sock):
                    yield "line", line
                    if stop():
                        break
            node.backoff.reset()
            if not stop():
                yield "status", "Reconnecting 1"
                sleep(1.0)
        except (OSError, SourceFailed) as e:
            delay = node.backoff.next_delay()
            yield "status", f"Reconnecting {node.backoff.attempt}"
            yield "status", f"Failed {e}"
            sleep(delay)
    yield "status", "Shutdown"


class SpotLines(DataSource):
    """spark.readStream.format("spotlines"): options host, port, callsign, source_id, password, policy, batch_seconds, capacity, idle_seconds,
    retry_seconds.  Lines carry the node's policy, what the source says of itself the policy `Status`."""

    @classmethod
    def name(cls) -> str:
        return "spotlines"

    def schema(self) -> str:
        return "source_id string, seq bigint, t_us bigint, value string, originator_policy string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return SpotReader(self.options)


class SpotReader(SimpleDataSourceStreamReader):
    """A thread keeps the connection up and reads on through silence; a batch takes what has come within batch_seconds.

    The offset is the number of rows so far.  Between thread and batches lies a queue of `capacity` rows: when it is full the thread stops reading,
    and the node is held back by the connection itself.  A node has no past, so a restarted query goes on from now.
    """

    def __init__(self, options):
        o = dict(options)
        backoff = Backoff(initial=float(o.get("retry_seconds", "2")))
        self.node = Node(o["host"], int(o["port"]), o.get("callsign", "N0CALL"), o.get("source_id", o["host"]), o.get("password"), o.get("policy", "Auto"), idle_timeout=float(o.get("idle_seconds", "300")), backoff=backoff)
        self.wait, self.capacity = float(o.get("batch_seconds", "1")), int(o.get("capacity", "256"))
        self.rows: queue.Queue | None = None
        self.held: dict[int, tuple] = {}
        self.stopped = False

    def initialOffset(self) -> dict:
        return {"n": 0}

    def stop(self) -> None:
        self.stopped = True

    def _run(self) -> None:
        for kind, what in supervised(self.node, lambda: self.stopped):
            policy = self.node.policy if kind == "line" else "Status"
            self.rows.put((time.time_ns() // 1000, what, policy))

    def read(self, start: dict):
        if self.rows is None:
            self.rows = queue.Queue(self.capacity)
            threading.Thread(target=self._run, daemon=True).start()
        n, out, until = start["n"], [], time.monotonic() + self.wait
        while len(out) < 16 * self.capacity and (left := until - time.monotonic()) > 0:
            try:
                t_us, what, policy = self.rows.get(timeout=left)
            except queue.Empty:
                break
            row = (self.node.source_id, n, t_us, what, policy)
            self.held[n] = row
            out.append(row)
            n += 1
        return iter(out), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.held[i] for i in range(start["n"], end["n"]) if i in self.held])

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if k >= end["n"]}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SpotLines)
