"""Flow features, pattern adaptation and scores over a live packet stream.

State is kept per key in the RocksDB store, which `use_rocksdb` selects. A key that is idle for longer than a limit of event
time starts afresh, however its packets fall into micro-batches; a timer frees its state once the watermark shows that no
packet can continue it. Within a micro-batch the packets of a key are taken in `seq` order; each series keeps its last 49
values, so a batch is computed with array operations over tail and new values.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from weir.operators import profiles as P
from weir.operators.flows import FEATURES, FLOW, SLOTS
from weir.operators.graph import build_event_message

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000

_SERIES = ("rtt", "query_rate", "byte_rate", "inter_query", "updown_ratio", "inflight_packets", "inflight_bytes",
           "forward_length", "backward_length")
_RANGED = ("inter_query", "inflight_packets", "inflight_bytes", "forward_length", "backward_length")
_WHOLE = {"rtt", "inter_query", "inflight_packets", "inflight_bytes", "forward_length", "backward_length"}
_COUNTERS = ("flow_start", "last_query", "last_response", "bytes_sent", "bytes_received", "inflight_packets", "inflight_bytes")
_STATE = "tails array<array<double>>, lows array<double>, highs array<double>, counters array<bigint>, ports array<bigint>, uses array<bigint>"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _cut(x: np.ndarray) -> np.ndarray:
    return np.trunc(np.round(x, 6)).astype(np.int64)


def _frames(tail: list, new: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over the last 50 slots after each new value; index 0 is the state before them."""
    x = np.concatenate([np.zeros(SLOTS - len(tail)), np.asarray(tail, dtype=float), new])
    frames = np.lib.stride_tricks.sliding_window_view(x, SLOTS)
    wide = np.longdouble if whole else float
    total, squares = frames.sum(axis=1, dtype=wide), (frames.astype(wide) ** 2).sum(axis=1)
    root = np.sqrt(np.maximum(SLOTS * squares - total * total, 0).astype(float)) / SLOTS
    mean = (total / SLOTS).astype(float)
    return (np.trunc(mean), np.trunc(root)) if whole else (_cut(mean), _cut(root))


class _Ports:
    """Uses of the highest ports seen, at most 50; a port that falls out can never come back."""

    def __init__(self, ports: Sequence[int], uses: Sequence[int]):
        self.ports, self.uses = list(ports), list(uses)
        self.total, self.squares = sum(self.uses), sum(u * u for u in self.uses)

    def add(self, port: int) -> None:
        i = bisect.bisect_left(self.ports, port)
        if i < len(self.ports) and self.ports[i] == port:
            self.squares += 2 * self.uses[i] + 1
            self.uses[i] += 1
            self.total += 1
            return
        if len(self.ports) == SLOTS:
            if i == 0:
                return
            gone = self.uses.pop(0)
            self.ports.pop(0)
            self.total, self.squares, i = self.total - gone, self.squares - gone * gone, i - 1
        self.ports.insert(i, port)
        self.uses.insert(i, 1)
        self.total += 1
        self.squares += 1


def _before(values: np.ndarray, start: int) -> np.ndarray:
    """Largest value of earlier rows, or the start."""
    return np.maximum.accumulate(np.concatenate([[start], values]))[:-1]


_NEVER = int(np.iinfo(np.int64).min)


def _elapsed(t: np.ndarray, last: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Seconds since the last event, or since the flow began; a clock that steps back counts as no time passed."""
    return np.maximum(0, t - np.where(last == _NEVER, starts, last))


def advance(state: tuple | None, pdf: pd.DataFrame) -> tuple[np.ndarray, tuple]:
    """Features of the new packets of one flow, in `seq` order, and the flow's next state."""
    t, length = pdf["t"].to_numpy(np.int64), pdf["len"].to_numpy(np.int64)
    out = (pdf["direction"] == "OUT").to_numpy()
    if state is None:
        tails, lows, highs = [[] for _ in _SERIES], [None] * len(_RANGED), [None] * len(_RANGED)
        counters, ports, uses = [int(t[0]), _NEVER, _NEVER, 0, 0, 0, 0], [], []
    else:
        tails, lows, highs, counters, ports, uses = state
    start, last_q, last_r, sent, received, open_p, open_b = (int(c) for c in counters)
    starts = np.minimum.accumulate(np.concatenate([[start], t]))[1:]
    since_q = _elapsed(t, _before(np.where(out, t, _NEVER), last_q), starts)
    since_r = _elapsed(t, _before(np.where(out, _NEVER, t), last_r), starts)
    sent_now = sent + np.cumsum(np.where(out, length, 0))
    received_now = received + np.cumsum(np.where(out, 0, length))
    packets = open_p + np.cumsum(np.where(out, 1, -1))
    balance = open_b + np.cumsum(np.where(out, length, -length))
    every = np.ones(len(t), dtype=bool)
    pushed = {
        "rtt": (~out, since_q), "query_rate": (out, 2.0 / (1 + since_q)), "byte_rate": (every, 1000.0 * length / (1 + since_q)),
        "inter_query": (out, since_r), "updown_ratio": (out, (1.0 + sent_now) / (1 + received_now)),
        "inflight_packets": (every, packets), "inflight_bytes": (every, balance),
        "forward_length": (out & (length > 0), length), "backward_length": (~out & (length > 0), length),
    }
    cols, new_tails, new_lows, new_highs = {}, [], [], []
    for s, tail in zip(_SERIES, tails):
        mask, value = pushed[s]
        new = value[mask].astype(float)
        at = np.cumsum(mask)  # how many values of the series each packet has seen
        mean, std = _frames(tail, new, s in _WHOLE)
        cols[f"{s}_mean"], cols[f"{s}_std"] = mean[at], std[at]
        new_tails.append(([*tail, *new.tolist()])[-SLOTS:])
        if s in _RANGED:
            i = _RANGED.index(s)
            low = np.minimum.accumulate(np.concatenate([[np.inf if lows[i] is None else lows[i]], new]))
            high = np.maximum.accumulate(np.concatenate([[-np.inf if highs[i] is None else highs[i]], new]))
            cols[f"{s}_min"] = np.where(np.isinf(low[at]), 0, low[at])
            cols[f"{s}_max"] = np.where(np.isinf(high[at]), 0, high[at])
            new_lows.append(None if np.isinf(low[-1]) else float(low[-1]))
            new_highs.append(None if np.isinf(high[-1]) else float(high[-1]))
    held, totals, squares = _Ports(ports, uses), [], []
    for is_out, port in zip(out, pdf["src_port"]):
        if is_out:
            held.add(int(port))
        totals.append(held.total)
        squares.append(held.squares)
    c, q = np.array(totals, dtype=float), np.array(squares, dtype=float)
    cols["port_reuse_mean"], cols["port_reuse_std"] = np.trunc(c / SLOTS), np.trunc(np.sqrt(SLOTS * q - c * c) / SLOTS)
    features = np.stack([cols[f] for f in FEATURES], axis=1).astype(float) + 0.0  # no negative zeros
    q_times, r_times = t[out], t[~out]
    counters = [int(starts[-1]), max(last_q, int(q_times.max())) if len(q_times) else last_q,
                max(last_r, int(r_times.max())) if len(r_times) else last_r,
                int(sent_now[-1]), int(received_now[-1]), int(packets[-1]), int(balance[-1])]
    return features, (new_tails, new_lows, new_highs, counters, held.ports, held.uses)


def _ordered(rows: Iterator[pd.DataFrame], by: str = "seq") -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def _visits(t: np.ndarray, last: int | None, idle: int) -> list[tuple[int, int, bool]]:
    """(first, past the last, afresh) of the runs of packets that are no more than `idle` seconds after all before them."""
    before = _before(t, _NEVER if last is None else last)
    fresh = t - np.where(before == _NEVER, t, before) > idle
    fresh[0] = fresh[0] or last is None
    cuts = sorted({0, *np.flatnonzero(fresh).tolist(), len(t)})
    return [(a, b, bool(fresh[a])) for a, b in zip(cuts, cuts[1:])]


class _Idle(StatefulProcessor):
    """A value per key, and a timer for the time from which no packet can continue it."""

    schema: str

    def __init__(self, idle_ms: int):
        self.idle_ms, self.idle = idle_ms, idle_ms // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", f"last bigint, {self.schema}")

    def keep(self, last: int, state: tuple) -> None:
        self.held.update((last, *state))
        self.handle.registerTimer(self._end(last))

    def _end(self, last: int) -> int:
        return last * 1000 + self.idle_ms + 1000  # packets are told apart by whole seconds

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self._end(self.held.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()  # else the key was seen again, and has a later timer
        return iter([])

    def close(self) -> None:
        pass


class _FlowProcessor(_Idle):
    schema = _STATE

    def __init__(self, idle_ms: int, columns: list[str]):
        super().__init__(idle_ms)
        self.columns = columns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, (last, *state) = _ordered(rows), self.held.get() if self.held.exists() else (None,)
        t, features = pdf["t"].to_numpy(np.int64), []
        for a, b, fresh in _visits(t, last, self.idle):
            part, state = advance(None if fresh else tuple(state), pdf.iloc[a:b])
            features.extend(part)
        self.keep(int(max(t.max(), _NEVER if last is None else last)), state)
        yield pdf[self.columns].assign(features=features)


def stream_flow_features(packets: DataFrame, idle_ms: int = DAY_MS, watermark: str = "10 minutes") -> DataFrame:
    """The 26 features of every packet of a stream, as `features`. A flow without packets for more than `idle_ms` of event time,
    in whole seconds, starts afresh. Packets behind the watermark are left out (`split_late` keeps them as a table)."""
    use_rocksdb(packets.sparkSession)
    columns = packets.columns
    schema = StructType(packets.schema.fields[:]).add("features", ArrayType(DoubleType()))
    timed = packets.withWatermark("ts", watermark).withColumn("t", F.unix_seconds("ts"))
    return timed.groupBy(*FLOW).transformWithStateInPandas(
        statefulProcessor=_FlowProcessor(idle_ms, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_score(packets: DataFrame, profile: P.Profile, mode: str | P.Policy = "STRICT", idle_ms: int = DAY_MS,
                 reduce=None) -> DataFrame:
    """Features, nearest centroid, score and verdict of every packet of a stream."""
    scored = stream_flow_features(packets, idle_ms)
    if reduce is not None:
        scored = scored.withColumn("features", reduce(F.col("features")))
    return P.verdict(P.classify(scored, profile), mode)


def stream_score_feed(scored: DataFrame, checkpoint: str, sink: str = "text", trigger: dict | None = None,
                      **options) -> StreamingQuery:
    """Event messages of scored packets to a file, memory or message-queue sink."""
    ready = scored.withColumns({"remote_ip": F.col("server_ip"), "rname": F.coalesce("rname", F.lit(".dilavni"))}
                               if "rname" in scored.columns else
                               {"remote_ip": F.col("server_ip"), "rname": F.lit(".dilavni")})
    feed = build_event_message(ready).select(F.col("message").alias("value"))
    return (feed.writeStream.format(sink).option("checkpointLocation", checkpoint).options(**options)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


class _AdaptProcessor(_Idle):
    schema = "level int, uniq int"

    def __init__(self, idle_ms: int, code: str, initial: tuple[int, int, int], columns: list[str]):
        super().__init__(idle_ms)
        self.code, self.initial, self.columns = code, initial, columns

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, (last, *held) = _ordered(rows), self.held.get() if self.held.exists() else (None,)
        t, codes, levels, uniqs = pdf["t"].to_numpy(np.int64), pdf[self.code].to_numpy(), [], []
        code, level, uniq = self.initial
        for a, b, fresh in _visits(t, last, self.idle):
            level, uniq = self.initial[1:] if fresh else held
            for c in codes[a:b]:
                if c == code:
                    uniq = (uniq | (uniq + 1)) % 4
                elif level >= 4:
                    level, uniq = level - 1, (uniq - 1) % 4
                levels.append(level)
                uniqs.append(uniq)
            held = level, uniq
        self.keep(int(max(t.max(), _NEVER if last is None else last)), (level, uniq))
        yield pdf[self.columns].assign(held_range=levels, held_uniqueness=uniqs)


def stream_adapt_patterns(patterns: DataFrame, by: Sequence[str] = FLOW, code: str = "code", initial_code: int = 0, initial_range: int = 0,
                          initial_uniqueness: int = 0, idle_ms: int = DAY_MS, watermark: str = "10 minutes") -> DataFrame:
    """Pattern hysteresis per key over a stream; a key that is idle for more than `idle_ms` of event time starts afresh."""
    use_rocksdb(patterns.sparkSession)
    schema = StructType(patterns.schema.fields[:]).add("held_range", IntegerType()).add("held_uniqueness", IntegerType())
    processor = _AdaptProcessor(idle_ms, code, (initial_code, initial_range, initial_uniqueness), patterns.columns)
    timed = patterns.withWatermark("ts", watermark).withColumn("t", F.unix_seconds("ts"))
    return timed.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
