"""Independent sequential models the Spark operators are compared with (small fixtures only)."""

from __future__ import annotations

import math
import struct
from collections import defaultdict

from weir.functions import codes
from weir.operators.wire import HEADER_BYTES, INCOMPLETE, MALFORMED, MAX_NAME, MAX_POINTERS, OK, QUESTION_BYTES, RECORD_BYTES
from weir.schemas import SECTIONS


def cut(x: float) -> int:
    return math.trunc(round(x, 6))


class Ring:
    def __init__(self, n: int = 50):
        self.n, self.values, self.low, self.high = n, [0] * n, None, None

    def push(self, x):
        self.values = self.values[1:] + [x]
        self.low = x if self.low is None else min(self.low, x)
        self.high = x if self.high is None else max(self.high, x)

    def mean(self):
        return cut(sum(self.values) / self.n)

    def std(self):
        total, squares = sum(self.values), sum(v * v for v in self.values)
        if isinstance(total, int):
            return math.trunc(math.sqrt(self.n * squares - total * total) / self.n)
        return cut(math.sqrt(max(self.n * squares - total * total, 0)) / self.n)

    def bounds(self):
        return [0 if x is None else cut(x) for x in (self.high, self.low)]


class Flow:
    def __init__(self, t):
        names = "rtt rate bytes_rate iqt ratio pkts bytes fwd bwd".split()
        self.r = {n: Ring() for n in names}
        self.ports = defaultdict(int)
        self.start, self.last_q, self.last_r = t, None, None
        self.sent = self.recv = self.open_p = self.open_b = 0

    def packet(self, direction, t, length, port):
        self.start = min(self.start, t)
        dq = max(0, t - (self.start if self.last_q is None else self.last_q))
        dr = max(0, t - (self.start if self.last_r is None else self.last_r))
        if direction == "OUT":
            self.sent += length
            self.last_q = t if self.last_q is None else max(self.last_q, t)
            self.r["rate"].push(2.0 / (1 + dq))
            self.r["bytes_rate"].push(1000.0 * length / (1 + dq))
            self.r["iqt"].push(dr)
            self.r["ratio"].push((1.0 + self.sent) / (1 + self.recv))
            self.ports[port] += 1
            sign = 1
        else:
            self.recv += length
            self.r["rtt"].push(dq)
            self.r["bytes_rate"].push(1000.0 * length / (1 + dq))
            self.last_r = t if self.last_r is None else max(self.last_r, t)
            sign = -1
        self.open_p += sign
        self.open_b += sign * length
        self.r["pkts"].push(self.open_p)
        self.r["bytes"].push(self.open_b)
        if length > 0:
            self.r["fwd" if sign == 1 else "bwd"].push(length)

    def vector(self):
        r = self.r
        reuse = Ring()
        for port in sorted(self.ports):
            reuse.push(self.ports[port])

        def full(n):
            return [*r[n].bounds(), r[n].mean(), r[n].std()]

        return [r["rtt"].mean(), r["rate"].mean(), r["bytes_rate"].mean(), *full("iqt"), r["ratio"].mean(),
                *full("pkts"), *full("bytes"), *full("fwd"), reuse.mean(), reuse.std(), *full("bwd")]


def flow_vectors(packets):
    """packets: iterable of (flow, seq, direction, t, len, port) in any order -> {(flow, seq): vector}"""
    flows, out = {}, {}
    for flow, seq, direction, t, length, port in sorted(packets, key=lambda p: p[1]):
        f = flows.setdefault(flow, Flow(t))
        f.packet(direction, t, length, port)
        out[flow, seq] = f.vector()
    return out

# ---- one DNS message, byte by byte -----------------------------------------------------------------

class Bad(Exception):
    def __init__(self, code: int):
        self.code = code


_UNPRINTABLE = bytes(c for c in range(256) if not 31 < c < 127)
# Layout of the fixed fields of a question and of a record.
_QUERY, _FIXED = ">HH", ">HHIH"


def _name(buf: bytes, pos: int) -> tuple[str, int]:
    """Text of the name at pos and the position after it, following pointers."""
    if pos >= len(buf):
        raise Bad(INCOMPLETE)
    text, after, hops = bytearray(), None, 0
    while True:
        if pos >= len(buf):
            raise Bad(INCOMPLETE)
        size = buf[pos]
        if size == 0:
            pos += 1
            break
        if size >= 192:
            if pos + 1 >= len(buf):
                raise Bad(INCOMPLETE)
            target = (size & 63) << 8 | buf[pos + 1]
            hops += 1
            if target == 0 or target > len(buf) or hops > MAX_POINTERS:
                raise Bad(MALFORMED)
            after = pos + 2 if after is None else after
            pos = target
            continue
        part = buf[pos + 1: pos + 1 + size]
        if len(part) < size:
            raise Bad(INCOMPLETE)
        text += part.translate(None, _UNPRINTABLE) + b"."
        if len(text) >= MAX_NAME:
            raise Bad(MALFORMED)
        pos += 1 + size
    return text.decode("ascii") or ".", pos if after is None else after


def _number(buf: bytes, pos: int, n: int) -> int:
    if pos + n > len(buf):
        raise Bad(INCOMPLETE)
    return int.from_bytes(buf[pos: pos + n], "big")


def _question(buf: bytes, pos: int) -> tuple[dict, int]:
    if pos + QUESTION_BYTES >= len(buf):
        raise Bad(INCOMPLETE)
    name, pos = _name(buf, pos)
    if pos + 4 > len(buf):
        raise Bad(INCOMPLETE)
    kind, group = struct.unpack_from(_QUERY, buf, pos)
    return {"name": name[::-1], "rtype": kind, "rclass": group, "ttl": 0, "rdlength": 0, "rdata": None}, pos + 4


def _record(buf: bytes, pos: int) -> tuple[dict, int]:
    if pos + RECORD_BYTES > len(buf):
        raise Bad(INCOMPLETE)
    name, pos = _name(buf, pos)
    if pos + RECORD_BYTES > len(buf):
        raise Bad(INCOMPLETE)
    kind, group, ttl, length = struct.unpack_from(_FIXED, buf, pos)
    row = {"name": name, "rtype": kind, "rclass": group, "ttl": ttl, "rdlength": length}
    pos += RECORD_BYTES
    if pos + length > len(buf):
        raise Bad(INCOMPLETE)
    if kind in (codes.TYPE_CNAME, codes.TYPE_DNAME, codes.TYPE_NS):
        row["rdata"] = _name(buf, pos)[0].encode("ascii")
    else:
        row["rdata"] = bytes(buf[pos: pos + length])
    return row, pos + length


def read_message(buf: bytes) -> dict:
    """One message to header, sections, opt_flags and err_code. Never raises on bad input."""
    out = {"opt_flags": 0, "err_code": OK, **{s: [] for s in SECTIONS}}
    try:
        for i, n in enumerate(("id", "flags", "qdcount", "ancount", "nscount", "arcount")):
            out[n] = _number(buf, 2 * i, 2)
        if out["qdcount"] > 1:
            raise Bad(MALFORMED)
        pos = HEADER_BYTES
        for section, count in zip(SECTIONS, ("qdcount", "ancount", "nscount", "arcount")):
            read = _question if section == "questions" else _record
            if section != "questions" and pos >= len(buf):
                continue
            for _ in range(out[count]):
                row, pos = read(buf, pos)
                out[section].append(row)
        if pos > len(buf):
            raise Bad(MALFORMED)
        options = [r["ttl"] for r in out["additional"] if r["rtype"] == codes.TYPE_OPT]
        out["opt_flags"] = options[0] if options else 0
    except Bad as bad:
        out["err_code"] = bad.code
    return out
