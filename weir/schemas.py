"""Schemas of the fact tables."""

from __future__ import annotations

PACKETS = "ts timestamp, seq long, direction string, iface string, captured_len int, payload binary"
RECORD = "struct<name: string, rtype: int, rclass: int, ttl: bigint, rdlength: int, rdata: binary>"
SECTIONS = ("questions", "answers", "authority", "additional")
MESSAGE = ("id int, flags int, qdcount int, ancount int, nscount int, arcount int, opt_flags bigint, "
           + ", ".join(f"{s} array<{RECORD}>" for s in SECTIONS))
SAMPLES = "row_id long, features array<double>, source string, label string"
HOST_EVENTS = ("ts timestamp, seq long, code string, name string, cause string, vec array<double>, agg_col int")
EVENT_WIDTH = 6
