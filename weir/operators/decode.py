"""Captured packets to decoded headers, DNS messages and a reject table.

Headers are read with column expressions. Names and sections need a walk over the bytes of messages, which `wire` takes for all
messages of an Arrow batch together, after rejects and unread packets are filtered out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import codes
from weir.functions.bytes import bit, computed_once, u8, u16, u32
from weir.operators.wire import HEADER_BYTES, INCOMPLETE, MALFORMED, NO_MEMORY, NOT_DNS, OK, QUESTION_BYTES, UNKNOWN, Messages, parse_messages  # noqa: F401
from weir.schemas import MESSAGE, SECTIONS

UDP, TCP = 17, 6
_HEADER = "id int, flags int, qdcount int, ancount int, nscount int, arcount int, opt_flags bigint"
FLAG_BITS = {"qr": 0x8000, "aa": 0x0400, "tc": 0x0200, "rd": 0x0100, "ra": 0x0080, "ad": 0x0020, "cd": 0x0010}


# ---- IP and transport ------------------------------------------------------------------------------

def decode_ip(packets: DataFrame) -> DataFrame:
    """Add ip_hl, proto, src_ip, dst_ip, total_len; `reject_reason` is short_ip where the header is cut."""
    p = F.col("payload")
    n = F.length(p)
    packets = computed_once(packets, {"_hl": u8(p, 0).bitwiseAND(F.lit(15)) * 4})
    short = F.coalesce((n < 20) | (n < F.col("_hl")), F.lit(True))
    return computed_once(packets, {
        "reject_reason": F.when(short, "short_ip"),
        "ip_hl": F.when(~short, F.col("_hl")), "proto": F.when(~short, u8(p, 9)), "total_len": F.when(~short, u16(p, 2)),
        "src_ip": F.when(~short, u32(p, 12)), "dst_ip": F.when(~short, u32(p, 16)),
    }).drop("_hl")


def decode_transport(df: DataFrame) -> DataFrame:
    """Add ports, len (UDP length, or IP length for TCP), and offset and length of the DNS message."""
    p, hl = F.col("payload"), F.col("ip_hl")
    udp, tcp = F.col("proto") == UDP, F.col("proto") == TCP
    known = F.col("reject_reason").isNull() & (udp | tcp)
    df = computed_once(df, {"_doff": F.when(tcp, F.shiftright(u8(p, hl + 12), 4) * 4), "_ulen": F.when(udp, u16(p, hl + 4))})
    doff = F.col("_doff")
    return computed_once(df, {
        "src_port": F.when(known, u16(p, hl)).cast("int"), "dst_port": F.when(known, u16(p, hl + 2)).cast("int"),
        "len": F.when(udp, F.col("_ulen")).when(tcp, F.col("total_len")).cast("int"),
        "dns_offset": F.when(udp, hl + 8).when(tcp, hl + doff + 2).cast("int"),
        "dns_len": F.when(udp, F.col("_ulen") - 8).when(
            tcp, F.greatest(F.col("total_len") - hl - doff - 2, F.lit(0))).cast("int"),
        "reject_reason": F.coalesce("reject_reason", F.when(~(udp | tcp), "protocol")),
    }).drop("_doff", "_ulen")


def with_dpi_eligible(df: DataFrame) -> DataFrame:
    """Whether the whole message was captured and there is one."""
    captured = F.col("captured_len")
    body = F.col("dns_len") + 2
    udp = (F.col("proto") == UDP) & (F.col("len") < captured)
    tcp = (F.col("proto") == TCP) & (body > 2) & (body < captured)
    return df.withColumn("dpi_eligible", F.coalesce(F.col("reject_reason").isNull() & (udp | tcp), F.lit(False)))


def with_flow_key(df: DataFrame) -> DataFrame:
    """Client and server address by direction; the server is the remote end."""
    out = F.col("direction") == "OUT"
    return df.withColumns({"client_ip": F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")),
                           "server_ip": F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip"))})


def decode_packets(packets: DataFrame) -> DataFrame:
    return with_flow_key(with_dpi_eligible(decode_transport(decode_ip(packets))))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows."""
    return df.where(F.col("reject_reason").isNull()), df.where(F.col("reject_reason").isNotNull())


# ---- DNS header and question -----------------------------------------------------------------------

def dns_bytes() -> Column:
    return F.substring(F.col("payload"), F.col("dns_offset") + 1, F.col("dns_len"))


def decode_dns_header(df: DataFrame) -> DataFrame:
    """Add the header fields and flags; header_code is malformed for several questions, incomplete if cut."""
    df = df.withColumn("_d", dns_bytes())
    d, whole = F.col("_d"), F.length("_d") >= HEADER_BYTES
    names = ("id", "flags", "qdcount", "ancount", "nscount", "arcount")
    df = computed_once(df, {n: F.when(whole, u16(d, 2 * i)).cast("int") for i, n in enumerate(names)})
    return df.withColumns({
        **{n: bit(F.col("flags"), m) for n, m in FLAG_BITS.items()},
        "opcode": F.shiftright("flags", 11).bitwiseAND(F.lit(15)), "rcode": F.col("flags").bitwiseAND(F.lit(15)),
        "header_code": F.when(~F.coalesce(whole, F.lit(False)), INCOMPLETE).when(F.col("qdcount") > 1, MALFORMED).otherwise(OK),
    }).drop("_d")


@F.arrow_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("rtype", T.IntegerType()), T.StructField("rclass", T.IntegerType())]))
def _question(messages: pa.Array) -> pa.Array:
    """Name, type and class of the uncompressed question that follows each header; null where there is none."""
    m = Messages(messages)
    rows = np.arange(len(m.size))
    names, after, code = m.names(rows, np.full(len(rows), HEADER_BYTES), pointers=False)
    good = (code == OK) & (m.size > HEADER_BYTES + QUESTION_BYTES) & (after + 4 <= m.size)
    numbers = [pa.array(m.number(rows, np.maximum(after, 0) + k, 2).astype(np.int32)) for k in (0, 2)]
    return pa.StructArray.from_arrays([names.arrow(pa.string()), *numbers], names=["name", "rtype", "rclass"], mask=pa.array(~good))


def decode_question(df: DataFrame) -> DataFrame:
    """Add qname (labels each followed by a dot), rname, qtype and qclass of an uncompressed question.

    Only the messages' bytes go through Arrow, where the names of a batch are read together. The result is null for messages
    without a question, for names over the limit or cut short, and for compressed names, which `decode_sections` reads.
    """
    df = df.withColumn("_q", F.when(F.col("qdcount") == 1, _question(dns_bytes())))
    return df.withColumns({"qname": F.col("_q.name"), "rname": F.reverse("_q.name"), "qtype": F.col("_q.rtype"),
                           "qclass": F.col("_q.rclass")}).drop("_q")


# ---- all sections ----------------------------------------------------------------------------------

_RECORD = pa.struct([("name", pa.string()), ("rtype", pa.int32()), ("rclass", pa.int32()), ("ttl", pa.int64()),
                     ("rdlength", pa.int32()), ("rdata", pa.binary())])


def parse_message(buf: bytes) -> dict:
    """One message to header, sections, opt_flags and err_code. Never raises on bad input."""
    return {name: column[0].as_py() for name, column in parse_messages(pa.array([buf], pa.binary()), _RECORD).items()}


def decode_sections(df: DataFrame) -> DataFrame:
    """Messages of the eligible packets: the input columns but payload, the header, four sections of records
    (question names stay reversed), opt_flags and err_code."""
    keep = [c for c in df.columns if c not in ("payload", "dns_offset", "dns_len", "dpi_eligible", "reject_reason",
                                               "id", "flags", "qdcount", "ancount", "nscount", "arcount", "header_code")]
    rows = df.where("dpi_eligible").select(*keep, dns_bytes().alias("_d"))
    order = [f.split()[0] for f in _HEADER.split(", ")] + [*SECTIONS, "err_code"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = parse_messages(batch.column("_d"), _RECORD)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(parsed[f] for f in order)], names=[*keep, *order])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(decode, f"{kept}, {MESSAGE}, err_code int")


def classify_decode(df: DataFrame) -> DataFrame:
    """Add packet_code: OK 0, malformed 1, not DNS 2."""
    e = F.col("err_code")
    return df.withColumn("packet_code", F.when(e == OK, 0).when(e.isin(MALFORMED, INCOMPLETE, NO_MEMORY), 1).otherwise(2))


def reject_summary(df: DataFrame) -> DataFrame:
    return classify_decode(df).groupBy("err_code", "packet_code").agg(F.count(F.lit(1)).alias("packets"))


# ---- views of messages -----------------------------------------------------------------------------

def with_edns(messages: DataFrame) -> DataFrame:
    """Add do_bit, edns_version, udp_size and the extended response code of the first OPT record."""
    opt = F.get(F.filter("additional", lambda r: r["rtype"] == codes.TYPE_OPT), F.lit(0))
    flags = F.col("opt_flags")
    high = F.shiftright(flags, 20).bitwiseAND(F.lit(0xFF0))
    return messages.withColumns({
        "do_bit": bit(flags, 0x8000), "edns_version": F.shiftright(flags, 16).bitwiseAND(F.lit(255)).cast("int"),
        "udp_size": opt["rclass"],
        "ext_rcode": high.bitwiseOR(F.col("flags").bitwiseAND(F.lit(15)).cast("long")).cast("int"),
    })


def label_codes(messages: DataFrame, tsig: bool = False) -> DataFrame:
    """Names of the operation and the (extended) response code."""
    if "ext_rcode" not in messages.columns:
        messages = with_edns(messages)
    op = F.shiftright("flags", 11).bitwiseAND(F.lit(15))
    return messages.withColumns({"opcode_name": codes.opcode_name(op),
                                 "rcode_name": codes.rcode_name(F.col("ext_rcode"), tsig)})


def explode_records(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per record with its section and position."""
    def part(section: str) -> Column:
        return F.transform(section, lambda r, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), r.alias("r")))

    return (messages.select(*keep, F.explode(F.concat(*[part(s) for s in SECTIONS])).alias("_x"))
            .select(*keep, "_x.section", "_x.pos", "_x.r.*"))


def rdata_text(rtype: Column, rdata: Column) -> Column:
    quad = F.concat_ws(".", *[u8(rdata, i).cast("string") for i in range(4)])
    groups = F.concat_ws(":", *[F.lower(F.hex(u16(rdata, 2 * i))) for i in range(8)])
    plain = F.substring_index(F.decode(rdata, "ISO-8859-1"), "\u0000", 1)
    return (F.when(rdata.isNull(), "[EMPTY]").when(rtype == codes.TYPE_A, quad).when(rtype == codes.TYPE_AAAA, groups)
            .when(rtype == codes.TYPE_RRSIG, "NOT-IMPL").otherwise(plain))


def render_rdata(records: DataFrame) -> DataFrame:
    """Names of type and class, and the data as text."""
    return records.withColumns({"type_name": codes.type_name(F.col("rtype")), "class_name": codes.class_name(F.col("rclass")),
                                "rdata_text": rdata_text(F.col("rtype"), F.col("rdata"))})


def message_report(messages: DataFrame, name: str = "report") -> DataFrame:
    """A text report per message: header, flags and counts, and one line per record."""
    m = label_codes(messages)

    def record(r: Column) -> Column:
        text = rdata_text(r["rtype"], r["rdata"])
        opt = F.format_string(";; META-RR (OPT-pseudosection):\n; EDNS:  version: %d, flags: %s; udp: %d\n%s",
                              F.shiftright(r["ttl"], 16).bitwiseAND(F.lit(255)),
                              F.when(bit(r["ttl"], 0x8000), "do").otherwise(""), r["rclass"], text)
        line = F.format_string("%s\t\t%d\t%s\t%s\t%s", r["name"], r["ttl"], codes.class_name(r["rclass"]),
                               codes.type_name(r["rtype"]), text)
        return F.when(r["rtype"] == codes.TYPE_OPT, opt).otherwise(line)

    flags = F.concat(*[F.when(bit(F.col("flags"), mask), f" {n}").otherwise("") for n, mask in FLAG_BITS.items()],
                     F.when(F.col("do_bit"), " do(from meta-RR)").otherwise(""))
    head = F.format_string(
        ";; ->>HEADER<<- opcode: %s, status: %s, id: %d\n;; flags:%s; QUERY: %d, ANSWER: %d, AUTHORITY: %d, ADDITIONAL: %d",
        F.col("opcode_name"), F.col("rcode_name"), F.col("id"), flags, F.col("qdcount"), F.col("ancount"),
        F.col("nscount"), F.col("arcount"))
    titles = dict(zip(SECTIONS, ("QUESTIONS", "ANSWER", "AUTHORITY", "ADDITIONAL")))
    sections = [F.concat(F.array(F.lit(f";; {t} SECTION:")), F.transform(s, record)) for s, t in titles.items()]
    return m.withColumn(name, F.array_join(F.concat(F.array(head), *sections), "\n"))
