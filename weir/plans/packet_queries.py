"""Decoding of the message view written as wire bytes. The twins select the fields the bytes were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import decode as D
from weir.plans.bindings import WIRE_SQL, scratch, wire_packets
from weir.plans.catalog import query
from weir.sources import captures as C
from weir.sources import packets as S

SRC = "CASE WHEN direction = 'OUT' THEN client ELSE server END"
DST = "CASE WHEN direction = 'OUT' THEN server ELSE client END"
PROTO = "CASE WHEN k = 8 THEN 1 WHEN tcp THEN 6 ELSE 17 END"
PORT = "1024 + (seq * 7) % 4000"
READABLE = "k NOT IN (7, 8)"
GOOD = "NOT spoiled"


def decoded(spark, sf_dir):
    return D.decode_packets(wire_packets(spark, sf_dir))


def parsed(spark, sf_dir):
    return D.decode_sections(decoded(spark, sf_dir))


def good(spark, sf_dir):
    return D.classify_decode(parsed(spark, sf_dir)).where("packet_code = 0")


@query("decode_ip", f"""WITH {WIRE_SQL} SELECT seq, CASE WHEN k = 7 THEN 'short_ip' END AS reject_reason,
CASE WHEN k <> 7 THEN {SRC} END AS src_ip, CASE WHEN k <> 7 THEN {DST} END AS dst_ip, CASE WHEN k <> 7 THEN {PROTO} END AS proto,
CASE WHEN k <> 7 THEN n + CASE WHEN tcp THEN 42 ELSE 28 END END AS total_len FROM wire""")
def _ip(spark, sf_dir):
    return D.decode_ip(wire_packets(spark, sf_dir)).select("seq", "reject_reason", "src_ip", "dst_ip", "proto", "total_len")


@query("decode_transport", f"""WITH {WIRE_SQL} SELECT seq,
CASE WHEN k = 7 THEN 'short_ip' WHEN k = 8 THEN 'protocol' END AS reject_reason,
CASE WHEN {READABLE} THEN CASE WHEN direction = 'OUT' THEN {PORT} ELSE 53 END END AS src_port,
CASE WHEN {READABLE} THEN CASE WHEN direction = 'OUT' THEN 53 ELSE {PORT} END END AS dst_port,
CASE WHEN {READABLE} THEN CASE WHEN tcp THEN n + 42 ELSE n + 8 END END AS len,
CASE WHEN {READABLE} THEN n END AS dns_len FROM wire""")
def _transport(spark, sf_dir):
    return D.decode_transport(D.decode_ip(wire_packets(spark, sf_dir))).select(
        "seq", "reject_reason", "src_port", "dst_port", "len", "dns_len")


@query("dpi_eligible", f"WITH {WIRE_SQL} SELECT CAST({READABLE} AS INTEGER) AS eligible, tcp AND {READABLE} AS is_tcp, "
                       "count(*) AS n FROM wire GROUP BY ALL")
def _eligible(spark, sf_dir):
    d = decoded(spark, sf_dir)
    return d.groupBy(F.col("dpi_eligible").cast("int").alias("eligible"), F.coalesce(F.col("proto") == 6, F.lit(False)).alias("is_tcp")).agg(
        F.count(F.lit(1)).alias("n"))


@query("flow_key", f"WITH {WIRE_SQL} SELECT client AS client_ip, server AS server_ip, count(*) AS n FROM wire "
                   "WHERE k <> 7 GROUP BY ALL")
def _flow_key(spark, sf_dir):
    return decoded(spark, sf_dir).where("client_ip is not null").groupBy("client_ip", "server_ip").agg(F.count(F.lit(1)).alias("n"))


@query("split_rejects", f"""WITH {WIRE_SQL} SELECT CASE WHEN k = 7 THEN 'short_ip' WHEN k = 8 THEN 'protocol' ELSE 'accepted' END
AS outcome, count(*) AS n FROM wire GROUP BY ALL""")
def _rejects(spark, sf_dir):
    kept, gone = D.split_rejects(decoded(spark, sf_dir))
    both = kept.select(F.lit("accepted").alias("outcome")).unionByName(gone.select(F.col("reject_reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("decode_dns_header", f"""WITH {WIRE_SQL} SELECT seq, seq % 65536 AS id, flags, CASE WHEN k = 9 THEN 2 ELSE 1 END AS qdcount,
ancount, nscount, CASE WHEN k = 12 THEN arcount + 1 ELSE arcount END AS arcount,
CAST(direction = 'IN' AS INTEGER) AS qr, 1 AS rd, CAST(direction = 'IN' AS INTEGER) AS ra, 0 AS tc, 0 AS opcode,
flags & 15 AS rcode, CASE WHEN k = 9 THEN 1 ELSE 0 END AS header_code FROM wire WHERE {READABLE}""")
def _header(spark, sf_dir):
    d = D.decode_dns_header(decoded(spark, sf_dir).where("dpi_eligible"))
    flags = [F.col(c).cast("int").alias(c) for c in ("qr", "rd", "ra", "tc")]
    return d.select("seq", "id", "flags", "qdcount", "ancount", "nscount", "arcount", *flags, "opcode", "rcode", "header_code")


@query("decode_question", f"""WITH {WIRE_SQL} SELECT seq, qname, reverse(qname) AS rname,
CASE WHEN seq % 2 = 0 THEN 1 ELSE 28 END AS qtype, 1 AS qclass FROM wire WHERE k NOT IN (7, 8, 9, 10, 11)""")
def _question(spark, sf_dir):
    d = D.decode_question(D.decode_dns_header(decoded(spark, sf_dir).where("dpi_eligible")))
    return d.where("qname is not null").select("seq", "qname", "rname", "qtype", "qclass")


RECORDS_SQL = f"""records AS (
  SELECT seq, 'questions' AS section, 0 AS pos, reverse(qname) AS name, CASE WHEN seq % 2 = 0 THEN 1 ELSE 28 END AS rtype,
    1 AS rclass, 0 AS ttl, '[EMPTY]' AS rdata_text FROM wire WHERE {GOOD}
  UNION ALL SELECT seq, 'answers', j - 1, qname, 1, 1, ttl, '10.' || (seq % 256) || '.' || j || '.7'
    FROM wire, (SELECT unnest([1, 2, 3]) AS j) WHERE {GOOD} AND j <= ancount
  UNION ALL SELECT seq, 'authority', 0, qname, 2, 1, 300, 'ns.' || qname FROM wire WHERE {GOOD} AND nscount = 1
  UNION ALL SELECT seq, 'additional', 0, '.', 41, 4096, opt, '' FROM wire WHERE {GOOD} AND arcount = 1)"""


@query("decode_sections", f"WITH {WIRE_SQL}, {RECORDS_SQL} SELECT seq, section, pos, name, rtype, rclass, ttl FROM records")
def _sections(spark, sf_dir):
    return D.explode_records(good(spark, sf_dir), "seq").select("seq", "section", "pos", "name", "rtype", "rclass", "ttl")


@query("explode_records", f"WITH {WIRE_SQL}, {RECORDS_SQL} SELECT section, rtype, count(*) AS n FROM records GROUP BY ALL")
def _explode(spark, sf_dir):
    return D.explode_records(good(spark, sf_dir), "seq").groupBy("section", "rtype").agg(F.count(F.lit(1)).alias("n"))


@query("render_rdata", f"""WITH {WIRE_SQL}, {RECORDS_SQL} SELECT seq, section, pos,
CASE rtype WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 28 THEN 'AAAA' ELSE 'OPT' END AS type_name,
CASE rclass WHEN 1 THEN 'IN' ELSE 'Non-Standard' END AS class_name, rdata_text FROM records""")
def _rdata(spark, sf_dir):
    r = D.render_rdata(D.explode_records(good(spark, sf_dir), "seq"))
    return r.select("seq", "section", "pos", "type_name", "class_name", "rdata_text")


# a bare question of 18 bytes is cut short before its pointer is read
ERR = "CASE WHEN k = 9 THEN 1 WHEN k IN (10, 11) THEN CASE WHEN n <= 18 THEN 4 ELSE 1 END WHEN k = 12 THEN 4 ELSE 0 END"


@query("classify_decode", f"WITH {WIRE_SQL} SELECT seq, {ERR} AS err_code, CASE WHEN {ERR} = 0 THEN 0 ELSE 1 END AS packet_code "
                          f"FROM wire WHERE {READABLE}")
def _classify(spark, sf_dir):
    return D.classify_decode(parsed(spark, sf_dir)).select("seq", "err_code", "packet_code")


@query("reject_summary", f"WITH {WIRE_SQL} SELECT {ERR} AS err_code, CASE WHEN {ERR} = 0 THEN 0 ELSE 1 END AS packet_code, "
                         f"count(*) AS packets FROM wire WHERE {READABLE} GROUP BY ALL")
def _reject_summary(spark, sf_dir):
    return D.reject_summary(parsed(spark, sf_dir))


EXT = "(CASE WHEN opt >= 16777216 THEN 16 ELSE 0 END | (flags & 15))"


@query("edns", f"""WITH {WIRE_SQL} SELECT seq, CAST(opt & 32768 <> 0 AS INTEGER) AS do_bit, 0 AS edns_version,
CASE WHEN arcount = 1 THEN 4096 END AS udp_size, {EXT} AS ext_rcode FROM wire WHERE {GOOD}""")
def _edns(spark, sf_dir):
    return D.with_edns(good(spark, sf_dir)).select("seq", F.col("do_bit").cast("int").alias("do_bit"), "edns_version", "udp_size", "ext_rcode")


RCODE = f"CASE {EXT} WHEN 0 THEN 'NOERROR' WHEN 3 THEN 'NXDOMAIN' WHEN 16 THEN 'BADVERS' WHEN 19 THEN 'BADMODE' END"


@query("label_codes", f"WITH {WIRE_SQL} SELECT 'QUERY' AS opcode_name, {RCODE} AS rcode_name, count(*) AS n FROM wire "
                      f"WHERE {GOOD} GROUP BY ALL")
def _labels(spark, sf_dir):
    return D.label_codes(good(spark, sf_dir)).groupBy("opcode_name", "rcode_name").agg(F.count(F.lit(1)).alias("n"))


LINE = """CASE WHEN rtype = 41 THEN ';; META-RR (OPT-pseudosection):' || chr(10) || '; EDNS:  version: 0, flags: '
  || CASE WHEN ttl & 32768 <> 0 THEN 'do' ELSE '' END || '; udp: 4096' || chr(10)
  ELSE name || chr(9) || chr(9) || ttl || chr(9) || 'IN' || chr(9)
  || CASE rtype WHEN 1 THEN 'A' WHEN 2 THEN 'NS' ELSE 'AAAA' END || chr(9) || rdata_text END"""


@query("message_report", f"""WITH {WIRE_SQL}, {RECORDS_SQL},
bodies AS (SELECT seq, section, string_agg(chr(10) || ({LINE}), '' ORDER BY pos) AS body FROM records GROUP BY ALL)
SELECT w.seq, ';; ->>HEADER<<- opcode: QUERY, status: ' || {RCODE} || ', id: ' || (w.seq % 65536) || chr(10) || ';; flags:'
  || CASE WHEN direction = 'IN' THEN ' qr rd ra' ELSE ' rd' END
  || CASE WHEN opt & 32768 <> 0 THEN ' do(from meta-RR)' ELSE '' END
  || '; QUERY: 1, ANSWER: ' || ancount || ', AUTHORITY: ' || nscount || ', ADDITIONAL: ' || arcount
  || chr(10) || ';; QUESTIONS SECTION:' || coalesce(q.body, '') || chr(10) || ';; ANSWER SECTION:' || coalesce(a.body, '')
  || chr(10) || ';; AUTHORITY SECTION:' || coalesce(u.body, '') || chr(10) || ';; ADDITIONAL SECTION:' || coalesce(x.body, '')
  AS report
FROM wire w LEFT JOIN bodies q ON w.seq = q.seq AND q.section = 'questions'
  LEFT JOIN bodies a ON w.seq = a.seq AND a.section = 'answers' LEFT JOIN bodies u ON w.seq = u.seq AND u.section = 'authority'
  LEFT JOIN bodies x ON w.seq = x.seq AND x.section = 'additional' WHERE {GOOD}""")
def _report(spark, sf_dir):
    return D.message_report(good(spark, sf_dir)).select("seq", "report")


@query("read_packets", f"WITH {WIRE_SQL} SELECT direction, count(*) AS n, "
                       "CAST(sum(CASE WHEN k = 7 THEN 10 ELSE n + CASE WHEN tcp THEN 42 ELSE 28 END END) AS BIGINT) AS bytes "
                       "FROM wire GROUP BY ALL")
def _read_packets(spark, sf_dir):
    path = scratch(spark, "packets")
    wire_packets(spark, sf_dir).write.parquet(path)
    return S.read_packets(spark, path).groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("captured_len").alias("bytes"))


# The packets written as capture files and read back in splits of 100 kB, most of which begin inside a record. Their clock is
# set to this year's range, as zeros would be times and headers alike.
CLOCK = 1_700_000_000
LENGTH_SQL = "CASE WHEN k = 7 THEN 10 ELSE n + CASE WHEN tcp THEN 42 ELSE 28 END END"


@query("read_captures", f"WITH {WIRE_SQL} SELECT seq AS t, direction, {LENGTH_SQL} AS captured_len, 'accepted' AS outcome FROM wire")
def _captures(spark, sf_dir):
    path = scratch(spark, "captures")
    C.write_captures(wire_packets(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + CLOCK)), path)
    rows = C.read_captures(spark, path, splitBytes=100_000)
    return rows.select((F.unix_seconds("ts") - CLOCK).alias("t"), "direction", "captured_len", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@query("stream_captures", f"WITH {WIRE_SQL} SELECT direction, count(*) AS n, CAST(sum({LENGTH_SQL}) AS BIGINT) AS bytes FROM wire GROUP BY ALL")
def _stream_captures(spark, sf_dir):
    path, out = scratch(spark, "captures"), scratch(spark, "captured")
    C.write_captures(wire_packets(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + CLOCK)), path)
    packets = C.split_captures(C.read_captures(spark, path, streaming=True, splitBytes=100_000))[0]
    (packets.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "captures-state"))
     .trigger(availableNow=True).start().awaitTermination())
    return S.read_packets(spark, out).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum("captured_len").alias("bytes"))
