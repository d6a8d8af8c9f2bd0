"""Names, domain history, baselines and patterns over the message view of `events` and `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import domains as D
from weir.operators import lookups as L
from weir.plans.bindings import MESSAGES_SQL, flow_packets, flow_packets_sql, messages, table
from weir.plans.catalog import query

RNAME = "reverse(qname)"
KEY_SQL = "array_to_string(string_split(reverse(qname), '.')[1:3], '.')"
NONLC = "(1 + length(regexp_replace(left({r}, greatest(length({r}) - 1, 0)), '[a-z.]', '', 'g')))"


def r6(c):
    return F.round(c, 6)


@query("reversed_qname", f"WITH {MESSAGES_SQL} SELECT seq, {RNAME} AS rname FROM messages")
def _reversed(spark, sf_dir):
    return D.with_reversed_qname(messages(spark, sf_dir)).select("seq", "rname")


@query("domain_key", f"WITH {MESSAGES_SQL} SELECT seq, {KEY_SQL} AS domain_key FROM messages")
def _key(spark, sf_dir):
    return D.with_domain_key(messages(spark, sf_dir)).select("seq", "domain_key")


@query("message_kind", f"WITH {MESSAGES_SQL} SELECT CASE WHEN ancount = 0 THEN 'Query' ELSE 'Reply' END AS kind, "
                       "count(*) AS n FROM messages GROUP BY ALL")
def _kind(spark, sf_dir):
    return D.with_message_kind(messages(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("order_by_domain", f"WITH {MESSAGES_SQL} SELECT seq, qname FROM messages "
                          "ORDER BY reverse(qname), qname")
def _ordered(spark, sf_dir):
    return D.order_by_domain(messages(spark, sf_dir)).select("seq", "qname")


@query("nonlc_rate", f"""WITH {MESSAGES_SQL}
SELECT seq, {NONLC.format(r=RNAME)} AS nonlc, round({NONLC.format(r=RNAME)}::DOUBLE / length(qname), 6) AS rate
FROM messages""")
def _nonlc(spark, sf_dir):
    r = F.reverse("qname")
    return messages(spark, sf_dir).select(
        "seq", D.nonlc_count(r).alias("nonlc"), r6(D.nonlc_rate(r)).alias("rate"))


INVALID_SQL = """coalesce(qname, CASE WHEN direction = 'OUT' THEN client_ip || '.' || server_ip ELSE server_ip || '.' || client_ip END
  || '.INVALID')"""


@query("fill_invalid_domain", f"WITH {MESSAGES_SQL} SELECT seq, {INVALID_SQL} AS qname FROM messages")
def _invalid(spark, sf_dir):
    return D.fill_invalid_domain(messages(spark, sf_dir)).select("seq", "qname")


def history_sql(source: str = "messages") -> str:
    return f"""hist_rows AS (
  SELECT t // 300 * 300 AS win, domain_key, seq, length(rname)::DOUBLE AS len, nonlc, nonlc::DOUBLE / length(rname) AS rate,
    row_number() OVER (PARTITION BY t // 300, domain_key ORDER BY seq) AS k
  FROM (SELECT *, reverse(qname) AS rname, {KEY_SQL} AS domain_key, {NONLC.format(r='reverse(qname)')} AS nonlc
        FROM {source})),
hist_len AS (SELECT *, (sum(len * pow(2, k)) OVER w) / pow(2, k + 1) + first_value(len) OVER w / pow(2, k) AS len_avg,
    (sum(k * pow(2, k)) OVER w) / pow(2, k + 1) + 1 / pow(2, k) AS cnt_avg
  FROM hist_rows WINDOW w AS (PARTITION BY win, domain_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hist_all AS (SELECT win, domain_key, max(k) AS n, max_by(len_avg, k) AS len_avg, max_by(cnt_avg, k) AS query_avg_rate,
    min_by(rate, k) AS rate1,
    (100 + sum((1 + abs(len_avg - len) / (1 + len_avg)) * pow(2, k - 1))) / pow(2, max(k)) AS len_variation,
    (100 + sum((1 + abs(cnt_avg - k) / (1 + cnt_avg)) * pow(2, k - 1))) / pow(2, max(k)) AS query_rate_variation
  FROM hist_len GROUP BY ALL),
hist_coded AS (SELECT win, domain_key, max(j) AS m, sum(rate * pow(2, j - 1)) / pow(2, max(j)) AS s, max_by(rate, j) AS last_rate
  FROM (SELECT *, row_number() OVER (PARTITION BY win, domain_key ORDER BY seq) AS j FROM hist_rows WHERE nonlc > 1)
  GROUP BY ALL),
history AS (SELECT win, domain_key, n AS query_rate, query_avg_rate, len_avg, query_rate_variation, len_variation,
    coalesce(s + rate1 / pow(2, m), rate1) AS nonlc_avg_rate,
    CASE WHEN m IS NULL THEN 100 ELSE (s + rate1 / pow(2, m) + 1
      + abs(s + rate1 / pow(2, m) - last_rate) / (1 + s + rate1 / pow(2, m))) / 2 END AS nonlc_rate_variation
  FROM hist_all LEFT JOIN hist_coded USING (win, domain_key))"""


HISTORY_COLUMNS = ["query_avg_rate", "len_avg", "nonlc_avg_rate", "query_rate_variation", "len_variation",
                   "nonlc_rate_variation"]


@query("domain_history", f"""WITH {MESSAGES_SQL}, named AS (SELECT * FROM messages WHERE qname IS NOT NULL),
{history_sql('named')}
SELECT win, domain_key, query_rate, {', '.join(f'round({c}, 6) AS {c}' for c in HISTORY_COLUMNS)} FROM history""")
def _history(spark, sf_dir):
    h = D.domain_history(messages(spark, sf_dir).where("qname is not null"))
    return h.select(F.unix_seconds("window_start").alias("win"), "domain_key", "query_rate",
                    *[r6(c).alias(c) for c in HISTORY_COLUMNS])


@query("domain_history_reset", f"""WITH {MESSAGES_SQL}
SELECT seq, 1 AS query_rate, length(qname)::DOUBLE AS len_avg, (nonlc // length(qname))::DOUBLE AS nonlc_avg_rate,
  CASE WHEN nonlc > 1 THEN ((nonlc // length(qname) + 1) // 2)::DOUBLE ELSE 100 END AS nonlc_rate_variation
FROM (SELECT *, {NONLC.format(r=RNAME)} AS nonlc FROM messages WHERE qname IS NOT NULL)""")
def _history_reset(spark, sf_dir):
    h = D.domain_history(messages(spark, sf_dir).where("qname is not null"), mode="reset")
    return h.select("seq", "query_rate", "len_avg", "nonlc_avg_rate", "nonlc_rate_variation")


def baseline_sql(name: str, value: str, prior: float, source: str, t: str = "t") -> str:
    return f"""{name} AS (
  SELECT win, CAST(sum(n) OVER w AS BIGINT) AS n,
    (40000 * {prior}::DOUBLE + sum(s) OVER w) / (40000 + sum(n) OVER w) AS mean
  FROM (SELECT {t} // 300 * 300 AS win, sum(({value})::DOUBLE) AS s, count({value}) AS n FROM {source}
        WHERE ({value}) IS NOT NULL GROUP BY ALL)
  WINDOW w AS (ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("traffic_baseline", f"""WITH {MESSAGES_SQL}, {baseline_sql('b', 'ttl', 60, 'messages')}
SELECT win, n, round(mean, 6) AS mean FROM b""")
def _baseline(spark, sf_dir):
    b = D.traffic_baseline(messages(spark, sf_dir), "ttl", D.PRIORS["ttl"])
    return b.select(F.unix_seconds("window_start").alias("win"), "n", r6("mean").alias("mean"))


# a_k = a0 q^k + alpha sum d_i q^(k-i), folded in the twin by recursion over the rows of each key
EWMA_SQL = """, ranked AS (SELECT client_ip, seq, len, row_number() OVER (PARTITION BY client_ip ORDER BY seq) AS k FROM flow_packets),
folded AS (SELECT client_ip, seq, k, 80 + {a}::DOUBLE * (len - 80) AS a FROM ranked WHERE k = 1
  UNION ALL SELECT r.client_ip, r.seq, r.k, f.a + {a}::DOUBLE * (r.len - f.a)
  FROM folded f JOIN ranked r ON r.client_ip = f.client_ip AND r.k = f.k + 1)
SELECT client_ip, seq, round(a + 1e-9, 6) AS ewma FROM folded"""

for _name, _alpha in [("ewma", D.EWMA_NEW), ("ewma_known", D.EWMA_KNOWN)]:
    @query(_name, f"WITH RECURSIVE {flow_packets_sql()}{EWMA_SQL.format(a=_alpha)}")
    def _ewma(spark, sf_dir, alpha=_alpha):
        d = D.ewma(flow_packets(spark, sf_dir), "len", alpha, ["client_ip"], "seq", initial=D.PRIORS["query_size"])
        return d.select("client_ip", "seq", r6(F.col("ewma") + 1e-9).alias("ewma"))


@query("adapt_patterns", f"""WITH RECURSIVE {flow_packets_sql()},
ranked AS (SELECT client_ip, seq, CASE WHEN msg_id < 4 THEN 0 ELSE 1 END AS code,
  row_number() OVER (PARTITION BY client_ip ORDER BY seq) AS k FROM flow_packets),
folded AS (SELECT client_ip, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, 7 AS rng, 2 AS uniq
    FROM ranked GROUP BY client_ip
  UNION ALL SELECT r.client_ip, r.seq, r.k,
    CASE WHEN r.code <> 0 AND f.rng >= 4 THEN f.rng - 1 ELSE f.rng END,
    CASE WHEN r.code = 0 THEN (f.uniq | (f.uniq + 1)) % 4 WHEN f.rng >= 4 THEN (f.uniq + 3) % 4 ELSE f.uniq END
  FROM folded f JOIN ranked r ON r.client_ip = f.client_ip AND r.k = f.k + 1)
SELECT client_ip, seq, rng AS held_range, uniq AS held_uniqueness FROM folded WHERE k > 0""")
def _adapt(spark, sf_dir):
    p = flow_packets(spark, sf_dir).withColumn("code", F.when(F.col("msg_id") < 4, 0).otherwise(1))
    return D.adapt_patterns(p, ["client_ip"], "seq", initial_range=7, initial_uniqueness=2).select(
        "client_ip", "seq", "held_range", "held_uniqueness")


def ttl_sql(source: str) -> str:
    """code, level and uniq of ttl against avg_ttl"""
    return f"""SELECT *, CAST(floor(p - 4.0 * floor(p / 4)) AS INTEGER) AS ttl_uniq FROM (
  SELECT *, abs(ttl - a) * (CASE WHEN ttl_code <> 0 THEN abs(ttl - a) ELSE abs(ttl - a) / 2 END) / (1 + ttl_range) AS p FROM (
    SELECT *, CASE WHEN ttl_code = 1 THEN (8 * ttl // 20) & 7
        WHEN ttl_code = 2 THEN CASE WHEN ttl // 320000 < 3 THEN CAST(pow(2, ttl // 320000) AS BIGINT) ELSE 0 END
        ELSE CASE WHEN floor(8 * ttl / a) < 3 THEN CAST(pow(2, floor(8 * ttl / a)) AS BIGINT) ELSE 0 END END AS ttl_range FROM (
      SELECT *, CASE WHEN ttl < least(20, a / 10) THEN 1 WHEN ttl > greatest(40000, a * 10) THEN 2
        WHEN ttl IS NOT NULL THEN 0 END AS ttl_code FROM (SELECT *, avg_ttl AS a FROM {source}))))"""


@query("ttl_pattern", f"""WITH {MESSAGES_SQL}, {baseline_sql('b', 'ttl', 60, 'messages')},
j AS (SELECT m.*, coalesce(b.mean, 60) AS avg_ttl FROM messages m LEFT JOIN b ON m.t // 300 * 300 = b.win)
SELECT seq, ttl_code, ttl_range, ttl_uniq FROM ({ttl_sql('j')}) WHERE ttl IS NOT NULL""")
def _ttl(spark, sf_dir):
    m = messages(spark, sf_dir)
    base = D.traffic_baseline(m, "ttl", D.PRIORS["ttl"])
    m = D.with_baselines(m, base, {"avg_ttl": ("mean", D.PRIORS["ttl"])})
    return D.ttl_pattern(m).where("ttl is not null").select("seq", "ttl_code", "ttl_range", "ttl_uniq")


QUERY_SIZE_SQL = """CASE WHEN qdcount = 0 THEN 2 WHEN len > 2 * avg_query_size THEN 1
    WHEN ancount > 0 OR nscount > 0 OR arcount > 0 THEN 2 ELSE 0 END AS query_code,
  CASE WHEN qdcount = 0 THEN 0 WHEN len > 2 * avg_query_size THEN CAST(floor(len / avg_query_size) AS BIGINT) & 7
    WHEN ancount > 0 OR nscount > 0 OR arcount > 0 THEN CAST(floor(len * 1.5::DOUBLE / avg_query_size) AS BIGINT) & 7
    ELSE 0 END AS query_range"""


@query("query_size_pattern", f"""WITH {MESSAGES_SQL}, {baseline_sql('b', 'len', 80, 'messages')},
j AS (SELECT m.*, coalesce(b.mean, 80) AS avg_query_size FROM messages m LEFT JOIN b ON m.t // 300 * 300 = b.win)
SELECT seq, {QUERY_SIZE_SQL} FROM j""")
def _query_size(spark, sf_dir):
    m = messages(spark, sf_dir)
    base = D.traffic_baseline(m, "len", D.PRIORS["query_size"])
    m = D.with_baselines(m, base, {"avg_query_size": ("mean", D.PRIORS["query_size"])})
    return D.query_size_pattern(m).select("seq", "query_code", "query_range")


def rated_sql() -> str:
    return f"""{baseline_sql('b_len', 'len_avg', 15, 'history', 'win')},
{baseline_sql('b_rate', 'query_avg_rate', 5, 'history', 'win')},
{baseline_sql('b_nonlc', 'nonlc_avg_rate', 0.3, 'history', 'win')},
rated AS (SELECT h.*, b_len.mean AS al, b_rate.mean AS ar, b_nonlc.mean AS an,
    h.len_avg > 3 * b_len.mean AS large, h.query_rate > 2 * b_rate.mean AND len_variation < 50 AS fast,
    nonlc_avg_rate > 1.5::DOUBLE * b_nonlc.mean AND nonlc_rate_variation < 50 AS strange,
    (len_variation < 25 OR nonlc_rate_variation < 50) AND query_rate_variation < 50 AS uniform
  FROM history h JOIN b_len USING (win) JOIN b_rate USING (win) JOIN b_nonlc USING (win)),
coded AS (SELECT win, domain_key,
  CASE WHEN large THEN 1 WHEN fast THEN 2 WHEN strange THEN 3 WHEN uniform THEN 4 ELSE 0 END AS qname_code,
  CASE WHEN large THEN (CAST(floor(len_avg * 3 / al) AS BIGINT) * 2) & 7
    WHEN fast THEN (CAST(floor(query_rate * 2 / ar) AS BIGINT) * 2) & 7
    WHEN strange THEN (CAST(floor(nonlc_avg_rate * 3 / an) AS BIGINT) * 2) & 7
    WHEN uniform THEN (CAST(floor(query_rate_variation) AS BIGINT) | CAST(floor(nonlc_rate_variation) AS BIGINT)
      | CAST(floor(len_variation) AS BIGINT)) & 7 ELSE 0 END AS qname_range FROM rated)"""


@query("qname_pattern", f"""WITH {MESSAGES_SQL}, named AS (SELECT * FROM messages WHERE qname IS NOT NULL),
{history_sql('named')}, {rated_sql()} SELECT * FROM coded""")
def _qname(spark, sf_dir):
    h = D.rated_history(D.domain_history(messages(spark, sf_dir).where("qname is not null")))
    return D.qname_pattern(h).select(F.unix_seconds("window_start").alias("win"), "domain_key", "qname_code", "qname_range")


# ---- dimension tables taken from the given tables ---------------------------------------------------

def nameservers(spark, sf_dir):
    return table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("address"))


def blacklist(spark, sf_dir):
    return table(spark, sf_dir, "region").where("r_regionkey in (1, 4)").select(F.col("r_regionkey").cast("long").alias("address"))


def scores(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("address"),
                                                 F.col("n_regionkey").alias("score"))


def local_addrs(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("long").alias("address"))


DST_CODE = "CASE WHEN server_ip IN (1, 4) THEN 1 WHEN server_ip < 3 THEN 0 ELSE 2 END"
DST_RANGE = "coalesce(n_regionkey, 0)"
SPOOFED = "(direction = 'OUT' AND (client_ip % 4 = 0 OR client_ip > 24))"
JOIN_NATION = "LEFT JOIN nation ON server_ip = n_nationkey"


@query("classify_server", f"""WITH {MESSAGES_SQL}
SELECT seq, {DST_CODE} AS dst_code, {DST_RANGE} AS dst_range FROM messages {JOIN_NATION}""")
def _server(spark, sf_dir):
    return L.classify_server(messages(spark, sf_dir), nameservers(spark, sf_dir), blacklist(spark, sf_dir),
                             scores(spark, sf_dir)).select("seq", "dst_code", "dst_range")


@query("classify_server_configured", f"""WITH {MESSAGES_SQL}
SELECT CASE WHEN server_ip < 3 THEN 0 ELSE 2 END AS dst_code, 0 AS dst_range, count(*) AS n FROM messages GROUP BY ALL""")
def _server_configured(spark, sf_dir):
    d = L.classify_server(messages(spark, sf_dir), nameservers(spark, sf_dir))
    return d.groupBy("dst_code", "dst_range").agg(F.count(F.lit(1)).alias("n"))


@query("flag_spoofed", f"WITH {MESSAGES_SQL} SELECT seq, CAST({SPOOFED} AS INTEGER) AS spoofed FROM messages")
def _spoofed(spark, sf_dir):
    d = L.flag_spoofed(messages(spark, sf_dir), local_addrs(spark, sf_dir))
    return d.select("seq", F.col("spoofed").cast("int").alias("spoofed"))


@query("label_service", f"""WITH {flow_packets_sql()}, ports AS (
  SELECT n_name AS service, CAST(50 + n_nationkey AS INTEGER) AS port FROM nation)
SELECT service, direction, count(*) AS n FROM flow_packets
LEFT JOIN ports ON port = CASE WHEN direction = 'IN' THEN src_port ELSE dst_port END GROUP BY ALL""")
def _service(spark, sf_dir):
    ports = table(spark, sf_dir, "nation").select(F.col("n_name").alias("service"),
                                                  (F.col("n_nationkey") + 50).cast("int").alias("port"))
    return L.label_service(flow_packets(spark, sf_dir), ports).groupBy("service", "direction").agg(
        F.count(F.lit(1)).alias("n"))


@query("filter_service", f"""WITH {flow_packets_sql()}
SELECT client_ip, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM flow_packets
WHERE CASE WHEN direction = 'IN' THEN src_port ELSE dst_port END IN (53, 67) AND client_ip % 2 = 0 GROUP BY ALL""")
def _filter_service(spark, sf_dir):
    p = flow_packets(spark, sf_dir).withColumn("iface", F.when(F.col("client_ip") % 2 == 0, "eth0").otherwise("eth1"))
    return L.filter_service(p, "eth0", [53, 67]).groupBy("client_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))


@query("host_reputation", """SELECT coalesce(CASE WHEN n_regionkey = 0 THEN 0 WHEN n_regionkey = 1 THEN 5
  WHEN n_regionkey = 2 THEN 6 END, 2) AS reputation, count(*) AS n
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _reputation(spark, sf_dir):
    history = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("host"),
        F.when(F.col("n_regionkey") == 0, L.HOST_LOCAL).when(F.col("n_regionkey") == 1, L.HOST_NEW)
        .otherwise(L.HOST_PERSISTENT).alias("reputation"))
    return L.host_reputation(table(spark, sf_dir, "customer"), history, host="c_nationkey").groupBy(
        "reputation").agg(F.count(F.lit(1)).alias("n"))


# ---- the whole pattern -----------------------------------------------------------------------------

IS_NAMED = "(packet_code <> 0 OR (ancount = 0 AND qdcount > 0))"
PATTERNS_SQL = f"""{MESSAGES_SQL},
filled AS (SELECT * REPLACE ({INVALID_SQL} AS qname) FROM messages),
named AS (SELECT * FROM filled WHERE {IS_NAMED}),
{history_sql('named')}, {rated_sql()},
{baseline_sql('b_ttl', 'CASE WHEN packet_code = 0 AND ancount > 0 THEN ttl END', 60, 'messages')},
{baseline_sql('b_size', 'CASE WHEN packet_code = 0 AND ancount = 0 THEN len END', 80, 'messages')},
joined AS (SELECT f.*, {KEY_SQL} AS domain_key, coalesce(b_ttl.mean, 60) AS avg_ttl, coalesce(b_size.mean, 80) AS avg_query_size
  FROM filled f LEFT JOIN b_ttl ON t // 300 * 300 = b_ttl.win LEFT JOIN b_size ON t // 300 * 300 = b_size.win),
sized AS (SELECT *, {QUERY_SIZE_SQL} FROM ({ttl_sql('joined')})),
patterns AS (SELECT seq, CASE WHEN {SPOOFED} THEN 2 ELSE 0 END AS src_code,
  CASE WHEN {SPOOFED} THEN 0 ELSE {DST_CODE} END AS dst_code, CASE WHEN {SPOOFED} THEN 0 ELSE {DST_RANGE} END AS dst_range,
  packet_code, CASE WHEN packet_code = 0 AND ancount = 0 THEN query_code ELSE 0 END AS query_code,
  CASE WHEN packet_code = 0 AND ancount = 0 THEN query_range ELSE 0 END AS query_range,
  CASE WHEN packet_code = 0 AND ancount > 0 THEN ttl_code ELSE 0 END AS ttl_code,
  CASE WHEN packet_code = 0 AND ancount > 0 THEN ttl_range ELSE 0 END AS ttl_range,
  CASE WHEN packet_code = 0 AND ancount > 0 THEN ttl_uniq ELSE 0 END AS ttl_uniq,
  CASE WHEN {IS_NAMED} THEN coalesce(qname_code, 0) ELSE 0 END AS qname_code,
  CASE WHEN {IS_NAMED} THEN coalesce(qname_range, 0) ELSE 0 END AS qname_range
  FROM sized s LEFT JOIN coded c ON s.t // 300 * 300 = c.win AND s.domain_key = c.domain_key {JOIN_NATION})"""

PATTERN_COLUMNS = ["src_code", "dst_code", "dst_range", "packet_code", "query_code", "query_range", "ttl_code",
                   "ttl_range", "ttl_uniq", "qname_code", "qname_range"]


def patterns(spark, sf_dir):
    return D.message_patterns(messages(spark, sf_dir), nameservers(spark, sf_dir), blacklist(spark, sf_dir),
                              scores(spark, sf_dir), local_addrs(spark, sf_dir))


@query("message_patterns", f"WITH {PATTERNS_SQL} SELECT seq, {', '.join(PATTERN_COLUMNS)} FROM patterns")
def _patterns(spark, sf_dir):
    return patterns(spark, sf_dir).select("seq", *PATTERN_COLUMNS)


@query("pack_pattern", f"""WITH {PATTERNS_SQL}
SELECT seq, array_to_string([src_code << 5, (dst_code << 5) | (dst_range << 3), packet_code << 5,
  (qname_code << 5) | (qname_range << 3), (query_code << 5) | (query_range << 3), 0,
  (ttl_code << 5) | (ttl_range << 3) | ttl_uniq], ',') AS point FROM patterns""")
def _pack(spark, sf_dir):
    return D.pack_pattern(patterns(spark, sf_dir)).select(
        "seq", F.array_join(F.col("point").cast("array<string>"), ",").alias("point"))


@query("pattern_string", f"""WITH {PATTERNS_SQL}
SELECT seq, format('SRC:{{}}|0|0, DST:{{}}|{{}}|0, PACKET:{{}}|0|0, QUERY:{{}}|{{}}|0, REPLY:0|0|0, TTL:{{}}|{{}}|{{}}, QNAME:{{}}|{{}}|0, ',
  src_code, dst_code, dst_range, packet_code, query_code, query_range, ttl_code, ttl_range, ttl_uniq,
  qname_code, qname_range) AS pattern FROM patterns""")
def _string(spark, sf_dir):
    return D.pattern_string(patterns(spark, sf_dir)).select("seq", "pattern")
