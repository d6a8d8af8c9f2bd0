"""Flow statistics over the packet view of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import flows
from weir.plans.bindings import flow_packets, flow_packets_sql
from weir.plans.catalog import query

KEY = ["client_ip", "server_ip", "seq"]

HISTORY = """hist AS (
  SELECT *, min(t) OVER f AS t0,
    max(CASE WHEN direction = 'OUT' THEN t END) OVER b AS lq,
    max(CASE WHEN direction = 'IN' THEN t END) OVER b AS lr,
    sum(CASE WHEN direction = 'OUT' THEN len ELSE 0 END) OVER f AS sent,
    sum(CASE WHEN direction = 'IN' THEN len ELSE 0 END) OVER f AS recvd,
    sum(CASE WHEN direction = 'OUT' THEN 1 ELSE -1 END) OVER f AS inflight_packets,
    sum(CASE WHEN direction = 'OUT' THEN len ELSE -len END) OVER f AS inflight_bytes
  FROM flow_packets
  WINDOW f AS (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
series AS (
  SELECT *,
    CASE WHEN direction = 'IN' THEN greatest(0, t - coalesce(lq, t0)) END AS rtt,
    CASE WHEN direction = 'OUT' THEN 2.0::DOUBLE / (1 + greatest(0, t - coalesce(lq, t0))) END AS query_rate,
    1000.0::DOUBLE * len / (1 + greatest(0, t - coalesce(lq, t0))) AS byte_rate,
    CASE WHEN direction = 'OUT' THEN greatest(0, t - coalesce(lr, t0)) END AS inter_query,
    CASE WHEN direction = 'OUT' THEN (1.0::DOUBLE + sent) / (1 + recvd) END AS updown_ratio,
    CASE WHEN direction = 'OUT' AND len > 0 THEN len END AS forward_length,
    CASE WHEN direction = 'IN' AND len > 0 THEN len END AS backward_length
  FROM hist)"""


def cut(x: str) -> str:
    return f"CAST(trunc(round(({x})::DOUBLE, 6)) AS BIGINT)"


def frame_sql(x: str, w: str, name: str) -> str:
    """Mean and standard deviation over the 50-row frame `w`."""
    spread = f"50 * sum({x} * {x}) OVER {w} - (sum({x}) OVER {w}) * (sum({x}) OVER {w})"
    root = f"sqrt(CASE WHEN {spread} < 0 THEN 0 ELSE ({spread})::DOUBLE END) / 50"
    if "HUGEINT" in x:  # whole numbers need no rounding
        return (f"CAST(trunc(sum({x}) OVER {w} / 50.0::DOUBLE) AS BIGINT) AS {name}_mean, "
                f"CAST(trunc({root}) AS BIGINT) AS {name}_std")
    return f"{cut(f'sum({x}) OVER {w} / 50.0::DOUBLE')} AS {name}_mean, {cut(root)} AS {name}_std"


def stats_sql(value: str, binding: str, whole: bool) -> str:
    x = value if not whole else f"CAST({value} AS HUGEINT)"
    return f"""WITH {binding}, {HISTORY}
SELECT client_ip, server_ip, seq, {frame_sql(x, 'w', value)},
  {cut(f'min({value}) OVER l')} AS {value}_min, {cut(f'max({value}) OVER l')} AS {value}_max
FROM series WHERE {value} IS NOT NULL
WINDOW w AS (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
       l AS (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _register_series(name: str, value: str, whole: bool, **binding) -> None:
    op = getattr(flows, name)

    @query(name, stats_sql(value, flow_packets_sql(**binding), whole))
    def run(spark, sf_dir):
        ends = [f"{value}_{e}" for e in ("mean", "std", "min", "max")]
        return op(flow_packets(spark, sf_dir, **binding)).select(*KEY, *ends)


for _name, _value, _whole, _binding in [
    ("rtt_stats", "rtt", True, {}),
    ("query_rate_stats", "query_rate", False, {"clients": 5, "per_second": 40}),
    ("byte_rate_stats", "byte_rate", False, {}),
    ("inter_query_stats", "inter_query", True, {}),
    ("updown_ratio_stats", "updown_ratio", False, {}),
    ("inflight_packet_stats", "inflight_packets", True, {}),
    ("inflight_byte_stats", "inflight_bytes", True, {}),
    ("forward_length_stats", "forward_length", True, {}),
    ("backward_length_stats", "backward_length", True, {}),
]:
    _register_series(_name, _value, _whole, **_binding)


@query("moving_stats", f"""
SELECT l_suppkey, id, {frame_sql('x', 'w', 'x')}, {cut('min(x) OVER l')} AS x_min, {cut('max(x) OVER l')} AS x_max
FROM (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, sum(l_quantity) AS x
      FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY l_suppkey ORDER BY id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
       l AS (PARTITION BY l_suppkey ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _moving_stats(spark, sf_dir):
    x = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
         .groupBy("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
         .agg(F.sum("l_quantity").alias("x")))
    return flows.moving_stats(x, "x", ["l_suppkey"], "id").drop("x")


PORTS_SQL = """port_rows AS (
  SELECT client_ip, server_ip, seq, src_port, row_number() OVER (PARTITION BY client_ip, server_ip, src_port ORDER BY seq) AS k
  FROM flow_packets WHERE direction = 'OUT'),
port_run AS (
  SELECT client_ip, server_ip, seq,
    sum(1) OVER f AS uses, sum(2 * k - 1) OVER f AS squares
  FROM port_rows
  WINDOW f AS (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

PORT_COLUMNS = ("CAST(trunc(uses / 50.0::DOUBLE) AS BIGINT) AS port_reuse_mean, "
                "CAST(trunc(sqrt((50 * squares - uses * uses)::DOUBLE) / 50) AS BIGINT) AS port_reuse_std")


@query("running_port_reuse", f"WITH {flow_packets_sql()}, {PORTS_SQL} "
                             f"SELECT client_ip, server_ip, seq, {PORT_COLUMNS} FROM port_run")
def _running_port_reuse(spark, sf_dir):
    return flows.running_port_reuse(flow_packets(spark, sf_dir)).select(*KEY, "port_reuse_mean", "port_reuse_std")


# Over 50 ports: the 50 highest ports seen so far, by brute force over each packet's past.
@query("running_port_reuse_many", f"""WITH {flow_packets_sql(ports=80)},
q AS (SELECT client_ip, server_ip, seq, src_port FROM flow_packets WHERE direction = 'OUT'),
past AS (SELECT a.client_ip, a.server_ip, a.seq, b.src_port, count(*) AS n
  FROM q a JOIN q b ON a.client_ip = b.client_ip AND a.server_ip = b.server_ip AND b.seq <= a.seq
  GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY client_ip, server_ip, seq ORDER BY src_port DESC) AS r FROM past),
port_run AS (SELECT client_ip, server_ip, seq, sum(n) AS uses, sum(n * n) AS squares
  FROM top WHERE r <= 50 GROUP BY ALL)
SELECT client_ip, server_ip, seq, {PORT_COLUMNS} FROM port_run""")
def _running_port_reuse_many(spark, sf_dir):
    return flows.running_port_reuse(flow_packets(spark, sf_dir, ports=80)).select(
        *KEY, "port_reuse_mean", "port_reuse_std")


@query("port_reuse", f"""WITH {flow_packets_sql(ports=80)},
uses AS (SELECT client_ip, server_ip, src_port, count(*) AS n FROM flow_packets WHERE direction = 'OUT' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY client_ip, server_ip ORDER BY src_port DESC) AS r FROM uses),
s AS (SELECT client_ip, server_ip, count(*) AS ports, sum(n) AS uses, sum(n * n) AS squares FROM top WHERE r <= 50
      GROUP BY ALL)
SELECT client_ip, server_ip, ports, {PORT_COLUMNS} FROM s""")
def _port_reuse(spark, sf_dir):
    return flows.port_reuse(flow_packets(spark, sf_dir, ports=80))


@query("flow_totals", f"""WITH {flow_packets_sql()}
SELECT client_ip, server_ip,
  CAST(sum(CASE WHEN direction = 'OUT' THEN len ELSE 0 END) AS BIGINT) AS bytes_sent,
  CAST(sum(CASE WHEN direction = 'IN' THEN len ELSE 0 END) AS BIGINT) AS bytes_received,
  CAST(sum(CASE WHEN direction = 'OUT' THEN 1 ELSE -1 END) AS BIGINT) AS inflight_packets,
  CAST(sum(CASE WHEN direction = 'OUT' THEN len ELSE -len END) AS BIGINT) AS inflight_bytes
FROM flow_packets GROUP BY ALL""")
def _flow_totals(spark, sf_dir):
    return flows.flow_totals(flow_packets(spark, sf_dir))


@query("asof_last_query", f"""WITH {flow_packets_sql()}, {HISTORY}
SELECT client_ip, server_ip, seq, greatest(0, t - coalesce(lq, t0)) AS since_last_query FROM hist WHERE direction = 'IN'""")
def _asof_last_query(spark, sf_dir):
    return flows.asof_last_query(flow_packets(spark, sf_dir)).select(*KEY, "since_last_query")


@query("asof_last_response", f"""WITH {flow_packets_sql()}, {HISTORY}
SELECT client_ip, server_ip, seq, greatest(0, t - coalesce(lr, t0)) AS since_last_response,
  greatest(0, t - coalesce(lq, t0)) AS since_last_query FROM hist WHERE direction = 'OUT'""")
def _asof_last_response(spark, sf_dir):
    return flows.asof_last_response(flow_packets(spark, sf_dir)).select(
        *KEY, "since_last_response", "since_last_query")


PREVIOUS_SQL = """prev AS (
  SELECT *, lag(client_port) OVER f AS pp, lag(msg_id) OVER f AS pi, lag(direction) OVER f AS pd
  FROM flow_packets WINDOW f AS (PARTITION BY client_ip, server_ip ORDER BY seq))"""


@query("match_previous", f"""WITH {flow_packets_sql()}, {PREVIOUS_SQL}
SELECT client_ip, server_ip, seq,
  CAST(coalesce(client_port = pp, false) AS INTEGER) AS same_port,
  CAST(coalesce(msg_id = pi, false) AS INTEGER) AS same_id,
  CAST(coalesce(direction = 'IN' AND pd = 'OUT' AND client_port = pp AND msg_id = pi, false) AS INTEGER) AS answers_previous
FROM prev""")
def _match_previous(spark, sf_dir):
    d = flows.match_previous(flow_packets(spark, sf_dir))
    flags = ["same_port", "same_id", "answers_previous"]
    return d.select(*KEY, *[F.col(c).cast("int").alias(c) for c in flags])


@query("source_pattern", f"""WITH {flow_packets_sql()}, {PREVIOUS_SQL},
counted AS (SELECT *, pp IS NOT NULL AS later FROM prev),
runs AS (SELECT *,
  sum(CASE WHEN later AND direction = 'IN' THEN 1 ELSE 0 END) OVER f AS transactions,
  1 + sum(CASE WHEN later AND direction = 'OUT' AND client_port = pp THEN 1 ELSE 0 END) OVER f AS port_repeats,
  sum(CASE WHEN later AND direction = 'OUT' AND msg_id <> pi THEN 1 ELSE 0 END) OVER f AS run
  FROM counted
  WINDOW f AS (PARTITION BY client_ip, server_ip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ids AS (SELECT *, sum(CASE WHEN later AND direction = 'OUT' AND msg_id = pi THEN 1 ELSE 0 END)
    OVER (PARTITION BY client_ip, server_ip, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    + CASE WHEN run = 0 THEN 1 ELSE 0 END AS id_repeats FROM runs)
SELECT client_ip, server_ip, seq, CAST(transactions AS BIGINT) AS transactions,
  CAST(port_repeats AS BIGINT) AS port_repeats, CAST(id_repeats AS BIGINT) AS id_repeats,
  CASE WHEN transactions > 1 AND (port_repeats > 5 OR id_repeats > 10) THEN 1 ELSE 0 END AS source_code
FROM ids""")
def _source_pattern(spark, sf_dir):
    return flows.source_pattern(flow_packets(spark, sf_dir)).select(
        *KEY, "transactions", "port_repeats", "id_repeats", "source_code")


def _features_sql(select: str, **binding) -> str:
    one_way = ["rtt", "query_rate", "updown_ratio"]
    means = ", ".join(f"{cut(f'sum({v}) OVER d / 50.0::DOUBLE')} AS {v}_mean" for v in one_way)
    sides = ["rtt_mean", "query_rate_mean", "updown_ratio_mean", "inter_query_mean", "inter_query_std",
             "forward_length_mean", "forward_length_std", "backward_length_mean", "backward_length_std"]
    fills = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER f, 0) AS {c}" for c in sides)
    ends = ", ".join(f"{cut(f'coalesce({e}({v}) OVER f, 0)')} AS {v}_{e}" for e in ("max", "min") for v in (
        "inter_query", "inflight_packets", "inflight_bytes", "forward_length", "backward_length"))
    flow = "PARTITION BY client_ip, server_ip"
    return f"""WITH {flow_packets_sql(**binding)}, {HISTORY}, {PORTS_SQL},
directed AS (SELECT *, {means}, {frame_sql('CAST(inter_query AS HUGEINT)', 'd', 'inter_query')},
  {frame_sql('CAST(forward_length AS HUGEINT)', 'z', 'forward_length')},
  {frame_sql('CAST(backward_length AS HUGEINT)', 'z', 'backward_length')}
  FROM series
  WINDOW d AS ({flow}, direction ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
         z AS ({flow}, direction, len > 0 ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
filled AS (SELECT d.client_ip, d.server_ip, d.seq, {fills}, {ends},
  {cut('sum(byte_rate) OVER w / 50.0::DOUBLE')} AS byte_rate_mean,
  {frame_sql('CAST(inflight_packets AS HUGEINT)', 'w', 'inflight_packets')},
  {frame_sql('CAST(inflight_bytes AS HUGEINT)', 'w', 'inflight_bytes')},
  coalesce(last_value(p.uses IGNORE NULLS) OVER f, 0) AS uses,
  coalesce(last_value(p.squares IGNORE NULLS) OVER f, 0) AS squares
  FROM directed d LEFT JOIN port_run p USING (client_ip, server_ip, seq)
  WINDOW f AS ({flow} ORDER BY d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w AS ({flow} ORDER BY d.seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
features AS (SELECT *, {PORT_COLUMNS} FROM filled)
SELECT client_ip, server_ip, seq, {select} FROM features"""


@query("flow_features", _features_sql(", ".join(flows.FEATURES)))
def _flow_features(spark, sf_dir):
    f = flows.flow_features(flow_packets(spark, sf_dir))
    return f.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in flows.FEATURES])


STEPS = {"steps_back": True}


@query("flow_features_clock_steps", _features_sql(", ".join(flows.FEATURES), **STEPS))
def _clock_steps(spark, sf_dir):
    """The same over a capture whose clock is set back now and then."""
    f = flows.flow_features(flow_packets(spark, sf_dir, **STEPS))
    return f.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in flows.FEATURES])
