"""Per-flow moving statistics over a table of packets.

A flow is a (client_ip, server_ip) pair. Packets carry `seq` (arrival number, unique within a flow), `ts`
(never going back along `seq`), `direction` (IN or OUT), `len` and `src_port`. A moving statistic is taken
over the last 50 values pushed to a series, with missing slots counted as 0: mean and standard deviation
always divide by 50. Minimum and maximum run over the whole life of the flow. All are cut to whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.plans.skew import CHUNK_ROWS, Chunked

FLOW = ("client_ip", "server_ip")
SLOTS = 50

# Order of the 26 columns of a flow feature vector (fixed values).
FEATURES = (
    "rtt_mean", "query_rate_mean", "byte_rate_mean",
    "inter_query_max", "inter_query_min", "inter_query_mean", "inter_query_std",
    "updown_ratio_mean",
    "inflight_packets_max", "inflight_packets_min", "inflight_packets_mean", "inflight_packets_std",
    "inflight_bytes_max", "inflight_bytes_min", "inflight_bytes_mean", "inflight_bytes_std",
    "forward_length_max", "forward_length_min", "forward_length_mean", "forward_length_std",
    "port_reuse_mean", "port_reuse_std",
    "backward_length_max", "backward_length_min", "backward_length_mean", "backward_length_std",
)


def _out() -> Column:
    return F.col("direction") == "OUT"


def _in() -> Column:
    return F.col("direction") == "IN"


# ---- moving statistics -----------------------------------------------------------------------------

def _whole(x: Column) -> Column:
    """Cut toward zero, after removing float noise next to a whole number."""
    return F.round(x, 6).cast("long")


def _wide(x: Column) -> Column:
    """Balances and use counts of a hot flow outgrow 64 bits when squared."""
    return x.cast("decimal(19,0)")


def _whole_mean(total: Column, n: int) -> Column:
    """Quotient cut toward zero."""
    return ((total - total % n) / n).cast("long")


def _whole_std(total: Column, squares: Column, n: int) -> Column:
    """From exact sums, as the spread of whole numbers is a whole number."""
    total = _wide(total)
    return (F.sqrt((n * squares - total * total).cast("double")) / n).cast("long")


def _sums(value: str, window, wide: bool = True) -> dict[str, Column]:
    """Running sum and sum of squares of a whole-number series."""
    run = window.rowsBetween(Window.unboundedPreceding, 0)
    x = _wide(F.col(value)) if wide else F.col(value)
    return {f"_s_{value}": F.sum(value).over(run), f"_q_{value}": F.sum((x * x).cast("decimal(38,0)" if wide else "long")).over(run)}


def _framed(columns: Sequence[str], window, n: int) -> dict[str, Column]:
    """Sums over the last n rows, from running sums: exact for whole numbers, and one step per row."""
    return {f"{c}_f": F.col(c) - F.coalesce(F.lag(c, n).over(window), F.lit(0)) for c in columns}


def _with_frames(df: DataFrame, series: Sequence[str], window, n: int, wide: bool = True) -> DataFrame:
    """Sums of the last n values and squares of whole-number series, as `_s_<series>_f` and `_q_<series>_f`."""
    df = df.withColumns({c: x for v in series for c, x in _sums(v, window, wide).items()})
    return df.withColumns(_framed([f"_{k}_{v}" for v in series for k in "sq"], window, n))


def _whole_stats(value: str, n: int, name: str) -> dict[str, Column]:
    """Statistics over the last n rows, from the columns of `_with_frames`."""
    total = F.col(f"_s_{value}_f")
    return {f"{name}_mean": _whole_mean(total, n), f"{name}_std": _whole_std(total, F.col(f"_q_{value}_f"), n)}


def _frame_stats(value: str, window, n: int, name: str) -> dict[str, Column]:
    """Statistics of a fractional series; each frame is summed afresh, which keeps noise from building up."""
    frame = window.rowsBetween(-(n - 1), 0)
    total, squares = F.sum(value).over(frame), F.sum(F.col(value) * F.col(value)).over(frame)
    spread = n * squares - total * total  # float noise can take it just below 0
    root = F.sqrt(F.when(spread < 0, 0).otherwise(spread))
    return {f"{name}_mean": _whole(total / n), f"{name}_std": _whole(root / n)}


def moving_stats(df: DataFrame, value: str, by: Sequence[str], order: str, n: int = SLOTS,
                 name: str | None = None, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Mean and standard deviation over the last `n` values (missing ones count as 0), minimum and maximum
    over all values so far. Adds four columns named after `name`."""
    name = name or value
    k = Chunked(df, by, order, chunk_rows)
    k.scan({f"{name}_min": ("min", F.col(value), True), f"{name}_max": ("max", F.col(value), True)})
    k.with_halo(n - 1)
    if df.schema[value].dataType.typeName() in ("long", "integer", "short", "byte"):
        k.df = _with_frames(k.df, [value], k.window(), n).withColumns(_whole_stats(value, n, name))
        k.df = k.df.drop(*[f"_{x}_{value}{end}" for x in "sq" for end in ("", "_f")])
    else:
        k.df = k.df.withColumns(_frame_stats(value, k.window(), n, name))
    k.without_halo()
    k.df = k.df.withColumns({f"{name}_min": _whole(F.col(f"{name}_min")), f"{name}_max": _whole(F.col(f"{name}_max"))})
    return k.done()


# ---- values pushed to the series -------------------------------------------------------------------

def _clock(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.unix_seconds("ts"))


def _history(k: Chunked) -> Chunked:
    """Last query and response times before each packet, and running byte and packet totals."""
    signed = F.when(_out(), F.lit(1)).otherwise(F.lit(-1))
    length = F.col("len").cast("long")
    return k.scan({
        "flow_start": ("min", F.col("t"), True),
        "last_query": ("max", F.when(_out(), F.col("t")), False),
        "last_response": ("max", F.when(_in(), F.col("t")), False),
        "bytes_sent": ("sum", F.when(_out(), length).otherwise(0), True),
        "bytes_received": ("sum", F.when(_in(), length).otherwise(0), True),
        "inflight_packets": ("sum", signed.cast("long"), True),
        "inflight_bytes": ("sum", signed * length, True),
    })


def _values(df: DataFrame) -> DataFrame:
    # a clock that steps back counts as no time passed
    since_query = F.greatest(F.lit(0), F.col("t") - F.coalesce("last_query", "flow_start"))
    since_response = F.greatest(F.lit(0), F.col("t") - F.coalesce("last_response", "flow_start"))
    length = F.col("len").cast("long")
    return df.withColumns({
        "rtt": F.when(_in(), since_query),
        "query_rate": F.when(_out(), 2.0 / (1 + since_query)),
        "byte_rate": 1000.0 * length / (1 + since_query),
        "inter_query": F.when(_out(), since_response),
        "updown_ratio": F.when(_out(), (1.0 + F.col("bytes_sent")) / (1 + F.col("bytes_received"))),
        "forward_length": F.when(_out() & (length > 0), length),
        "backward_length": F.when(_in() & (length > 0), length),
    })


def packet_series(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """One row per packet with the value it pushes to each series (null where it pushes none)."""
    return _series(packets, chunk_rows)[0]


def _series(packets: DataFrame, chunk_rows: int | None) -> tuple[DataFrame, bool]:
    """The series, and whether some flow had to be cut into chunks."""
    k = _history(Chunked(_clock(packets), FLOW, "seq", chunk_rows, probe=packets))
    return _values(k.done()).drop("flow_start", "last_query", "last_response"), k.split


def _series_stats(packets: DataFrame, value: str, chunk_rows: int | None) -> DataFrame:
    series, hot = _series(packets, chunk_rows)
    pushed = series.where(F.col(value).isNotNull()).select(*FLOW, "seq", value)
    return moving_stats(pushed, value, FLOW, "seq", chunk_rows=chunk_rows if hot else None)


def rtt_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Seconds from the last query to each response."""
    return _series_stats(packets, "rtt", chunk_rows)


def query_rate_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "query_rate", chunk_rows)


def byte_rate_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "byte_rate", chunk_rows)


def inter_query_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Seconds from the last response to each query."""
    return _series_stats(packets, "inter_query", chunk_rows)


def updown_ratio_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "updown_ratio", chunk_rows)


def inflight_packet_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "inflight_packets", chunk_rows)


def inflight_byte_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "inflight_bytes", chunk_rows)


def forward_length_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "forward_length", chunk_rows)


def backward_length_stats(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    return _series_stats(packets, "backward_length", chunk_rows)


# ---- as-of reads of the flow -----------------------------------------------------------------------

def asof_last_query(packets: DataFrame, unit: str = "seconds", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """For each response, the time since the flow's last query (since the flow's start if none)."""
    k = Chunked(_clocked(packets, unit), FLOW, "seq", chunk_rows)
    k.scan({"_start": ("min", F.col("t"), True), "_last": ("max", F.when(_out(), F.col("t")), False)})
    return (k.df.where(_in()).withColumn("since_last_query", F.col("t") - F.coalesce("_last", "_start"))
            .drop("_start", "_last", "_chunk"))


def asof_last_response(packets: DataFrame, unit: str = "seconds", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """For each query, the time since the flow's last response and since its last query."""
    k = Chunked(_clocked(packets, unit), FLOW, "seq", chunk_rows)
    k.scan({"_start": ("min", F.col("t"), True),
            "_q": ("max", F.when(_out(), F.col("t")), False),
            "_r": ("max", F.when(_in(), F.col("t")), False)})
    return (k.df.where(_out())
            .withColumns({"since_last_response": F.col("t") - F.coalesce("_r", "_start"),
                          "since_last_query": F.col("t") - F.coalesce("_q", "_start")})
            .drop("_start", "_q", "_r", "_chunk"))


def _clocked(packets: DataFrame, unit: str) -> DataFrame:
    units = {"seconds": F.unix_seconds, "millis": F.unix_millis, "micros": F.unix_micros}
    if unit not in units:
        raise ValueError(f"unit must be one of {sorted(units)}")
    return packets.withColumn("t", units[unit]("ts"))


def client_port() -> Column:
    return F.when(_out(), F.col("src_port")).otherwise(F.col("dst_port"))


def match_previous(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Compare each packet's client port and message id with those of the flow's previous packet."""
    k = Chunked(packets, FLOW, "seq", chunk_rows)
    k.previous("_prev", F.struct(client_port().alias("port"), F.col("msg_id").alias("id"),
                                 F.col("direction").alias("direction")))
    return k.df.withColumns({
        "same_port": F.coalesce(client_port() == F.col("_prev.port"), F.lit(False)),
        "same_id": F.coalesce(F.col("msg_id") == F.col("_prev.id"), F.lit(False)),
        "answers_previous": F.coalesce(
            _in() & (F.col("_prev.direction") == "OUT") & (client_port() == F.col("_prev.port"))
            & (F.col("msg_id") == F.col("_prev.id")), F.lit(False)),
    }).drop("_prev", "_chunk")


# ---- port reuse ------------------------------------------------------------------------------------

def port_reuse(packets: DataFrame) -> DataFrame:
    """Final state per flow: uses of each source port, over the 50 highest ports."""
    uses = packets.where(_out()).groupBy(*FLOW, "src_port").agg(F.count(F.lit(1)).alias("uses"))
    top = Window.partitionBy(*FLOW).orderBy(F.col("src_port").desc())
    kept = uses.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= SLOTS)
    total, squares = F.sum("uses"), F.sum(_wide(F.col("uses")) * _wide(F.col("uses")))
    return kept.groupBy(*FLOW).agg(
        F.count(F.lit(1)).alias("ports"),
        _whole_mean(total, SLOTS).alias("port_reuse_mean"),
        _whole_std(total, squares, SLOTS).alias("port_reuse_std"))




def retired_ports(packets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """When each source port of a flow falls out of the `slots` highest ports seen so far.

    That is the arrival of the `slots`-th distinct higher port. A group holds one row per distinct port of
    a flow, so at most 65,536 rows.
    """
    import heapq

    seen = packets.where(_out()).groupBy(*FLOW, "src_port").agg(F.min("seq").alias("seq"))
    ports = F.count(F.lit(1)).over(Window.partitionBy(*FLOW))
    crowded = seen.withColumn("_ports", ports).where(F.col("_ports") > slots).drop("_ports")

    def retire(pdf: pd.DataFrame) -> pd.DataFrame:
        earliest: list[int] = []  # max-heap of the `slots` earliest arrivals among higher ports
        rows = []
        for row in pdf.sort_values("src_port", ascending=False).itertuples(index=False):
            arrival = int(row.seq)
            if len(earliest) == slots:
                # a port that arrives after `slots` higher ones never enters
                rows.append((row.client_ip, row.server_ip, row.src_port, -earliest[0]))
                heapq.heappushpop(earliest, -arrival)
            else:
                heapq.heappush(earliest, -arrival)
        return pd.DataFrame(rows, columns=["client_ip", "server_ip", "src_port", "seq"])

    types = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in (*FLOW, "src_port", "seq"))
    return crowded.groupBy(*FLOW).applyInPandas(retire, schema)


def _with_port_totals(packets: DataFrame, chunk_rows: int | None) -> Chunked:
    """Running sum of uses and of squared uses over the ports held, as `_uses` and `_squares`.

    A query adds one use of its port while the port is held. The row at which a port falls out takes its
    uses away again; those rows come in as marked extra rows, so no join touches the packets.
    """
    gone = retired_ports(packets).select("*", F.lit(True).alias("_gone"))
    rows = packets.withColumn("_gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
    rows = rows.withColumn("_turn", F.when(F.col("_gone"), 0).otherwise(1))
    rows = rows.withColumn("_port", F.when(_out() | F.col("_gone"), F.col("src_port")))
    k = Chunked(rows, FLOW, "seq", chunk_rows, tie=["_turn"], probe=packets)
    used = (~F.col("_gone") & _out()).cast("long")
    k.scan({"_n": ("sum", F.coalesce(used, F.lit(0)), True),
            "_dead": ("max", F.col("_gone").cast("int"), True)}, extra=["_port"])
    n = _wide(F.col("_n"))
    alive = ~F.col("_gone") & _out() & (F.col("_dead") == 0)
    dead = F.col("_gone")
    return k.scan({
        "_uses": ("sum", F.when(dead, -F.col("_n")).when(alive, F.lit(1)).otherwise(0), True),
        "_squares": ("sum", F.when(dead, -(n * n)).when(alive, 2 * n - 1).otherwise(0).cast("decimal(38,0)"), True),
    })


def _port_columns() -> dict[str, Column]:
    return {"port_reuse_mean": _whole_mean(F.col("_uses"), SLOTS),
            "port_reuse_std": _whole_std(F.col("_uses"), F.col("_squares"), SLOTS)}


_PORT_WORK = ("_gone", "_turn", "_port", "_n", "_dead", "_uses", "_squares")


def running_port_reuse(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Port reuse at each query: uses so far of each of the 50 highest source ports seen."""
    k = _with_port_totals(packets, chunk_rows)
    return k.df.where(~F.col("_gone") & _out()).withColumns(_port_columns()).drop(*_PORT_WORK, "_chunk")


def flow_totals(packets: DataFrame) -> DataFrame:
    """Bytes sent and received and the open packet and byte balance of each flow."""
    length = F.col("len").cast("long")
    sent, received = F.sum(F.when(_out(), length).otherwise(0)), F.sum(F.when(_in(), length).otherwise(0))
    out, back = F.sum(F.when(_out(), 1).otherwise(0)), F.sum(F.when(_in(), 1).otherwise(0))
    return packets.groupBy(*FLOW).agg(
        sent.alias("bytes_sent"), received.alias("bytes_received"),
        (out - back).alias("inflight_packets"), (sent - received).alias("inflight_bytes"))


# ---- the whole vector ------------------------------------------------------------------------------

def flow_features(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The 26 flow features at every packet, as columns and as the array `features`.

    A series pushed in one direction only is framed within that direction and then filled forward over
    the flow. All windows share one hash exchange on the flow key.
    """
    keep = packets.columns
    k = _with_port_totals(_clock(packets), chunk_rows)
    k.df = k.df.where(~F.col("_gone")).drop("_gone", "_turn", "_port", "_n", "_dead")
    k.tie = []
    k.df = _values(_history(k).df).drop("flow_start", "last_query", "last_response",
                                        "bytes_sent", "bytes_received")
    k.scan({f"{s}_{end}": (end, F.col(s), True) for s in
            ("inter_query", "inflight_packets", "inflight_bytes", "forward_length", "backward_length")
            for end in ("min", "max")})
    k.df = k.df.withColumn("_sized", F.col("len") > 0)
    k.with_halo(SLOTS, ["direction", "_sized"])

    both, one_way, sized = k.window(), k.window("direction"), k.window("direction", "_sized")
    recent = one_way.rowsBetween(-(SLOTS - 1), 0)
    lengths = ("forward_length", "backward_length")
    k.df = _with_frames(k.df, lengths, sized, SLOTS, wide=False)
    k.df = k.df.withColumns({c: x for v in lengths for c, x in _whole_stats(v, SLOTS, v).items()})
    k.df = _with_frames(k.df, ["rtt", "inter_query"], one_way, SLOTS)
    k.df = k.df.withColumns({
        "rtt_mean": _whole_mean(F.col("_s_rtt_f"), SLOTS),
        **_whole_stats("inter_query", SLOTS, "inter_query"),
        "query_rate_mean": _whole(F.sum("query_rate").over(recent) / SLOTS),
        "updown_ratio_mean": _whole(F.sum("updown_ratio").over(recent) / SLOTS),
    })
    fill = both.rowsBetween(Window.unboundedPreceding, 0)
    one_sided = ["rtt_mean", "query_rate_mean", "updown_ratio_mean", "inter_query_mean", "inter_query_std",
                 "forward_length_mean", "forward_length_std", "backward_length_mean", "backward_length_std"]
    k.df = _with_frames(k.df, ["inflight_packets", "inflight_bytes"], both, SLOTS)
    k.df = k.df.withColumns({
        "byte_rate_mean": _whole(F.sum("byte_rate").over(both.rowsBetween(-(SLOTS - 1), 0)) / SLOTS),
        **_whole_stats("inflight_packets", SLOTS, "inflight_packets"),
        **_whole_stats("inflight_bytes", SLOTS, "inflight_bytes"),
        **{c: F.last(c, ignorenulls=True).over(fill) for c in one_sided},
        **_port_columns(),
    })
    k.without_halo()
    vector = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in FEATURES])
    return k.df.select(*keep, *[F.col(c).cast("long").alias(c) for c in FEATURES], vector.alias("features"))


# ---- repeated ports and message ids ----------------------------------------------------------------

# Source pattern codes (fixed values).
SOURCE_OK, SOURCE_PORT_BOUND, SOURCE_IP_SPOOFED = 0, 1, 2


def source_pattern(packets: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Counts of repeated source ports and message ids, and the port-bound flag.

    Queries with the port of the packet before add to the port count, which never resets. Queries with the
    id of the packet before add to the id count; any other query sets it back to 0.
    """
    k = Chunked(packets, FLOW, "seq", chunk_rows)
    k.previous("_prev", F.struct(client_port().alias("port"), F.col("msg_id").alias("id")))
    later = F.col("_prev").isNotNull()
    same_id = later & _out() & (F.col("msg_id") == F.col("_prev.id"))
    k.scan({
        "transactions": ("sum", F.when(later & _in(), 1).otherwise(0), True),
        "_ports": ("sum", F.when(later & _out() & (client_port() == F.col("_prev.port")), 1).otherwise(0), True),
        "_ids": ("sum", F.when(same_id, 1).otherwise(0), True),
    })
    broken = later & _out() & (F.col("msg_id") != F.col("_prev.id"))
    k.scan({"_base": ("max", F.when(broken, F.col("_ids")), True)})
    df = k.df.withColumns({
        "port_repeats": F.col("_ports") + 1,
        "id_repeats": F.coalesce(F.col("_ids") - F.col("_base"), F.col("_ids") + 1),
    })
    bound = (F.col("transactions") > 1) & ((F.col("port_repeats") > 5) | (F.col("id_repeats") > 10))
    return df.withColumn("source_code", F.when(bound, SOURCE_PORT_BOUND).otherwise(SOURCE_OK)).drop(
        "_prev", "_ports", "_ids", "_base", "_chunk")
