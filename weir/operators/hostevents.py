"""Host events: socket, process and file activity as 6-wide vectors, and their aggregation.

Slot 0 of a vector holds the code byte; feature i of an event sits in slot i + 1.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators import profiles as P
from weir.operators.lookups import host_reputation
from weir.schemas import EVENT_WIDTH

DRAIN = "12 seconds"
COLUMNS = ("ts", "seq", "code", "name", "cause", "vec", "agg_col")

# Feature numbers (fixed values).
NET_SOCKETS, NET_BIND, NET_CONN, NET_DATA = 1, 2, 3, 4
PROC_MEM, PROC_CPU = 2, 3
FS_WRITE, FS_READ = 1, 2

# Sensitivity of the top folder by action (fixed values); '' stands for any other folder.
PATH_RULES = (
    ("read", "dev", 5), ("read", "etc", 2), ("read", "", 1),
    ("write", "dev", 3), ("write", "root", 15), ("write", "bin", 8), ("write", "lib", 8), ("write", "etc", 6), ("write", "", 1),
    ("create", "root", 10), ("create", "bin", 10), ("create", "lib", 10), ("create", "", 2),
)
# File actions: class of rules, name prefix, feature (fixed values).
FILE_ACTIONS = {
    "ACCESS": ("read", "ACC:", FS_READ), "OPEN": ("read", "OPN:", FS_READ),
    "ATTRIB": ("write", "ATT:", FS_WRITE), "CLOSE_WRITE": ("write", "WRT:", FS_WRITE), "MODIFY": ("write", "CHG:", FS_WRITE),
    "CREATE": ("create", "NEW:", FS_WRITE), "DELETE": ("create", "DEL:", FS_WRITE),
}


class EventMapper(Protocol):
    """A source of host events: a table (or stream) of activity to the host event columns."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def code_byte(code: Column) -> Column:
    """A byte fixed by the event code."""
    return F.pmod(F.crc32(code.cast("binary")), F.lit(256)).cast("double")


def event_vector(code: Column, features: Mapping[int, Column]) -> Column:
    """The 6-wide vector: the code byte, then the features by number."""
    if any(not 0 <= i < EVENT_WIDTH - 1 for i in features):
        raise ValueError(f"feature numbers go from 0 to {EVENT_WIDTH - 2}")
    slots = [F.coalesce(features[i].cast("double"), F.lit(0.0)) if i in features else F.lit(0.0)
             for i in range(EVENT_WIDTH - 1)]
    return F.array(code_byte(code), *slots)


def build_events(df: DataFrame, features: Mapping[int, Column], code: str = "code") -> DataFrame:
    return df.withColumn("vec", event_vector(F.col(code), features))


def _event(code: Column, name: Column, feature: int, value: Column, folds: bool) -> Column:
    return F.struct(code.alias("code"), name.alias("name"), event_vector(code, {feature: value}).alias("vec"),
                    F.lit(feature + 1 if folds else None).cast("int").alias("agg_col"))


def socket_events(sockets: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Six events per connection. Those of a user and program, of a remote host or port and of a protocol fold.

    `sockets` has the connection fields and ts, seq.
    """
    df = host_reputation(sockets, history)
    local = F.col("local_port").try_cast("int")
    remote = F.when(F.col("foreign_port") == "*", 0).otherwise(F.col("foreign_port").try_cast("int"))
    queued = F.col("recv_q").try_cast("double") + F.col("send_q").try_cast("double")
    stated, plain = F.concat(F.lit("net"), F.col("state")), F.lit("net")
    port = local.cast("string")
    known = F.col("reputation")
    six = F.array(
        _event(stated, F.concat(F.lit("L"), "user", port), NET_BIND, local, False),
        _event(stated, F.concat(F.lit("L"), "user", "program"), NET_BIND, local, True),
        _event(stated, F.concat(F.lit("LQ"), "recv_q", "send_q"), NET_DATA, queued, False),
        _event(plain, F.concat(F.lit("R"), port, "foreign_address"), NET_CONN, known, True),
        _event(plain, F.concat(F.lit("R"), "proto", remote.cast("string")), NET_CONN, known, True),
        _event(plain, F.concat(F.lit("S"), "proto"), NET_SOCKETS, F.lit(1), True),
    )
    return df.select("ts", "seq", F.posexplode(six).alias("_i", "_e")).select(
        "ts", (F.col("seq") * 6 + F.col("_i")).alias("seq"), "_e.code", "_e.name", F.lit("_un_").alias("cause"),
        "_e.vec", "_e.agg_col")


def start_bucket(ts: Column, elapsed: Column) -> Column:
    """When a process started, in units of 300 seconds."""
    return (F.unix_seconds(ts) - elapsed.cast("double")) / 300


def process_events(processes: DataFrame) -> DataFrame:
    """One labelled event per process, with its memory and processor share; the cause is the command."""
    code = F.lit("proc")
    return processes.select(
        "ts", "seq", code.alias("code"), F.concat(F.lit("etimes"), F.col("etimes").cast("string")).alias("name"),
        F.col("command").alias("cause"), event_vector(code, {PROC_MEM: F.col("pmem"), PROC_CPU: F.col("pcpu")}).alias("vec"),
        F.lit(None).cast("int").alias("agg_col"), start_bucket(F.col("ts"), F.col("etimes")).alias("start_bucket"))


def path_sensitivity(path: Column, action: Column, rules=PATH_RULES) -> Column:
    """Sensitivity of a path's top folder for a class of actions (read, write, create). Other classes fail."""
    top = F.get(F.split(path, "/"), F.lit(1))
    out = F.when(~action.isin(*{r[0] for r in rules}), F.raise_error(F.lit("unknown class of action")).cast("int"))
    for kind, folder, level in rules:
        out = out.when((action == kind) & (top == folder) if folder else action == kind, level)
    return out


def file_events(activity: DataFrame, rules=PATH_RULES) -> DataFrame:
    """File activity (ts, seq, action, path) to events of code `fs`; actions that are not watched are left out."""
    action = F.col("action")

    def of(i: int) -> Column:
        out = None
        for name, spec in FILE_ACTIONS.items():
            out = F.when(action == name, spec[i]) if out is None else out.when(action == name, spec[i])
        return out

    watched = activity.where(action.isin(*FILE_ACTIONS)).withColumns({"_kind": of(0), "_prefix": of(1), "_slot": of(2)})
    level = path_sensitivity(F.col("path"), F.col("_kind"), rules)
    code = F.lit("fs")
    vec = event_vector(code, {s: F.when(F.col("_slot") == s, level) for s in (FS_WRITE, FS_READ)})
    return watched.select("ts", "seq", code.alias("code"), F.concat("_prefix", "path").alias("name"),
                          F.lit("_un_").alias("cause"), vec.alias("vec"), (F.col("_slot") + 1).alias("agg_col"))


def union_events(*streams: DataFrame) -> DataFrame:
    first, *rest = [s.select(*COLUMNS) for s in streams]
    for s in rest:
        first = first.unionByName(s)
    return first


def _fold(events: DataFrame, *keys: Column) -> DataFrame:
    """Folding events of one code and name: the first event with the marked slot summed over all."""
    slot = F.element_at("vec", F.col("agg_col") + 1)
    # the key can hold a third of all rows: both aggregates combine before the shuffle
    grouped = events.where(F.col("agg_col").isNotNull()).groupBy(*keys, "code", "name").agg(
        F.min_by(F.struct("ts", "seq", "cause", "vec", "agg_col"), "seq").alias("_f"), F.sum(slot).alias("_s"))
    folded = F.transform("_f.vec", lambda v, i: F.when(i == F.col("_f.agg_col"), F.col("_s")).otherwise(v))
    return grouped.select(*[F.col(c) for c in grouped.columns if c not in ("code", "name", "_f", "_s")],
                          "_f.ts", "_f.seq", "code", "name", "_f.cause", folded.alias("vec"), "_f.agg_col")


def aggregate_events(events: DataFrame, window: str | None = DRAIN) -> DataFrame:
    """Fold the events that carry a summed slot per window, code and name; others pass unchanged.

    Works on a batch table and on a stream with a watermark on `ts`.
    """
    rows = events.select(*COLUMNS)
    single = rows.where(F.col("agg_col").isNull())
    if window is None:
        return _fold(rows).unionByName(single)
    folded = _fold(rows, F.window("ts", window).alias("_w")).withColumn("window_start", F.col("_w.start")).drop("_w")
    return folded.unionByName(single.withColumn("window_start", F.window("ts", window)["start"]))


def drain_events(events: DataFrame, window: str = DRAIN) -> DataFrame:
    """What each poll cycle hands over: vector, name and cause of the folded events."""
    return aggregate_events(events, window).select("window_start", "vec", "name", "cause")


def collect_features(events: DataFrame, window: str | None = DRAIN) -> DataFrame:
    return aggregate_events(events, window).select("vec")


# ---- processes -------------------------------------------------------------------------------------

RANKED = {"bsdstart", "pmem", "pcpu", "etimes"}


def top_processes(df: DataFrame, by: str, k: int = 200, snapshot: str = "snapshot", tie: str = "command") -> DataFrame:
    """The k largest processes of each snapshot by a column, as numbers. The limit is also applied before the
    shuffle."""
    if by not in RANKED:
        raise ValueError(f"by must be one of {sorted(RANKED)}")
    w = Window.partitionBy(snapshot).orderBy(F.col(by).cast("double").desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- clusters --------------------------------------------------------------------------------------

def fit_event_profile(events: DataFrame, size: int = 10) -> P.Profile:
    return P.fit_profile(events, "flat", size=size, vec="vec")


def lead_event_profile(events: DataFrame, radius: float) -> P.Profile:
    """The leaders of a training period's events, in order of time, none within `radius` of an earlier one."""
    return P.fit_profile(events, "leader", threshold=radius, vec="vec", order_by="ts", id_col="seq")


def cluster_events(events: DataFrame, profile: P.Profile) -> tuple[DataFrame, P.Profile]:
    """Assign events, growing the profile where they are too far, by the leaders of those events in order of time; `grown` marks
    events in new clusters."""
    profile, near = P.grow_profile(profile, events, leaders=("ts", "seq"))
    return near.withColumn("grown", F.col("cid") >= profile.init_size), profile
