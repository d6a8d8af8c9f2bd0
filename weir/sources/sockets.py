"""Socket snapshots: text lines to connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INET_FIELDS = ("proto", "recv_q", "send_q", "local_address", "local_port", "foreign_address", "foreign_port", "state",
               "user", "inode", "pid", "program")
NT_FIELDS = ("proto", "local_address", "local_port", "foreign_address", "foreign_port", "state", "pid", "program")
UNIX_FIELDS = ("proto", "ref_count", "flags", "type", "state", "inode", "pid", "program", "path")


def _field(parts: Column, i: Column | int) -> Column:
    return F.get(parts, i if isinstance(i, Column) else F.lit(i))


def _address(text: Column) -> tuple[Column, Column]:
    """Address and port split at the last colon; a text without one keeps all but its last character."""
    at = F.length(text) - F.locate(":", F.reverse(text)) + 1
    has = F.locate(":", text) > 0
    return (F.when(has, F.substring(text, F.lit(1), at - 1)).otherwise(F.substring(text, F.lit(1), F.length(text) - 1)),
            F.when(has, F.substring(text, at + 1, F.length(text))).otherwise(text))


def _program(text: Column) -> tuple[Column, Column]:
    split = F.split(text, "/", 2)
    has = F.contains(text, F.lit("/"))
    return F.when(has, split[0]).otherwise(""), F.when(has, split[1]).otherwise("")


def parse_socket_snapshot(lines: DataFrame, layout: str = "linux", text: str = "value") -> DataFrame:
    """Connections of a snapshot; other columns of the input (host, snapshot time) are kept.

    `linux` and `unix` take one connection per line; `nt` takes a whole snapshot text per row, in which one
    connection covers one to three lines.
    """
    parsers = {"linux": _linux, "unix": _unix, "nt": _nt}
    if layout not in parsers:
        raise ValueError(f"layout must be one of {sorted(parsers)}")
    return parsers[layout](lines, text)


def _linux(lines: DataFrame, text: str) -> DataFrame:
    keep = [c for c in lines.columns if c != text]
    rows = lines.where(F.trim(text).rlike("^(tcp|udp|raw)")).withColumn("_f", F.split(F.trim(text), " +"))
    f = F.col("_f")
    # datagram protocols name a state only when they are connected: the column after the addresses is then no user id
    no_state = F.upper(f[0]).startswith("UDP") & ~F.coalesce(_field(f, 5).rlike("^[A-Z_0-9]*[A-Z][A-Z_0-9]*$"), F.lit(False))
    i = F.when(no_state, 5).otherwise(6)
    local, lport = _address(f[3])
    foreign, fport = _address(f[4])
    pid, program = _program(F.coalesce(_field(f, i + 2), F.lit("-")))
    values = (f[0], f[1], f[2], local, lport, foreign, fport, F.when(no_state, "").otherwise(_field(f, 5)),
              _field(f, i), _field(f, i + 1), pid, program)
    return rows.where(F.size(f) >= 7).select(*keep, *[v.alias(n) for n, v in zip(INET_FIELDS, values)])


def _unix(lines: DataFrame, text: str) -> DataFrame:
    keep = [c for c in lines.columns if c != text]
    head = r"^\s*(unix)\s+(\S+)\s+\[\s*(.*?)\s*\]\s+(\S+)\s+(.*)$"
    rows = lines.where(F.col(text).rlike(head)).withColumn(
        "_f", F.split(F.trim(F.regexp_extract(text, head, 5)), " +"))
    kind, f = F.regexp_extract(text, head, 4), F.col("_f")
    dgram = F.upper(kind) == "DGRAM"
    i = F.when(dgram, 0).otherwise(1)
    pid, program = _program(F.coalesce(_field(f, i + 1), F.lit("-")))
    path = F.array_join(F.slice(f, i + 3, F.greatest(F.size(f) - i - 2, F.lit(0))), " ")
    values = (F.regexp_extract(text, head, 1), F.regexp_extract(text, head, 2), F.regexp_extract(text, head, 3), kind,
              F.when(dgram, "").otherwise(f[0]), _field(f, i), pid, program, path)
    return rows.select(*keep, *[v.alias(n) for n, v in zip(UNIX_FIELDS, values)])


def _nt(snapshots: DataFrame, text: str) -> DataFrame:
    keep = [c for c in snapshots.columns if c != text]
    # a connection starts at a line with TCP or UDP; lines up to the next such line belong to it
    body = F.regexp_replace(F.col(text), "\r", "")
    entries = F.split(F.regexp_replace(body, r"(?m)^[ \t]*(TCP|UDP)", "\u0001$1"), "\u0001")
    rows = snapshots.select(*keep, F.explode(F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0)))).alias("_e"))
    rows = rows.withColumn("_l", F.filter(F.transform(F.split("_e", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    rows = rows.withColumn("_f", F.split(F.col("_l")[0], " +"))
    f, more = F.col("_f"), F.slice("_l", 2, 2)
    # datagram protocols name a state only when they are connected: the column after the addresses is then no user id
    no_state = F.upper(f[0]).startswith("UDP") & ~F.coalesce(_field(f, 5).rlike("^[A-Z_0-9]*[A-Z][A-Z_0-9]*$"), F.lit(False))
    local, lport = _address(f[1])
    foreign, fport = _address(f[2])
    first = _field(more, 0)
    program = (F.when(F.size(more) == 0, "").when(first.startswith("["), first)
               .otherwise(F.concat(first, F.coalesce(_field(more, 1), F.lit("")))))
    values = (f[0], local, lport, foreign, fport, F.when(no_state, "").otherwise(_field(f, 3)),
              _field(f, F.when(no_state, 3).otherwise(4)), program)
    return rows.where(F.size(f) >= 4).select(*keep, *[v.alias(n) for n, v in zip(NT_FIELDS, values)])


def write_connections(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("sep", "|").option("header", True).csv(path)


def select_field(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}; the table has {df.columns}")
    return df.select(name)


def find_keyword(df: DataFrame, keyword: str) -> DataFrame:
    """Rows with the keyword in any text column."""
    if not isinstance(keyword, str):
        raise TypeError("the keyword must be text")
    texts = [F.col(c) for c, t in df.dtypes if t == "string"]
    return df.where(F.exists(F.array(*texts), lambda v: F.coalesce(F.contains(v, F.lit(keyword)), F.lit(False))))


FAMILIES = {"tcp": ("tcp", "tcp6", "tcpv6"), "udp": ("udp", "udp6", "udpv6"), "raw": ("raw", "raw6"), "unix": ("unix",)}


def filter_family(df: DataFrame, families: list[str], listening: bool | None = None) -> DataFrame:
    """Connections of the named families; `listening` keeps only sockets that listen, or only those that don't."""
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families {sorted(unknown)}")
    kept = df.where(F.lower("proto").isin(*[p for f in families for p in FAMILIES[f]]))
    if listening is None:
        return kept
    listens = F.coalesce(F.col("state").isin("LISTEN", "LISTENING"), F.lit(False))
    return kept.where(listens if listening else ~listens)
