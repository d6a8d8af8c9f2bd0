"""Names of DNS codes (fixed values)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

OPCODES = {0: "QUERY", 2: "STATUS", 4: "NOTIFY", 5: "UPDATE"}
RCODES = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET",
    8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 16: "BADVERS", 17: "BADKEY", 18: "BADTIME", 19: "BADMODE", 21: "BADALG",
    22: "BADTRUNC", 23: "BADCOOKIE",
}
CLASSES = {1: "IN", 3: "CH", 4: "HS", 254: "NONE", 255: "ANY"}
TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 24: "SIG", 25: "KEY", 28: "AAAA", 33: "SRV",
    41: "OPT", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3",
    51: "NSEC3PARAM", 52: "TLSA", 99: "SPF", 249: "TKEY", 250: "TSIG", 252: "AXFR", 256: "URI", 32769: "DLV",
}
TYPE_A, TYPE_NS, TYPE_CNAME, TYPE_AAAA, TYPE_DNAME, TYPE_OPT, TYPE_RRSIG = 1, 2, 5, 28, 39, 41, 46


def _named(code: Column, names: Mapping[int, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(other))


def opcode_name(code: Column) -> Column:
    return _named(code, OPCODES, "Unassigned")


def rcode_name(code: Column, tsig: bool = False) -> Column:
    return _named(code, {**RCODES, 16: "BADSIG"} if tsig else RCODES, "Res/Not-Assigned")


def class_name(code: Column) -> Column:
    return _named(code, CLASSES, "Non-Standard")


def type_name(code: Column) -> Column:
    return _named(code, TYPES, "OTHER")
