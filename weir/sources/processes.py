"""Process snapshots and system summaries: text to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column order of a process listing, by the column it is sorted on (fixed values).
HEADERS = {
    "bsdstart": ("bsdstart", "pmem", "pcpu", "etimes", "command"),
    "pmem": ("pmem", "pcpu", "etimes", "bsdstart", "command"),
    "pcpu": ("pcpu", "pmem", "etimes", "bsdstart", "command"),
    "etimes": ("etimes", "pmem", "pcpu", "bsdstart", "command"),
}


def parse_process_snapshot(lines: DataFrame, header: Sequence[str] = HEADERS["bsdstart"], text: str = "value") -> DataFrame:
    """One column per header name; the last takes the rest of the line. Other input columns are kept."""
    keep = [c for c in lines.columns if c != text]
    rows = lines.where(F.trim(text) != "").withColumn("_f", F.split(F.trim(text), " +", len(header)))
    return rows.select(*keep, *[F.get("_f", F.lit(i)).alias(h) for i, h in enumerate(header)])


def parse_system_summary(snapshots: DataFrame, text: str = "value") -> DataFrame:
    """Memory share in use, processor share and number of tasks from the first lines of each summary text."""
    keep = [c for c in snapshots.columns if c != text]
    lines = F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")
    number = r"^\s*(\S+)"

    def value(line: int, part: int, after_colon: bool = True):
        body = F.get(lines, F.lit(line))
        body = F.get(F.split(body, ": "), F.lit(1)) if after_colon else body
        return F.regexp_extract(F.get(F.split(body, ","), F.lit(part)), number, 1)

    total, used = value(3, 0).try_cast("double"), value(3, 1).try_cast("double")
    return snapshots.select(*keep, F.try_divide(used, total).alias("pmem"), value(2, 0).alias("pcpu"),
                            value(1, 2, after_colon=False).alias("num_tasks"))
