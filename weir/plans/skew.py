"""Running and moving windows over keys of any size.

A window partitioned by a key puts all rows of that key in one task. `Chunked` keeps the plain plan while
every key is small, and when some key holds more than `chunk_rows` rows it cuts that key into consecutive
chunks of its ordering column. Windows then run per (key, chunk), and what earlier chunks contribute comes
from a small table with one row per chunk. Results are the same as those of the uncut window.

The ordering column must be a whole number, unique within a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.session import ensure_checkpoint_dir

CHUNK_ROWS = 1 << 20
# A chunk found to hold this many times the target size is cut once more.
OVERFULL = 4
# Bits of a chunk number kept for the finer cuts.
_SHIFTS = (42, 21, 0)

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def small_side(df: DataFrame, max_rows: int = 1 << 20) -> DataFrame:
    """A derived table saved once and, if its counted rows are few, hinted for broadcast.

    A larger one stays an ordinary join for AQE to plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    saved = df.checkpoint()
    return F.broadcast(saved) if saved.count() <= max_rows else saved


def _joined(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with null-safe keys; `other` keeps no column of its own but the new ones."""
    renamed = other.select(*[F.col(k).alias(f"_j_{k}") for k in keys],
                           *[c for c in other.columns if c not in keys])
    cond = None
    for k in keys:
        one = df[k].eqNullSafe(renamed[f"_j_{k}"])
        cond = one if cond is None else cond & one
    return df.join(renamed, cond, "left").drop(*[f"_j_{k}" for k in keys])


class Chunked:
    """A table, its key and its ordering column, cut into chunks where a key is hot."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: str, chunk_rows: int | None = CHUNK_ROWS,
                 tie: Sequence[str] = (), probe: DataFrame | None = None):
        """`probe` may stand in for `df` when rows are counted, if `df` only adds a bounded number of rows per key."""
        self.by = list(by)
        self.order = order
        self.tie = list(tie)
        self.split = False
        self.df = df
        if chunk_rows is not None:
            self._cut(chunk_rows, df if probe is None else probe)

    def _cut(self, target: int, probe: DataFrame) -> None:
        """Cut each key of over `target` rows into equal steps of its range, and chunks that stay overfull because
        their rows crowd together once or twice more within the range they use."""
        df, order = self.df, self.order
        for level, shift in enumerate(_SHIFTS):
            keys = [*self.by, "_chunk"] if level else self.by
            groups = (
                (df if level else probe).groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
                .where(F.col("_n") > (OVERFULL * target if level else target))
            )
            if not has_rows(groups):
                break
            self.split = True
            width = F.greatest(F.lit(1), F.expr(f"cast((_hi - _lo + 1) * {float(target)}D / _n as bigint)"))
            # at most rows/target groups can be this large
            df = _joined(df, small_side(groups.select(*keys, "_lo", width.alias("_width"))), keys)
            step = F.shiftleft(F.coalesce(F.expr(f"({order} - _lo) div _width"), F.lit(0)), shift)
            df = df.withColumn("_chunk", F.col("_chunk") + step if level else step).drop("_lo", "_width")
        if self.split:
            self.df = self._saved(df)

    @staticmethod
    def _saved(df: DataFrame) -> DataFrame:
        """A split table is read once per step, so each step starts from a durable copy."""
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()

    # ---- windows -------------------------------------------------------------------------------

    def part(self, *extra: str) -> list[str]:
        return [*self.by, *(["_chunk"] if self.split else []), *extra]

    def window(self, *extra: str):
        return Window.partitionBy(*self.part(*extra)).orderBy(self.order, *self.tie)

    def _carry(self, totals: DataFrame, extra: Sequence[str], folds: Mapping[str, str]) -> DataFrame:
        """Exclusive fold of per-chunk totals over the earlier chunks of the key."""
        keys = [*self.by, *extra]
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, "_chunk",
                             *[_FOLD[fn](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, fn in folds.items()]
                             ).where(F.col("_chunk") > 0)

    def scan(self, specs: Mapping[str, tuple[str, Column, bool]], extra: Sequence[str] = ()) -> "Chunked":
        """Add running aggregates: name -> (sum|max|min, value, include the current row).

        A running sum with nothing before it is 0; a running max or min is null.
        """
        df = self.df
        staged = {n: f"_v_{n}" for n in specs}
        df = df.withColumns({staged[n]: v for n, (_, v, _) in specs.items()})
        w = self.window(*extra)
        carried = {}
        if self.split:
            totals = df.groupBy(*self.by, *extra, "_chunk").agg(
                *[_FOLD[fn](staged[n]).alias(f"_t_{n}") for n, (fn, _, _) in specs.items()])
            carry = self._carry(totals, extra, {n: fn for n, (fn, _, _) in specs.items()})
            df = _joined(df, carry, [*self.by, *extra, "_chunk"])
            carried = {n: F.col(f"_c_{n}") for n in specs}
        out = {}
        for n, (fn, _, inclusive) in specs.items():
            here = _FOLD[fn](staged[n]).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
            if fn == "sum":
                here = F.coalesce(here, F.lit(0))
                out[n] = here + F.coalesce(carried[n], F.lit(0)) if n in carried else here
            elif n in carried:
                out[n] = (F.greatest if fn == "max" else F.least)(here, carried[n])
            else:
                out[n] = here
        self.df = df.withColumns(out).drop(*staged.values(), *[f"_c_{n}" for n in carried])
        return self

    def previous(self, name: str, value: Column) -> "Chunked":
        """Add the value of the row just before, across chunk borders."""
        df = self.df.withColumn("_pv", value)
        lagged = F.lag("_pv").over(self.window())
        if not self.split:
            self.df = df.withColumn(name, lagged).drop("_pv")
            return self
        lasts = df.groupBy(*self.by, "_chunk").agg(F.max_by("_pv", self.order).alias("_t"))
        w = Window.partitionBy(*self.by).orderBy("_chunk")
        carry = lasts.select(*self.by, "_chunk", F.lag("_t").over(w).alias("_c"))
        df = _joined(df, carry.where(F.col("_chunk") > 0), [*self.by, "_chunk"])
        first = F.row_number().over(self.window()) == 1
        self.df = df.withColumn("_first", first).withColumn(
            name, F.when(F.col("_first"), F.col("_c")).otherwise(lagged)).drop("_pv", "_c", "_first")
        return self

    def with_halo(self, rows: int, classes: Sequence[str] = ()) -> "Chunked":
        """Copy into each chunk the last `rows` rows of each class that precede it, marked `_halo`.

        Frames of up to `rows` rows then see across the chunk border. At most rows x classes copies are
        made per chunk. Drop them with `without_halo`.
        """
        if not self.split:
            return self
        by, order = self.by, self.order
        df = self.df = self._saved(self.df)
        fields = [c for c in df.columns if c not in (*by, "_chunk")]
        last = Window.partitionBy(*by, "_chunk", *classes).orderBy(F.col(order).desc(),
                                                                   *[F.col(t).desc() for t in self.tie])
        key = F.struct(F.col(order), *[F.col(c) for c in fields if c != order])
        tails = (
            df.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= rows)
            .groupBy(*by, "_chunk", *classes).agg(F.sort_array(F.collect_list(key)).alias("_tail"))
        )
        # every chunk of this table holds at least one row of the class, so `rows` chunks back suffice
        near = Window.partitionBy(*by, *classes).orderBy("_chunk").rowsBetween(-rows, 0)
        tails = tails.withColumn("_tail", F.flatten(F.collect_list("_tail").over(near)))
        tails = tails.withColumn("_tail", F.expr(f"slice(_tail, greatest(1, size(_tail) - {rows - 1}), {rows})"))
        # carry the latest tail of each class to every later chunk of the key
        grid = df.select(*by, "_chunk").distinct()
        slots = _joined(grid, tails.select(*by, *classes).distinct(), by) if classes else grid
        slots = _joined(slots, tails, [*by, *classes, "_chunk"])
        earlier = Window.partitionBy(*by, *classes).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        halo = (
            slots.select(*by, "_chunk", F.last("_tail", ignorenulls=True).over(earlier).alias("_tail"))
            .where(F.col("_tail").isNotNull())
            .select(*by, "_chunk", F.explode("_tail").alias("_x"))
            .select(*by, "_chunk", *[F.col(f"_x.{c}").alias(c) for c in fields], F.lit(True).alias("_halo"))
        )
        self.df = df.withColumn("_halo", F.lit(False)).unionByName(halo)
        return self

    def without_halo(self) -> "Chunked":
        if self.split:
            self.df = self.df.where(~F.col("_halo")).drop("_halo")
        return self

    def done(self, columns: Iterable[str] | None = None) -> DataFrame:
        df = self.df.drop("_chunk")
        return df.select(*columns) if columns is not None else df
