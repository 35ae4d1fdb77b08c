"""Order-dependent work on series without putting a whole series into one task.

A series (one symbol) may hold a large share of all rows, so no window in this
package is partitioned by the series alone. Two layouts replace it:

* ``number_rows`` cuts a series into blocks of *time*. A block has at most
  ``time_block`` rows because a series has one row per time unit. Windows run
  inside blocks; what must flow from block to block (row positions, last known
  values, running totals) is carried by a table with one row per block.
* ``with_halo`` cuts a numbered series into blocks of *rows* and copies the
  few rows before (and after) each block into it, so that every bounded frame
  of a core row lies inside its own block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

SUB_BLOCK = 256
UNBOUNDED = Window.unboundedPreceding


@dataclass(frozen=True)
class SeriesSpec:
    """How rows form series.

    ``keys`` name the series, ``time`` orders it (one row per ``unit``).
    ``row_block`` must be a multiple of 256.
    """

    keys: tuple[str, ...] = ("symbol",)
    time: str = "date"
    unit: str = "day"
    time_block: int = 1024
    row_block: int = 4096

    def __post_init__(self):
        if self.row_block % SUB_BLOCK or self.row_block <= 0:
            raise ValueError(f"row_block must be a positive multiple of {SUB_BLOCK}")
        if self.unit not in ("day", "hour"):
            raise ValueError("unit must be 'day' or 'hour'")

    def with_(self, **changes) -> "SeriesSpec":
        return replace(self, **changes)

    def time_index(self) -> Column:
        """Whole units since the epoch."""
        if self.unit == "day":
            return F.unix_date(F.to_date(F.col(self.time))).cast("long")
        return F.expr(f"unix_seconds(cast({self.time} as timestamp)) div 3600")


def require_keys(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """An error, when it is run, for a row whose series or time is missing: such a row has no place in an order."""
    checked = {}
    for c in (*spec.keys, spec.time):
        checked[c] = F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a row has no {c}"))).otherwise(F.col(c))
    return df.withColumns(checked)


def _series_frame(spec: SeriesSpec, block: str) -> WindowSpec:
    return Window.partitionBy(*spec.keys, block).orderBy(spec.time)


def number_rows(
    df: DataFrame,
    spec: SeriesSpec,
    fills: tuple[str, ...] = (),
    back_fill: bool = True,
    flow: tuple[str, str, str] | None = None,
    block: str | None = None,
) -> DataFrame:
    """Add ``rn`` (position from 0) and ``n`` (rows of the series); optionally carry values along the series.

    ``fills`` are columns whose gaps take the last earlier value and, with
    ``back_fill``, the first value of the series where there is no earlier one.
    ``flow=(price, size, out)`` adds the running total of ``size`` signed by the
    change of ``price``. ``block`` names an existing ordered block column to
    work in, in place of blocks of time. Rows without a key or a time are an error.
    """
    keys = list(spec.keys)
    blk = block or "_block"
    df = require_keys(df, spec)
    if block is None:
        df = df.withColumn(blk, F.floor(spec.time_index() / spec.time_block))
    w = _series_frame(spec, blk)
    upto = w.rowsBetween(UNBOUNDED, 0)

    local = [(F.row_number().over(w) - 1).cast("long").alias("_pos")]
    local += [F.last(c, ignorenulls=True).over(upto).alias(f"_fill_{c}") for c in fills]
    rows = df.drop("rn", "n").select("*", *local)
    if flow:
        price, size, _ = flow
        step = F.signum(F.col(price) - F.lag(price).over(w)) * F.col(size)
        rows = rows.withColumn("_step", F.coalesce(step, F.lit(0.0)))
        rows = rows.withColumn("_run", F.sum("_step").over(upto))

    parts = [F.count(F.lit(1)).alias("_rows")]
    for c in fills:
        known_at = F.when(F.col(c).isNotNull(), F.col(spec.time))
        parts += [F.min_by(c, known_at).alias(f"_head_{c}"), F.max_by(c, known_at).alias(f"_tail_{c}")]
    if flow:
        parts += [
            F.sum("_step").alias("_inner"),
            F.min_by(price, spec.time).alias("_open"),
            F.max_by(price, spec.time).alias("_close"),
            F.min_by(size, spec.time).alias("_size"),
        ]
    blocks = rows.groupBy(*keys, blk).agg(*parts)

    # One row per block from here on: the window by series sees (time span / time_block) rows.
    along = Window.partitionBy(*keys).orderBy(blk)
    earlier = along.rowsBetween(UNBOUNDED, -1)
    whole = Window.partitionBy(*keys)
    carried = [
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("n"),
    ]
    for c in fills:
        carry = F.last(f"_tail_{c}", ignorenulls=True).over(earlier)
        carried.append(carry.alias(f"_carry_{c}"))
        if back_fill:
            lead = F.first(f"_head_{c}", ignorenulls=True).over(along.rowsBetween(UNBOUNDED, Window.unboundedFollowing))
            carried.append(lead.alias(f"_lead_{c}"))
    if flow:
        edge = F.signum(F.col("_open") - F.lag("_close").over(along)) * F.col("_size")
        blocks = blocks.withColumn("_edge", F.coalesce(edge, F.lit(0.0)))
        before = F.coalesce(F.sum(F.col("_inner") + F.col("_edge")).over(earlier), F.lit(0.0))
        carried.append((before + F.col("_edge")).alias("_base"))
    offsets = blocks.select(*keys, blk, *carried)

    joined = rows.join(offsets, [*keys, blk])
    out = []
    for c in df.columns:
        if c in fills:
            known = [F.col(f"_fill_{c}"), F.col(f"_carry_{c}")] + ([F.col(f"_lead_{c}")] if back_fill else [])
            out.append(F.coalesce(*known).alias(c))
        elif c not in ("rn", "n", "_block"):
            out.append(F.col(c))
    if flow:
        out.append((F.col("_run") + F.col("_base")).alias(flow[2]))
    return joined.select(*out, (F.col("_pos") + F.col("_offset")).alias("rn"), "n")


def with_halo(df: DataFrame, spec: SeriesSpec, before: int = 0, after: int = 0) -> DataFrame:
    """Add ``blk``, ``sub`` and ``core`` to a numbered series, copying rows into the blocks whose frames need them."""
    size = spec.row_block
    low = F.greatest(F.lit(0).cast("long"), F.expr(f"(rn - {after}) div {size}"))
    high = F.least(F.expr(f"(rn + {before}) div {size}"), F.expr(f"(n - 1) div {size}"))
    return (
        df.withColumn("blk", F.explode(F.sequence(low, high)))
        .withColumn("core", F.col("blk") == F.expr(f"rn div {size}"))
        .withColumn("sub", F.expr(f"rn div {SUB_BLOCK}"))
    )


def halo_window(spec: SeriesSpec) -> WindowSpec:
    """The order of a series inside its row block; ``sub`` first so that sub-block windows share the sort."""
    return Window.partitionBy(*spec.keys, "blk").orderBy("sub", "rn")


def sub_window(spec: SeriesSpec) -> WindowSpec:
    return Window.partitionBy(*spec.keys, "blk", "sub").orderBy("rn")


def drop_halo(df: DataFrame, keep_block: bool = False) -> DataFrame:
    df = df.where("core").drop("core", "sub")
    return df if keep_block else df.drop("blk")


def running_totals(df: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[str, Column]], block: int = 1024) -> DataFrame:
    """Running ``sum``/``min``/``max`` along an integer column, in blocks, for tables of a few rows per series.

    ``columns`` maps an output name to (kind, input expression). The totals
    include the current row.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    staged = df.select("*", *[expr.alias(f"_in_{name}") for name, (_, expr) in columns.items()])
    staged = staged.withColumn("_rb", F.expr(f"cast({order} as bigint) div {block}"))
    inside = Window.partitionBy(*keys, "_rb").orderBy(order).rowsBetween(UNBOUNDED, 0)
    rows = staged.select("*", *[kinds[k](f"_in_{n}").over(inside).alias(f"_run_{n}") for n, (k, _) in columns.items()])
    blocks = staged.groupBy(*keys, "_rb").agg(*[kinds[k](f"_in_{n}").alias(f"_all_{n}") for n, (k, _) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(UNBOUNDED, -1)
    blocks = blocks.select(*keys, "_rb", *[kinds[k](f"_all_{n}").over(earlier).alias(f"_base_{n}") for n, (k, _) in columns.items()])

    def combine(name: str, kind: str) -> Column:
        run, base = F.col(f"_run_{name}"), F.col(f"_base_{name}")
        if kind == "sum":
            return F.coalesce(run, F.lit(0)) + F.coalesce(base, F.lit(0))
        return F.least(run, base) if kind == "min" else F.greatest(run, base)

    joined = rows.join(blocks, [*keys, "_rb"])
    return joined.select(*df.columns, *[combine(n, k).alias(n) for n, (k, _) in columns.items()])
