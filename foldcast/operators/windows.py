"""Window primitives over series, computed in halo blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldcast.functions import columns as C
from foldcast.operators.series import (
    SUB_BLOCK, SeriesSpec, UNBOUNDED, drop_halo, halo_window, number_rows, sub_window, with_halo,
)

# Rows of history an exponential mean needs: (25/27)**512 is below 1e-17, so what lies further back cannot
# change a double for any span up to 26. Longer spans, and values with gaps, get a longer halo from ``ewm_halo``.
EWM_HALO = 2 * SUB_BLOCK


def ewm_halo(span: int, gaps: bool = False) -> int:
    """Whole sub-blocks of history after which an exponential mean of ``span`` has forgotten its start.

    After g missing values the old mean keeps b**(g+1) / (b**(g+1) + a) of its weight, more per row than without gaps; the
    slowest such rate counts.
    """
    a = 2.0 / (span + 1)
    b = 1.0 - a
    rate = max((b**k / (b**k + a)) ** (1 / k) for k in range(1, 4 * span + 2)) if gaps else b
    rows, weight = 0, 1.0
    while weight > 1e-17:
        rows, weight = rows + SUB_BLOCK, weight * rate**SUB_BLOCK
    return max(rows, EWM_HALO)


def shift(df: DataFrame, spec: SeriesSpec, outputs: dict[str, tuple[str, int]]) -> DataFrame:
    """Values k rows back (k > 0) or ahead (k < 0): ``{out: (column, k)}``."""
    back = max([k for _, k in outputs.values()] + [0])
    ahead = max([-k for _, k in outputs.values()] + [0])
    blocked = with_halo(df, spec, before=back, after=ahead)
    w = halo_window(spec)
    return drop_halo(blocked.select("*", *[F.lag(c, k).over(w).alias(o) for o, (c, k) in outputs.items()]))


def difference(df: DataFrame, spec: SeriesSpec, column: str, out: str) -> DataFrame:
    return shift(df, spec, {"_before": (column, 1)}).withColumn(out, F.col(column) - F.col("_before")).drop("_before")


def percent_change(df: DataFrame, spec: SeriesSpec, column: str, outputs: dict[str, int]) -> DataFrame:
    """k-row returns: ``{out: k}``."""
    moved = shift(df, spec, {f"_back_{k}": (column, k) for k in outputs.values()})
    for out, k in outputs.items():
        moved = moved.withColumn(out, C.pct_change(F.col(column), F.col(f"_back_{k}")))
    return moved.drop(*[f"_back_{k}" for k in outputs.values()])


_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}


def rolling(df: DataFrame, spec: SeriesSpec, outputs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Full-window aggregates: ``{out: (kind, column, k)}`` with kind mean, std, sum, min or max."""
    blocked = with_halo(df, spec, before=max(k for _, _, k in outputs.values()) - 1)
    w = halo_window(spec)
    cols = [C.rolling(_ROLLING[kind], F.col(c), w, k).alias(o) for o, (kind, c, k) in outputs.items()]
    return drop_halo(blocked.select("*", *cols))


def rolling_corr(df: DataFrame, spec: SeriesSpec, x: str, y: str, k: int, out: str) -> DataFrame:
    """Full-window correlation, 0 where it is undefined."""
    blocked = with_halo(df, spec, before=k - 1)
    value = C.rolling_corr(F.col(x), F.col(y), halo_window(spec), k)
    return drop_halo(blocked.withColumn(out, C.or_default(value, 0.0)))


def ewm_in_blocks(blocked: DataFrame, spec: SeriesSpec, outputs: dict[str, tuple[str, int]], gaps: bool = False) -> DataFrame:
    """Exponential means on a halo layout: ``{out: (column, span)}``; y0 = x0, y = (1-a) y' + a x, a = 2/(span+1).

    Inside a sub-block of 256 rows the recurrence is a running sum of x over the product of what each row keeps of the mean
    before, scaled back by that product. The value at the end of the sub-block before, rebuilt from as many sub-blocks as the
    longest span remembers and one more, is then decayed into the rows that follow. Every window shares one partitioning and
    sort. The layout's halo must reach as far.

    With ``gaps`` missing values hold the mean, which starts at the first value; the value after g missing ones meets the old
    mean at weights a and b**(g+1), b = 1 - a, as one g + 1 rows away. Without ``gaps`` no value may be missing.
    """
    depth = 1 + max([ewm_halo(span, gaps) for _, span in outputs.values()], default=EWM_HALO) // SUB_BLOCK
    inside, along = sub_window(spec), halo_window(spec)
    upto = inside.rowsBetween(UNBOUNDED, 0)
    stages: list[list[Column]] = [[], [], [], [], []]
    for out, (column, span) in outputs.items():
        a = 2.0 / (span + 1)
        b = 1.0 - a
        x = F.col(column)
        if gaps:
            seen = F.last(F.when(x.isNotNull(), F.col("rn")), ignorenulls=True).over(along.rowsBetween(UNBOUNDED, -1))
            stages[0].append(seen.alias(f"_seen_{out}"))
            away, far = F.col("rn") - F.col(f"_seen_{out}"), F.pow(F.lit(b), F.col("rn") - F.col(f"_seen_{out}"))
            keeps = F.when(away == 1, F.lit(b)).when(away > 1, far / (far + a)).otherwise(F.lit(1.0))
            stages[1].append(F.when(x.isNotNull(), keeps).otherwise(F.lit(1.0)).alias(f"_keep_{out}"))
            kept = F.exp(F.sum(F.log(f"_keep_{out}")).over(upto))
            weight = F.when(F.col(f"_seen_{out}").isNull(), F.lit(1.0)).otherwise(1.0 - F.col(f"_keep_{out}"))
        else:
            kept = F.pow(F.lit(b), F.col("rn") % SUB_BLOCK + 1)
            weight = F.when(F.col("rn") == 0, F.lit(1.0)).otherwise(F.lit(a))
        stages[2].append(kept.alias(f"_all_{out}"))
        total = F.sum(weight * x / F.col(f"_all_{out}")).over(upto) * F.col(f"_all_{out}")
        stages[3].append(total.alias(f"_part_{out}"))
        carry = F.lit(0.0)
        for i in reversed(range(depth)):
            back = 1 + i * SUB_BLOCK
            carry = C.or_default(F.lag(f"_part_{out}", back).over(along), 0.0) + C.or_default(F.lag(f"_all_{out}", back).over(along), 0.0) * carry
        stages[4].append(carry.alias(f"_edge_{out}"))
    staged = blocked
    for columns in stages:
        staged = staged.select("*", *columns) if columns else staged
    final = []
    for out, (column, _) in outputs.items():
        value = C.or_default(F.col(f"_part_{out}"), 0.0) + F.first(f"_edge_{out}").over(upto) * F.col(f"_all_{out}")
        if gaps:
            value = F.when(F.col(column).isNotNull() | F.col(f"_seen_{out}").isNotNull(), value)
        final.append(value.alias(out))
    return staged.select("*", *final).drop(*[f"_{stage}_{o}" for stage in ("seen", "keep", "all", "part", "edge") for o in outputs])


def has_gaps(df: DataFrame, columns: list[str]) -> bool:
    """Whether a value is missing: one aggregate."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return bool(df.agg(F.max(missing)).first()[0])


def ewm(df: DataFrame, spec: SeriesSpec, outputs: dict[str, tuple[str, int]], gaps: bool | None = None) -> DataFrame:
    """Exponential means of a numbered series, of any span from 2 up; the halo grows with the longest.

    Missing values hold the mean. Whether there are any is looked up unless ``gaps`` says it.
    """
    gaps = has_gaps(df, [c for c, _ in outputs.values()]) if gaps is None else gaps
    halo = max([ewm_halo(span, gaps) for _, span in outputs.values()], default=EWM_HALO)
    return drop_halo(ewm_in_blocks(with_halo(df, spec, before=halo), spec, outputs, gaps))


def running_sum(df: DataFrame, spec: SeriesSpec, column: str, out: str) -> DataFrame:
    """Running total over a whole numbered series: sums inside row blocks plus the totals of the blocks before."""
    keys = list(spec.keys)
    rows = df.withColumn("_rows", F.expr(f"rn div {spec.row_block}"))
    blocks = rows.groupBy(*keys, "_rows").agg(F.sum(column).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_rows").rowsBetween(UNBOUNDED, -1)
    blocks = blocks.select(*keys, "_rows", C.or_default(F.sum("_total").over(earlier), 0.0).alias("_base"))
    inside = Window.partitionBy(*keys, "_rows").orderBy("rn").rowsBetween(UNBOUNDED, 0)
    rows = rows.withColumn("_run", F.sum(column).over(inside)).join(blocks, [*keys, "_rows"])
    return rows.withColumn(out, F.col("_run") + F.col("_base")).drop("_run", "_base", "_rows")


def fill_gaps(df: DataFrame, spec: SeriesSpec, columns: tuple[str, ...], back_fill: bool = True) -> DataFrame:
    """Forward fill, then (optionally) back fill of the head of each series."""
    return number_rows(df, spec, fills=columns, back_fill=back_fill)
