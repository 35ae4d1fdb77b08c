"""Joining small per-series tables to long ones when one series may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldcast.session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def _width(field: T.StructField) -> Column:
    """Bytes that a value takes, roughly: what it holds where that varies, else eight."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        size = F.octet_length(F.to_json(value)) if isinstance(kind.elementType, T.StructType) else 8 * F.size(F.flatten(value) if isinstance(kind.elementType, T.ArrayType) else value) + 16
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def table_bytes(df: DataFrame) -> int:
    """Measured size of a small table, from one aggregate over its rows."""
    per_row = sum((_width(f) for f in df.schema.fields), F.lit(0))
    return df.agg(F.sum(per_row.cast("long"))).first()[0] or 0


def attach(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES, stored: bool = False) -> DataFrame:
    """Join a table of one row per series (or fold, or group) to the rows of those series, keeping the long side.

    The small side is written once (unless it is ``stored`` already) and measured. Up to ``limit`` bytes it is
    broadcast, so the long side is not shuffled. Beyond that the long side is
    salted and the small side copied to every salt, so a hot key spreads over
    many tasks. Both ways give the same rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep the long side alone")
    small = small if stored else materialise(small)
    if table_bytes(small) <= limit:
        return rows.join(F.broadcast(small), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
