"""Tables in the cluster's shared folder, joins that check a size first, and row schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from foldcast.session import scratch_path

# Rows of at most this many 8-byte keys are broadcast; beyond it the same join shuffles.
BROADCAST_KEYS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of the rows (``rows``: their number) taken while they are written, so that no job reads them again."""
    seen = Observation()
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in figures.items())), name)
    return table, seen.get


def keyed(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", limit: int = BROADCAST_KEYS, rows: int | None = None) -> DataFrame:
    """Join ``df`` with a stored table of narrow rows: broadcast when its rows (counted, unless given) are within ``limit``, else shuffled."""
    small = (keys.count() if rows is None else rows) <= limit
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


def hashed_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; NULL keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, lengthened until no column (in any case) has that name."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted
