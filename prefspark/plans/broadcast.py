"""Broadcast only behind a size check, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

from prefspark.session import scratch_path

# A side is broadcast only when it has at most this many rows AND this many (estimated) bytes.
DEFAULT_MAX_BROADCAST_ROWS = 100_000
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame):
    """Estimated bytes of one row: text/binary lengths, 8 bytes per element or scalar otherwise."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (ArrayType, MapType)):
            parts.append(F.coalesce(F.size(c), F.lit(0)) * F.lit(8))
        else:
            parts.append(F.lit(8))
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total.cast("long")


def small_side(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, reuse: bool = False,
               max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows and ``max_bytes``
    estimated bytes, else ``df`` unchanged.

    The check is one aggregation to two numbers over the rows' estimated lengths: no row and no
    text leaves its task. Beyond the bounds Catalyst/AQE pick the join (sort-merge, or broadcast
    from runtime stats). With ``reuse`` (for sides that are expensive to compute, e.g. aggregates
    over model outputs) the side is first written to the shared checkpoint folder, so that it is
    computed once and nothing stays pinned in executor memory.
    """
    if reuse:
        path = scratch_path(df.sparkSession, "side")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    n, nbytes = df.select(_row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if n <= max_rows and (nbytes or 0) <= max_bytes else df
