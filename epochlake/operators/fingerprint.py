"""Fingerprints of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_fingerprint(df: DataFrame, order: Sequence[str] | None = None, block: int = 4096) -> DataFrame:
    """One row (n, fingerprint). Without an order, a sum of row hashes; with one, a SHA-256 over the rows' digests in that order.

    The ordered form digests blocks of rows first, so no task holds more than a block or the blocks' digests.
    """
    text = F.to_json(F.struct(*df.columns))
    if not order:
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(text).cast("decimal(20,0)")).cast("string").alias("fingerprint"))
    from .windows import order_index

    placed = order_index(df.select(*order, F.sha2(text, 256).alias("__h")), list(order), "__i")
    ordered = lambda i, h: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i, h))), lambda x: x[h]), "")
    blocks = placed.groupBy(F.floor(F.col("__i") / block).alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.sha2(ordered("__i", "__h"), 256).alias("__d"))
    return blocks.agg(F.sum("__n").alias("n"), F.sha2(ordered("__b", "__d"), 256).alias("fingerprint"))
