"""Row blocks with overlap: trailing windows and fading recursions over series of any length.

A key is cut into blocks of ``block`` rows by its exact row position; the last ``halo`` rows of a block are also given
to the next block as warm-up.  A trailing window of at most ``halo + 1`` rows is then exact inside a block, and an
exponential average with weight ``a`` is exact to double precision once ``(1 - a) ** halo < 2 ** -60``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.order_stats import positions


def halo_for(alpha: float) -> int:
    """Warm-up rows after which the first value no longer shows in an exponential average."""
    return math.ceil(-60 * math.log(2) / math.log1p(-alpha))


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int, block: int = 65536) -> DataFrame:
    """Adds ``pos``, ``_blk`` and ``_warm``; window by ``(*keys, _blk)`` and drop ``_warm`` rows afterwards."""
    if halo > block:
        block = halo
    p = positions(df, keys, order)
    own = F.floor((F.col("pos") - 1) / block)
    spill = (F.col("pos") - 1) % block >= block - halo
    both = F.array_compact(F.array(
        F.struct(own.alias("b"), F.lit(False).alias("w")),
        F.when(spill, F.struct((own + 1).alias("b"), F.lit(True).alias("w"))),
    ))
    return p.withColumn("_x", F.explode(both)).select("*", F.col("_x.b").alias("_blk"), F.col("_x.w").alias("_warm")).drop("_x")
