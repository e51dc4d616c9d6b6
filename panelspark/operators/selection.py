"""Top-k, sampling and set operators on the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order_stats import positions


def top_quantile(scores: DataFrame, q: float = 0.3, score: str = "p_up", min_pool: int = 3, min_buys: int = 3) -> DataFrame:
    """Per date the max(1, round(q n)) best symbols (half-even rounding); dates under ``min_pool`` names are skipped,
    symbols with fewer than ``min_buys`` selections dropped."""
    have = scores.filter(F.col(score).isNotNull()).withColumn("_neg", -F.col(score))
    n = have.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    d = positions(have, ["date"], ["_neg", "symbol"], "_k").join(n, "date").drop("_neg")
    sel = d.filter((F.col("_n") >= min_pool) & (F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * q))))
    n = sel.groupBy("symbol").agg(F.count(F.lit(1)).alias("_b")).filter(F.col("_b") >= min_buys)
    return sel.join(n.select("symbol"), "symbol", "left_semi").withColumnRenamed("_k", "rank").drop("_n")


def latest(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(key, "_x.*")


def random_subset(panel: DataFrame, sizes: DataFrame, draws: int, seed: int = 7) -> DataFrame:
    """For every draw and date a hash-random subset as large as the real selection of that date (``sizes``: date, k)."""
    d = panel.select("date", "symbol").join(sizes, "date").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("draw", "date").orderBy(F.xxhash64(F.lit(seed), "draw", "date", "symbol"), "symbol")
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("k")).select("draw", "date", "symbol")


def random_pools(symbols: DataFrame, draws: int, size: int, seed: int = 7) -> DataFrame:
    """``draws`` hash-random sub-pools of ``size`` symbols (input: one row per symbol)."""
    d = symbols.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "symbol"), "symbol")
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).select("draw", "symbol")


def selection_turnover(selected: DataFrame) -> DataFrame:
    """|previous symmetric-difference current| / max(1, |union|) between consecutive dates, by counting matches."""
    days = selected.select("date").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    s = selected.select("date", "symbol").join(days, "date")
    n = s.groupBy("_i").agg(F.count(F.lit(1)).alias("n"))
    nxt = s.select((F.col("_i") + 1).alias("_i"), "symbol")
    both = s.select("_i", "symbol").join(nxt, ["_i", "symbol"]).groupBy("_i").agg(F.count(F.lit(1)).alias("both"))
    j = days.join(n, "_i").join(n.select((F.col("_i") + 1).alias("_i"), F.col("n").alias("prev")), "_i").join(both, "_i", "left")
    b = F.coalesce(F.col("both"), F.lit(0))
    union = F.col("n") + F.col("prev") - b
    return j.select("date", (union - b).alias("changed"), ((union - b) / F.greatest(union, F.lit(1))).alias("turnover"))


def merge_news(sources: Sequence[DataFrame], limit: int | None = None, title: str = "title", ts: str = "ts") -> DataFrame:
    """Union of sources, newest copy of each title, all of them or the newest ``limit``."""
    u = sources[0]
    for s in sources[1:]:
        u = u.unionByName(s, allowMissingColumns=True)
    rest = [c for c in u.columns if c != title]
    g = u.groupBy(title).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("_x")).select(title, "_x.*")
    return g if limit is None else g.orderBy(F.desc(ts), title).limit(limit)


def best_candidate(candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Significant first, then the largest |IC|."""
    k = F.struct(F.col("significant").cast("int").alias("s"), F.abs("ic").alias("a"), F.col("candidate"))
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), k).alias("_x")).select(*keys, "_x.*")
