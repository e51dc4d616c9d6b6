"""Exact ranks, running sums, quantiles and rank correlations for groups of any size.

A pooled statistic (all rows of one horizon, the whole table) must not sort its group in one task.  Every operator
here cuts a group into value buckets first: one random distinct order key per hash class is sampled (a minimum-hash
sample, so it is the same on every re-run and bounded by ``classes`` per group), the sorted sample gives the bucket
edges, buckets are windowed on their own and linked by the running totals of the bucket table.  Results are exact for
any edges; the sample only decides how even the buckets are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import pearson

CLASSES = 256
#: Bytes that one bucket should hold at most; larger groups are cut at more levels, ``CLASSES`` ways each.
BUCKET_BYTES = 64 << 20
#: The optimizer's stand-in for a size it does not know is above this.
UNKNOWN = 1 << 60


def levels(df: DataFrame) -> int:
    """Levels of buckets for a group as large as the whole input: one for 16 GB, two for 4 TB, and so on without limit.

    Results are the same at any number of levels.  The size is the optimizer's estimate for the files a plan reads (no job is run); a file read
    twice counts twice, which only makes buckets finer.  Rows handed over by the driver have no estimate and count nothing.  A client that has no
    access to the plan takes two levels.
    """
    if not hasattr(df, "_jdf"):
        return 2
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    n = 1
    while size > BUCKET_BYTES * CLASSES**n:
        n += 1
    return n


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null keys match one another; the key columns are those of ``left``."""
    r = right.select(*[F.col(c).alias(f"__same_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__same_{c}")) for c in on])
    return left.join(r, cond, how).drop(*[f"__same_{c}" for c in on])


def _order_value(order: Sequence[str]) -> Column:
    """One column as itself (keeps the sample in the hash aggregate), several as a struct."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], classes: int) -> DataFrame:
    sample = (
        df.groupBy(*keys, F.pmod(F.xxhash64(*order), F.lit(classes)).alias("_class"))
        .agg(F.min_by(_order_value(order), F.xxhash64(F.lit(17), *order)).alias("_e"))
    )
    return sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_edges"))


def _locate(edges: Column, value: Column, classes: int) -> Column:
    """Number of edges <= value, by bit descent over the sorted array."""
    steps, s = [], 1 << (classes.bit_length() - 1)
    while s:
        steps.append(s)
        s >>= 1
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]), F.lit(0),
        lambda acc, step: F.when(
            (acc + step <= F.size(edges)) & (F.try_element_at(edges, acc + step) <= value), acc + step
        ).otherwise(acc),
    )


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], classes: int = CLASSES, depth: int | None = None) -> DataFrame:
    """Adds ``_b``, a bucket (array of numbers, outermost first) that never decreases along ``order`` within ``keys``.

    Every level samples edges anew inside the buckets of the level above, so a bucket of a very large group is cut again.  Rows whose order value is
    null come first, as in a window.
    """
    ks = list(keys) or ["_all"]
    out = df if keys else df.withColumn("_all", F.lit(1))
    cut: list[str] = []
    for i in range(levels(df) if depth is None else depth):
        e = _edges(out, [*ks, *cut], order, classes)
        if ks == ["_all"] and not cut:
            e = F.broadcast(e)  # exactly one row of at most ``classes`` keys
        out = join_same(out, e, [*ks, *cut]).withColumn(f"_b{i}", _locate(F.col("_edges"), _order_value(order), classes)).drop("_edges")
        cut.append(f"_b{i}")
    return out.withColumn("_b", F.array(*cut)).drop(*cut)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str] | None = None,
            maxes: dict[str, str] | None = None, classes: int = CLASSES, small: bool = False) -> DataFrame:
    """Adds inclusive running sums and maxima ``{new: column}`` along ``order`` (unique within ``keys``)."""
    aggs = [(n, c, F.sum, lambda x, o: x + F.coalesce(o, F.lit(0))) for n, c in (sums or {}).items()]
    aggs += [(n, c, F.max, lambda x, o: F.greatest(x, o)) for n, c in (maxes or {}).items()]
    if small:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fn(c).over(w).alias(n) for n, c, fn, _ in aggs])
    ks = list(keys) or ["_all"]
    b = bucketed(df, keys, order, classes)
    prev = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*ks, "_b").agg(*[fn(c).alias(f"_t_{n}") for n, c, fn, _ in aggs])
    offsets = totals.select(*ks, "_b", *[fn(f"_t_{n}").over(prev).alias(f"_o_{n}") for n, _, fn, _ in aggs])
    inside = Window.partitionBy(*ks, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_same(b, offsets, [*ks, "_b"])
    out = out.withColumns({n: join(fn(c).over(inside), F.col(f"_o_{n}")) for n, c, fn, join in aggs})
    return out.drop("_b", *[f"_o_{n}" for n, *_ in aggs], *([] if keys else ["_all"]))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], classes: int = CLASSES,
                small: bool = False) -> DataFrame:
    return running(df, keys, order, sums, None, classes, small)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", classes: int = CLASSES,
              small: bool = False) -> DataFrame:
    """Row number from 1 along ``order`` without one task per key."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, keys, order, {name: "_one"}, classes, small).drop("_one")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, classes: int = CLASSES,
                small: bool = False) -> DataFrame:
    """(keys, value, n, cum, rank): one row per distinct value with its count and tie-averaged rank."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    d = df.groupBy(*keys, value).agg(n.cast("long").alias("n"))
    r = running_sum(d, keys, [value], {"cum": "n"}, classes, small)
    return r.withColumn("rank", F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "ic",
             bounded: bool = False) -> DataFrame:
    """Spearman correlation with average ranks per ``keys``; 0 for n < 2 or a constant side.

    ``bounded=True`` ranks with plain windows, for groups that are one series or one cross-section by contract.
    """
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    if bounded:
        ks = list(keys)
        r = clean.select(*ks, average_rank(x, ks).alias("_rx"), F.col(y).alias("_y"))
        r = r.select(*ks, "_rx", average_rank("_y", ks).alias("_ry"))
        return r.groupBy(*ks).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(pearson("_rx", "_ry"), F.lit(0.0)).alias(out)
        )
    ks = list(keys) or ["_k"]
    if not keys:
        clean = clean.withColumn("_k", F.lit(1))
    joint = clean.groupBy(*ks, x, y).agg(F.count(F.lit(1)).alias("_m"))
    rx = value_ranks(joint, ks, x, "_m").select(*ks, x, F.col("rank").alias("_rx"))
    ry = value_ranks(joint, ks, y, "_m").select(*ks, y, F.col("rank").alias("_ry"))
    total = joint.groupBy(*ks).agg(F.sum("_m").alias("n"))
    j = join_same(join_same(join_same(joint, rx, [*ks, x]), ry, [*ks, y]), total, ks)
    cx, cy = (F.col("_rx") - (F.col("n") + 1) / 2) / F.col("n"), (F.col("_ry") - (F.col("n") + 1) / 2) / F.col("n")
    s = j.groupBy(*ks).agg(
        F.sum("_m").alias("n"), F.sum(F.col("_m") * cx * cy).alias("_xy"),
        F.sum(F.col("_m") * cx * cx).alias("_xx"), F.sum(F.col("_m") * cy * cy).alias("_yy"),
    )
    ic = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).otherwise(0.0)
    return s.select(*[k for k in ks if k != "_k"], "n", ic.alias(out))


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Tie-averaged rank inside a bounded group; the tie count reuses the same sort (range frame of width 0)."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2.0


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, small: bool = False) -> DataFrame:
    """Adds the tie-averaged rank among the non-null values of the group; null where the value is null."""
    if small:
        nulls = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.count(value).over(Window.partitionBy(*keys))  # nulls sort first
        return df.withColumn(name, F.when(F.col(value).isNotNull(), average_rank(value, keys) - nulls))
    r = value_ranks(df.filter(F.col(value).isNotNull()), keys, value).select(*keys, value, F.col("rank").alias(name))
    return join_same(df, r, [*keys, value], "left").select(*df.columns, name)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], classes: int = CLASSES,
              small: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles: (keys, prob, q).  Only the buckets holding a wanted rank are sorted."""
    if small:
        p = F.array(*[F.lit(float(x)) for x in probs])
        g = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, p).alias("_q"), F.count(F.lit(1)).alias("_c"))
        g = g.filter(F.col("_c") > 0).select(*keys, F.explode(F.arrays_zip(p.alias("prob"), F.col("_q").alias("q"))).alias("_z"))
        return g.select(*keys, F.col("_z.prob").alias("prob"), F.col("_z.q").alias("q"))
    ks = list(keys) or ["_all"]
    d = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value))
    counts = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    b = bucketed(counts, keys, ["_v"], classes)
    t = b.groupBy(*ks, "_b").agg(F.sum("_n").alias("_t"))
    upto = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_hi", F.sum("_t").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_t"))
    t = t.withColumn("_total", F.sum("_t").over(Window.partitionBy(*ks)))
    want = t.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    h = F.col("prob") * (F.col("_total") - 1)
    want = want.withColumn("_h", h).withColumn("_r", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h))))).filter(
        (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi"))
    )
    hit = want.groupBy(*ks, "_b", "_lo").agg(F.collect_list(F.struct("prob", "_h", "_r")).alias("_want"))
    inside = Window.partitionBy(*ks, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    r = join_same(b, hit, [*ks, "_b"]).withColumn("_end", F.col("_lo") + F.sum("_n").over(inside))
    r = r.withColumn("_w", F.explode("_want")).filter(
        (F.col("_w._r") < F.col("_end")) & (F.col("_w._r") >= F.col("_end") - F.col("_n"))
    )
    g = r.groupBy(*ks, F.col("_w.prob").alias("prob"), F.col("_w._h").alias("_h")).agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    q = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_h") - F.floor("_h"))
    return g.select(*keys, "prob", q.alias("q"))


def quantile_array(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "cuts",
                   small: bool = False) -> DataFrame:
    """One row per key with the quantiles as an ascending array."""
    if small:
        p = F.array(*[F.lit(float(x)) for x in probs])
        return df.groupBy(*keys).agg(F.percentile(value, p).alias(name))
    q = quantiles(df, keys, value, probs)
    arr = F.array_sort(F.collect_list(F.struct("prob", "q")))
    return q.groupBy(*keys).agg(F.transform(arr, lambda s: s["q"]).alias(name))
