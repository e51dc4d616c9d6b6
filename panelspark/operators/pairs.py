"""Correlated pairs and the eigen spectrum of a pool of any size.

Pairs: series are standardised and projected on ``SKETCH`` random directions; blocks of the sketches are compared tile by tile, and what could pass the bound
is verified exactly from the series.  Series with gaps have no valid sketch for a pair's common dates: their tiles are compared exactly.  No task holds more than
two blocks, only pairs that pass come out.

Spectrum: the leading eigenvalues of the correlation matrix by block iterations, each one matrix-vector product on the long panel and back; a symbol and a
date are rows with a short vector, and only matrices of the size of the block reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage, ship

#: Directions of a sketch, series of a block.
SKETCH, BLOCK = 256, 256
#: The sketch's cosine is off by less than this many of its standard deviations (1 / sqrt(SKETCH)): under one pair in 10^9 is off by more.
DEVIATIONS = 6.0


def series_table(returns: DataFrame, ret: str) -> tuple[DataFrame, int]:
    """(symbol, days (ascending numbers of its dates), x (its values), whole: no date missing; the number of dates.)  A date counts once for a symbol."""
    x = returns.where(F.col(ret).isNotNull() & ~F.isnan(F.col(ret).cast("double"))).select("symbol", "date", F.col(ret).cast("double").alias("r"))
    day = cut_lineage(x.select("date").distinct().withColumn("day", (F.row_number().over(Window.orderBy("date")) - 1).cast("int")))  # one row a date
    n = day.count()
    each = x.join(day, "date").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "r"))).alias("v"))
    return each.select("symbol", F.col("v.day").alias("days"), F.col("v.r").alias("x"), (F.size("v") == n).alias("whole")), n


def directions(n: int) -> np.ndarray:
    """The same n x SKETCH matrix of signs in every task, scaled so that products of sketches estimate products of series."""
    return np.random.default_rng(n).integers(0, 2, (n, SKETCH), np.int8) * np.float32(2 / SKETCH**0.5) - np.float32(1 / SKETCH**0.5)


def _tiles(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Every row once for each tile (i <= j) of blocks that its own block ``blk`` of ``blocks`` belongs to."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("_o", other).withColumns({a: F.least("blk", "_o"), b: F.greatest("blk", "_o")}).drop("_o")


def strong_pairs(returns: DataFrame, bound: float = 0.8, ret: str = "ret", min_periods: int = 60) -> DataFrame:
    """a < b, n (common dates) and rho of all pairs of symbols with an absolute correlation of ``bound`` on at least ``min_periods`` common dates."""
    ship(returns.sparkSession)
    table, n = series_table(returns, ret)
    table = cut_lineage(table)
    whole = table.groupBy("whole").count().collect()  # two rows
    size = {r["whole"]: r["count"] for r in whole}
    blocks = {k: -(-v // BLOCK) for k, v in size.items()}
    least = bound - DEVIATIONS / SKETCH**0.5 if n else bound

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = directions(n)
        for b in batches:
            x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, n))
            x = x - x.mean(1, keepdims=True)
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            u = np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0)
            yield pd.DataFrame({"symbol": b["symbol"], "s": list((u.astype(np.float32) @ g))})

    def candidates(t: pd.DataFrame) -> pd.DataFrame:
        i, j = int(t["i"].iloc[0]), int(t["j"].iloc[0])
        left, right = t[t["blk"] == i], t[t["blk"] == j]
        c = np.stack(left["s"].to_numpy()) @ np.stack(right["s"].to_numpy()).T if len(left) and len(right) else np.zeros((0, 0))
        p, q = np.nonzero(np.abs(c) >= least)
        a, b = left["symbol"].to_numpy()[p], right["symbol"].to_numpy()[q]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    def wide(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        v = np.full((len(t), n), np.nan)
        for r, (d, x) in enumerate(zip(t["days"], t["x"], strict=True)):
            v[r, d] = x
        return np.nan_to_num(v), np.isfinite(v).astype(float)

    def exact(a: pd.DataFrame, b: pd.DataFrame, names_a: np.ndarray, names_b: np.ndarray) -> pd.DataFrame:
        """Pairwise complete correlations of two blocks, those that pass."""
        (x, m), (y, k) = wide(a), wide(b)
        cnt, xy, sx, sy, xx, yy = m @ k.T, x @ y.T, x @ k.T, m @ y.T, (x * x) @ k.T, m @ (y * y).T
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = xx - sx * sx / cnt, yy - sy * sy / cnt
            rho = np.where((vx > 0) & (vy > 0), (xy - sx * sy / cnt) / np.sqrt(vx * vy), np.nan)
        p, q = np.nonzero((cnt >= min_periods) & (np.abs(rho) >= bound))
        u, v = names_a[p], names_b[q]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "n": cnt[p, q].astype(np.int64), "rho": rho[p, q]})[u != v].drop_duplicates(["a", "b"])

    def verify(t: pd.DataFrame) -> pd.DataFrame:
        """The candidate pairs of a tile, a series and its partners at a time."""
        out = [exact(g[["days_a", "x_a"]].set_axis(["days", "x"], axis=1).head(1), g[["days_b", "x_b"]].set_axis(["days", "x"], axis=1), g["a"].to_numpy()[:1], g["b"].to_numpy()) for _, g in t.groupby("a")]
        return pd.concat(out)

    def gaps(t: pd.DataFrame) -> pd.DataFrame:
        i, j = int(t["i"].iloc[0]), int(t["j"].iloc[0])
        left, right = t[t["blk"] == i], t[t["blk"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": [], "rho": []})
        return exact(left, right, left["symbol"].to_numpy(), right["symbol"].to_numpy())

    schema = "a string, b string, n long, rho double"
    number = lambda k: F.pmod(F.xxhash64("symbol"), F.lit(max(blocks.get(k, 0), 1))).cast("int")
    full, part = table.where("whole").drop("whole"), table.where("not whole").drop("whole")
    s = full.select("symbol", "x").mapInPandas(sketch, "symbol string, s array<float>").withColumns({"blk": number(True), "blocks": F.lit(blocks.get(True, 0))})
    pair = _tiles(s, "i", "j").groupBy("i", "j").applyInPandas(candidates, "a string, b string")
    both = pair.join(full.select(F.col("symbol").alias("a"), F.col("days").alias("days_a"), F.col("x").alias("x_a")), "a").join(full.select(F.col("symbol").alias("b"), F.col("days").alias("days_b"), F.col("x").alias("x_b")), "b")
    # a tile of 16 series a side; a symbol with very many partners is many groups
    sure = both.groupBy(F.pmod(F.xxhash64("a"), F.lit(max(size.get(True, 0) // 16, 1))).alias("i"), F.pmod(F.xxhash64("b"), F.lit(max(size.get(True, 0) // 16, 1))).alias("j")).applyInPandas(verify, schema)
    # series with gaps meet each other, and those without; blocks of the first come before those of the second
    shift = blocks.get(False, 0)
    marked = part.withColumns({"blk": number(False), "gap": F.lit(True)}).unionByName(full.withColumns({"blk": number(True) + shift, "gap": F.lit(False)})).withColumn("blocks", F.lit(shift + blocks.get(True, 0)))
    rest = _tiles(marked, "i", "j").where(F.col("i") < shift).groupBy("i", "j").applyInPandas(gaps, schema)
    return sure.unionByName(rest)


def standardised(returns: DataFrame, ret: str = "ret", residual: bool = False, min_periods: int = 60) -> DataFrame:
    """symbol, date, z: values less the symbol's mean over its population deviation, scaled so that the squares of a symbol sum to 1.

    ``residual``: what a regression on the date's mean over all symbols leaves.  Symbols under ``min_periods`` dates or without variance are left out.
    """
    x = returns.where(F.col(ret).isNotNull() & ~F.isnan(F.col(ret).cast("double"))).select("symbol", "date", F.col(ret).cast("double").alias("r"))
    if residual:
        x = x.join(x.groupBy("date").agg(F.avg("r").alias("m")), "date")
        fit = x.groupBy("symbol").agg(F.regr_slope("r", "m").alias("beta"), F.regr_intercept("r", "m").alias("alpha"))
        x = x.join(fit, "symbol").where("beta is not null").select("symbol", "date", (F.col("r") - F.col("alpha") - F.col("beta") * F.col("m")).alias("r"))
    m = x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd")).where((F.col("n") >= min_periods) & (F.col("sd") > 1e-12))
    return x.join(m, "symbol").select("symbol", "date", ((F.col("r") - F.col("mean")) / F.col("sd") / F.sqrt("n")).alias("z"))


def eigen_spectrum(returns: DataFrame, k: int = 3, ret: str = "ret", residual: bool = False, min_periods: int = 60, tol: float = 1e-7, max_rounds: int = 60) -> DataFrame:
    """component, eigenvalue, share (of the number of symbols) of the ``k`` leading components of the correlation matrix; a missing date counts as a symbol's mean.

    Each round spans the present vectors, their residuals and the last directions, so it gains like conjugate gradients; one product with the panel a
    round.  The rest of the driver's work is on matrices of three blocks.  Rounds end when no eigenvalue moves by ``tol`` of itself.
    """
    z = cut_lineage(standardised(returns, ret, residual, min_periods))
    symbols = z.select("symbol").distinct()
    total = symbols.count()
    spark = returns.sparkSession
    schema = "component int, eigenvalue double, share double"
    if not total:
        return spark.createDataFrame([], schema)
    m = min(total, k + 3)
    unit = lambda i: F.pmod(F.xxhash64("symbol", F.lit(i)), F.lit(2000003)) / 1000001.5 - 1

    def times(v: DataFrame, count: int) -> DataFrame:
        """symbol, w: the product of the matrix with the vectors (symbol, v)."""
        y = z.join(v, "symbol").groupBy("date").agg(*[F.sum(F.col("z") * F.get("v", F.lit(i))).alias(f"y{i}") for i in range(count)])
        y = y.select("date", F.array(*[f"y{i}" for i in range(count)]).alias("y"))
        w = z.join(y, "date").groupBy("symbol").agg(*[F.sum(F.col("z") * F.get("y", F.lit(i))).alias(f"w{i}") for i in range(count)])
        return w.select("symbol", F.array(*[f"w{i}" for i in range(count)]).alias("w"))

    def gram(t: DataFrame, count: int) -> np.ndarray:
        """Products of all pairs of the entries of ``u`` (count long) and ``c``: two matrices."""
        cell = [F.sum(F.get(a, F.lit(i)) * F.get(b, F.lit(j))) for a, b in (("u", "u"), ("u", "c")) for i in range(count) for j in range(count)]
        got = t.agg(F.array(*cell).alias("g")).first()["g"]
        return np.array(got, float).reshape(2, count, count)

    def mix(t: DataFrame, col: str, r: np.ndarray) -> list:
        return [sum((F.get(col, F.lit(i)) * float(r[i, j]) for i in range(len(r)) if r[i, j]), F.lit(0.0)) for j in range(r.shape[1])]

    start = symbols.select("symbol", F.array(*[unit(i) for i in range(m)]).alias("v"))
    t = cut_lineage(start.join(times(start, m), "symbol").select("symbol", F.col("v").alias("u"), F.col("w").alias("c")))
    width, last = m, None
    for _ in range(max_rounds):
        g, h = gram(t, width)
        d = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        e, q = np.linalg.eigh(g * d[:, None] * d)
        basis = d[:, None] * q[:, e > 1e-12 * e.max()] / np.sqrt(e[e > 1e-12 * e.max()])  # orthonormal combinations
        ritz, s = np.linalg.eigh(basis.T @ ((h + h.T) / 2) @ basis)
        top = np.argsort(-ritz)[:m]
        ritz, r = ritz[top], basis @ s[:, top]
        if last is not None and np.all(np.abs(ritz[:k] - last[:k]) <= tol * np.abs(ritz[:k])):
            last = ritz
            break
        last = ritz
        now = len(top)
        # the part of the new vectors that does not lie in the old ones
        move = r.copy()
        move[:m] = 0
        cols = {"x": mix(t, "u", r), "cx": mix(t, "c", r)}
        if width > m:
            cols |= {"p": mix(t, "u", move), "cp": mix(t, "c", move)}
        new = t.select("symbol", *[F.array(*v).alias(n) for n, v in cols.items()])
        left = F.array(*[F.get("cx", F.lit(i)) - F.get("x", F.lit(i)) * float(ritz[i]) for i in range(now)])
        new = new.withColumn("v", left)
        w = times(new.select("symbol", "v"), now)
        parts = (["x", "v", "p"], ["cx", "w", "cp"]) if width > m else (["x", "v"], ["cx", "w"])
        t = cut_lineage(new.join(w, "symbol").select("symbol", F.concat(*parts[0]).alias("u"), F.concat(*parts[1]).alias("c")))
        width, m = now * len(parts[0]), now
    return spark.createDataFrame([(i + 1, float(v), float(v) / total) for i, v in enumerate(last[:k])], schema)
