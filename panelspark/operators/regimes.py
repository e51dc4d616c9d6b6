"""Hidden Markov regimes with expanding refits: every label uses the past only.

The rows of a series are cut in chunks of ``refit_every`` (the first holds what is over of the first fit's rows); fit ``r`` is made of chunks 0 to ``r``.  All fits of all series go through the same rounds of Baum-Welch.  In a round a chunk is one small matrix (the product of its rows'
transfer matrices), a pass in order of time multiplies these into the filter at the start of each chunk, a pass against it yields what is expected after
each chunk and sums the statistics, from which the last chunk of the pass makes the new parameters.  A pass is a sorted stream that carries one vector, so no
series is held in memory; ``ROUNDS`` rounds run in one job, then only fits that still gain go on.  A row of a pass is a block of chunks, and fits are dealt to
a fixed number of tasks: their rows are few bytes and much work, so a number of tasks chosen by bytes would leave most cores idle.

Starting values come from running totals of the chunks (n, sums, squares), so no fit reads its past for them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage, ship

ROUNDS = 5
#: Rows of a series in one row of a pass, about, and rows that are multiplied out in one piece.
BLOCK, PIECE = 160, 20
#: Fixed values of the reference model: least variance added at the start, prior of the variances.
VAR_FLOOR, VAR_PRIOR = 1e-3, 1e-2
TINY = 1e-300


class Model:
    """Parameters of ``s`` states over ``d`` observed columns as one flat vector: start, moves, means, variances, log-likelihood, rounds (-1: settled)."""

    def __init__(self, s: int, d: int):
        self.s, self.d = s, d
        self.size = s + s * s + 2 * s * d + 2

    def split(self, p: np.ndarray) -> tuple[np.ndarray, ...]:
        s, d, n = self.s, self.d, len(p)
        a, b, c = s, s + s * s, s + s * s + s * d
        return p[:, :a], p[:, a:b].reshape(n, s, s), p[:, b:c].reshape(n, s, d), p[:, c : c + s * d].reshape(n, s, d)

    def start(self, n: float, total: np.ndarray, square: np.ndarray) -> np.ndarray:
        """States at the mean of the first column less, plus nothing and plus one deviation, with the variance of all rows."""
        s, mean = self.s, total / n
        var = np.maximum(square / n - mean**2, 0)
        mu = np.tile(mean, (s, 1))
        mu[:, 0] += np.linspace(-1, 1, s) * np.sqrt(var[0])
        moves = np.full((s, s), 0.2 / max(s - 1, 1))
        np.fill_diagonal(moves, 0.8 if s > 1 else 1.0)
        return np.concatenate((np.full(s, 1 / s), moves.ravel(), mu.ravel(), np.tile(var + VAR_FLOOR, s), (-np.inf, 0.0)))

    def emission(self, p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(likelihood of each row in each state over its greatest, log of the greatest); ``x``: models, rows, columns."""
        _, _, mu, var = self.split(p)
        e = np.zeros((*x.shape[:2], self.s))
        for c in range(self.d):
            e += (x[:, :, None, c] - mu[:, None, :, c]) ** 2 / var[:, None, :, c]
        e = -0.5 * (e + np.log(2 * np.pi * var).sum(-1)[:, None])
        top = np.maximum.reduce([e[..., k] for k in range(self.s)])
        return np.exp(e - top[..., None]), top

    def forward(self, p: np.ndarray, b: np.ndarray, here: np.ndarray, first: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(filter at each row, log of its norm) for chunks entered with the filter ``into``; a chunk that is ``first`` starts from the start vector."""
        start, moves, _, _ = self.split(p)
        out, norm, v = np.zeros(b.shape), np.zeros(b.shape[:2]), into
        for t in range(b.shape[1]):
            step = np.einsum("ni,nij->nj", v, moves)
            w = (np.where(first[:, None], start, step) if t == 0 else step) * b[:, t]
            z = np.maximum(w.sum(-1), TINY)
            v = np.where(here[:, t, None], w / z[:, None], v)
            out[:, t], norm[:, t] = v, np.where(here[:, t], np.log(z), 0)
        return out, norm

    def product(self, p: np.ndarray, b: np.ndarray, here: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The product of the transfer matrices of each chunk, scaled to a greatest entry of one."""
        start, moves, _, _ = self.split(p)
        n, s = len(p), self.s
        m = np.tile(np.eye(s), (n, 1, 1))
        for t in range(b.shape[1]):
            one = np.where(first[:, None, None], np.repeat(start[:, None], s, 1), moves) if t == 0 else moves
            new = m @ (one * b[:, t, None, :])
            m = np.where(here[:, t, None, None], new / np.maximum(new.reshape(n, -1).max(1), TINY)[:, None, None], m)
        return m

    def statistics(self, p: np.ndarray, x: np.ndarray, b: np.ndarray, top: np.ndarray, here: np.ndarray, first: np.ndarray, into: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Sums of each chunk: start, moves, weights, weighted rows, weighted squares, log-likelihood; ``after``: what follows, in each state at its end."""
        start, moves, _, _ = self.split(p)
        a, norm = self.forward(p, b, here, first, into)
        n, s = len(p), self.s
        gamma, xi, beta = np.zeros(a.shape), np.zeros((n, s, s)), after
        for t in reversed(range(b.shape[1])):
            on = here[:, t, None]
            g = a[:, t] * beta
            gamma[:, t] = np.where(on, g / np.maximum(g.sum(-1, keepdims=True), TINY), 0)
            back = b[:, t] * beta
            before = a[:, t - 1] if t else into
            pair = before[:, :, None] * moves * back[:, None, :]
            pair /= np.maximum(pair.sum((1, 2), keepdims=True), TINY)
            xi += np.where(here[:, t, None, None] & ~(first[:, None, None] & (t == 0)), pair, 0)
            new = np.einsum("nij,nj->ni", moves, back)
            beta = np.where(on, new / np.maximum(new.max(-1, keepdims=True), TINY), beta)
        like = (np.where(here, top, 0) + norm).sum(1)
        begin = np.where(first[:, None], gamma[:, 0], 0)
        flat = [begin, xi.reshape(n, -1), gamma.sum(1), np.einsum("nts,ntd->nsd", gamma, x).reshape(n, -1), np.einsum("nts,ntd->nsd", gamma, x * x).reshape(n, -1), like[:, None]]
        return np.concatenate(flat, 1)

    def update(self, p: np.ndarray, sums: np.ndarray, tol: float) -> np.ndarray:
        """New parameters; a fit whose log-likelihood gains less than ``tol`` keeps its own and is settled, as is one that lost."""
        s, d = self.s, self.d
        begin, xi, w, x, q, like = np.split(sums, np.cumsum([s, s * s, s, s * d, s * d]))
        xi, x, q = xi.reshape(s, s), x.reshape(s, d), q.reshape(s, d)
        if like[0] - p[-2] < tol:
            return np.concatenate((p[:-1], [-1.0]))
        _, moves, mu, _ = (c[0] for c in self.split(p[None]))
        row = xi.sum(1, keepdims=True)
        moves = np.where(row > 0, xi / np.maximum(row, TINY), moves)
        mean = np.where(w[:, None] > 1e-12, x / np.maximum(w, TINY)[:, None], mu)
        var = (VAR_PRIOR + q - 2 * mean * x + mean**2 * w[:, None]) / np.maximum(w, 1e-5)[:, None]
        return np.concatenate((begin / max(begin.sum(), TINY), moves.ravel(), mean.ravel(), np.maximum(var, 1e-12).ravel(), (like[0], p[-1] + 1)))


def chunks(obs: DataFrame, columns: Sequence[str], key: str, order: str, start: int, refit_every: int) -> DataFrame:
    """key, chunk, at (the places of its rows), x (rows end to end) and full: whether all rows are there."""
    over = start % refit_every or refit_every
    x = [F.col(c).cast("double") for c in columns]
    good = obs.select(F.col(key).alias("key"), F.col(order).alias("at"), F.array(*x).alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    row = good.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("at")))
    chunk = F.when(F.col("k") <= over, 0).otherwise(F.floor((F.col("k") - over - 1) / refit_every) + 1).cast("int")
    own = row.withColumn("chunk", chunk).groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "at", "x"))).alias("r"))
    return own.select("key", "chunk", F.col("r.at").alias("at"), F.flatten("r.x").alias("x"), (F.size("r") == F.when(F.col("chunk") == 0, over).otherwise(refit_every)).alias("full"))


def blocks(chunk: DataFrame, size: int) -> DataFrame:
    """Each chunk behind those of its block before it.  Fit ``r`` is made of the last rows of the blocks before ``r``'s and of row ``r``."""
    w = Window.partitionBy("key", F.floor(F.col("chunk") / size)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return chunk.select("key", "chunk", F.flatten(F.collect_list("x").over(w)).alias("x"))


def deal(df: DataFrame, chunks: int) -> DataFrame:
    """Rows of one fit in one of as many tasks as pay for their start: up to one for each core, three where there is much to do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(min(-(-chunks // 1000), cores), min(chunks // 4000, 3 * cores), 1)
    return df.repartitionById(n, F.pmod(F.hash("key") + F.col("fit"), F.lit(n)))


def _matrix(c: pa.Array, width: int) -> np.ndarray:
    """Lists of one length, nulls left out, as rows."""
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def _rows(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, rows, columns) and which of the rows are there."""
    n = b.column("x").value_lengths().to_numpy() // d
    x = np.zeros((len(n), max(n.max(), 1), d))
    here = np.arange(x.shape[1])[None] < n[:, None]
    x[here] = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return x, here


def _grid(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, pieces, rows, columns), which of the rows are there and which of the pieces."""
    x, here = _rows(b, d)
    n, long = here.shape
    g = -(-long // PIECE)
    x, here = np.pad(x, ((0, 0), (0, g * PIECE - long), (0, 0))), np.pad(here, ((0, 0), (0, g * PIECE - long)))
    here = here.reshape(n, g, PIECE)
    return x.reshape(n, g, PIECE, d), here, here.any(2)


def _running(trans: np.ndarray, back: bool = False) -> np.ndarray:
    """Products of the matrices of a block before each piece and after the last; ``back``: from each piece on, and after the last."""
    n, g, s, _ = trans.shape
    out = np.tile(np.eye(s), (n, g + 1, 1, 1))
    for k in reversed(range(g)) if back else range(g):
        new = trans[:, k] @ out[:, k + 1] if back else out[:, k] @ trans[:, k]
        out[:, k if back else k + 1] = new / np.maximum(new.max((1, 2), keepdims=True), TINY)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def fits(chunk: DataFrame, columns: int, states: int, first_fit: int, tol: float, max_rounds: int, size: int = 1) -> tuple[DataFrame, Model]:
    """key, fit, p: the parameters of each fit from number ``first_fit`` on; ``size``: chunks of a block."""
    m, d = Model(states, columns), columns
    width = states + states * states + states + 2 * states * d + 1
    key = chunk.schema["key"].dataType.simpleString()
    names = ["n", *[f"{e}{c}" for e in ("sum", "square") for c in range(d)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x, here = _rows(b, d)
            t = np.concatenate((here.sum(1)[:, None], x.sum(1), (x * x).sum(1)), 1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), *map(pa.array, t.T)], names=["key", "chunk", *names])

    total = chunk.select("key", "chunk", "x").mapInArrow(count, f"key {key}, chunk int, " + ", ".join(f"{c} double" for c in names))
    w = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    run = total.select("key", F.col("chunk").alias("fit"), F.array(*[F.sum(c).over(w) for c in names]).alias("t")).where(F.col("fit") >= first_fit)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [m.start(t[0], np.array(t[1 : 1 + d]), np.array(t[1 + d :])).tolist() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("fit"), pa.array(p, pa.list_(pa.float64()))], names=["key", "fit", "p"])

    schema = f"key {key}, fit int, chunk int, x array<double>, p array<double>, v array<double>"

    def out(b: pa.RecordBatch, p: np.ndarray, v: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("fit"), b.column("chunk"), b.column("x"), _lists(p), v], names=["key", "fit", "chunk", "x", "p", "v"])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In order of time; the row of parameters (chunk -1) comes first.  v: of each piece the filter at its start and its matrix."""
        last, p, carry = None, None, None
        for b in _pieces(batches, 256):
            ids = list(zip(b.column("key").to_pylist(), b.column("fit").to_pylist(), strict=True))
            number = b.column("chunk").to_numpy()
            # each row takes the parameters that stand before it
            given = _matrix(b.column("p").filter(pa.array(number < 0)), m.size)
            held = np.concatenate((given[:0] if p is None else p[None], given))
            all_p = held[np.cumsum(number < 0) - (p is None)]
            x, here, there = _grid(b, d)
            n, g = there.shape
            e, _ = m.emission(all_p, x.reshape(n, -1, d))
            first = ((number >= 0) & (number < size))[:, None] & (np.arange(g) == 0)
            trans = m.product(np.repeat(all_p, g, 0), e.reshape(n * g, PIECE, m.s), here.reshape(n * g, PIECE), first.ravel()).reshape(n, g, m.s, m.s)
            run, into = _running(trans), np.zeros((n, m.s))
            for i, who in enumerate(ids):
                if who != last:
                    last, carry = who, np.full(m.s, 1 / m.s)
                into[i] = carry
                carry = carry @ run[i, g]
                carry = carry / max(carry.sum(), TINY)
            v = np.einsum("ni,ngij->ngj", into, run[:, :g])
            v /= np.maximum(v.sum(-1, keepdims=True), TINY)
            flat = np.concatenate((v, trans.reshape(n, g, -1)), 2)
            ends = np.concatenate(([0], np.cumsum(there.sum(1) * flat.shape[2])))
            p = all_p[-1]
            yield out(b, all_p, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[there].ravel())))

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Against time; the row of parameters comes last and takes the sums."""
        last, carry, sums = None, None, None
        for b in _pieces(batches, 256):
            ids = list(zip(b.column("key").to_pylist(), b.column("fit").to_pylist(), strict=True))
            number = b.column("chunk").to_numpy()
            p = _matrix(b.column("p"), m.size)
            x, here, there = _grid(b, d)
            n, g = there.shape
            e, top = m.emission(p, x.reshape(n, -1, d))
            first = ((number >= 0) & (number < size))[:, None] & (np.arange(g) == 0)
            given = _matrix(b.column("v"), m.s + m.s**2)
            into, trans = np.zeros((n, g, m.s)), np.tile(np.eye(m.s), (n, g, 1, 1))
            into[there], trans[there] = given[:, : m.s], given[:, m.s :].reshape(-1, m.s, m.s)
            run, after = _running(trans, back=True), np.zeros((n, m.s))
            for i, who in enumerate(ids):
                if who != last:
                    last, carry = who, np.ones(m.s)
                after[i] = carry
                carry = run[i, 0] @ carry
                carry = carry / max(carry.max(), TINY)
            rest = np.einsum("ngij,nj->ngi", run[:, 1:], after)
            rest /= np.maximum(rest.max(-1, keepdims=True), TINY)
            part = m.statistics(np.repeat(p, g, 0), *(a.reshape(n * g, PIECE, *a.shape[k:]) for a, k in ((x, 3), (e, 2), (top, 2), (here, 3))),
                                first.ravel(), into.reshape(n * g, -1), rest.reshape(n * g, -1)).reshape(n, g, -1).sum(1)
            new = p.copy()
            for i, who in enumerate(ids):
                if sums is None or sums[0] != who:
                    sums = (who, np.zeros(width))
                if number[i] >= 0:
                    sums = (who, sums[1] + part[i])
                elif p[i, -1] >= 0:
                    new[i] = m.update(p[i], sums[1], tol)
            yield out(b, new, pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.float64())))

    def chunks_of(model: DataFrame) -> int:
        return model.agg(F.sum(F.col("fit").cast("long") + 1)).first()[0] or 0

    none = F.lit(None).cast("array<double>")
    model = cut_lineage(run.mapInArrow(begin, f"key {key}, fit int, p array<double>"))
    done, work = None, chunks_of(model)
    block = cut_lineage(blocks(chunk, size)).select(F.col("key").alias("_k"), F.col("chunk").alias("_c"), "x")
    last = F.lit(size - 1)
    own = F.array_union(F.when(F.col("fit") >= last, F.sequence(last, "fit", F.lit(size))).otherwise(F.array().cast("array<int>")), F.array("fit"))
    for _ in range(0, max_rounds, ROUNDS):
        rows = model.select("key", "fit", F.lit(-1).alias("chunk"), F.array().cast("array<double>").alias("x"), "p").unionByName(
            model.select("key", "fit", F.explode(own).alias("chunk")).join(block, F.col("key").eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_c"))).select("key", "fit", "chunk", "x", none.alias("p")))
        rows = deal(rows.withColumn("v", none), work)
        for _ in range(ROUNDS):
            rows = rows.sortWithinPartitions("key", "fit", "chunk").mapInArrow(ahead, schema)
            rows = rows.sortWithinPartitions("key", "fit", F.desc("chunk")).mapInArrow(behind, schema)
        new = cut_lineage(rows.where("chunk = -1").select("key", "fit", "p"))
        settled = F.element_at("p", -1) < 0
        over = new.where(settled)
        done = over if done is None else done.unionByName(over)
        model = new.where(~settled)
        work = chunks_of(model)
        if not work:
            break
    return (model if done is None else done.unionByName(model)), m


def labels(obs: DataFrame, columns: Sequence[str] = ("log_ret", "vol"), key: str = "pool", order: str = "date", states: int = 3, refit_every: int = 20, start: int = 60, tol: float = 1e-4, max_rounds: int = 100) -> DataFrame:
    """key, order, state (0: least mean of the first column) and regime of each row from the ``start``-th complete row on.

    A row takes the filter of the last fit whose rows it does not precede: the last row of a fit and those up to the next fit's.  The filter has seen the
    rows up to its own only.  Rows with a null, NaN or infinite column are no observations; a series of fewer than ``start`` rows has no labels.
    """
    d = len(columns)
    ship(obs.sparkSession)
    chunk = cut_lineage(chunks(obs, columns, key, order, start, refit_every))
    model, m = fits(chunk.where("full").select("key", "chunk", "x"), d, states, -(-start // refit_every) - 1, tol, max_rounds, max(BLOCK // refit_every, 1))
    p = model.select(F.col("key").alias("_k"), "fit", "p")
    kind, time = chunk.schema["key"].dataType.simpleString(), chunk.schema["at"].dataType.elementType.simpleString()
    # a fit filters its own chunks and the one after it
    rows = chunk.join(p, F.col("key").eqNullSafe(F.col("_k")) & (F.col("chunk") <= F.col("fit") + 1)).select("key", "fit", "chunk", "at", "x", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for b in _pieces(batches):
            ids = list(zip(b.column("key").to_pylist(), b.column("fit").to_pylist(), strict=True))
            number, dates = np.array(b.column("chunk").to_pylist()), b.column("at").to_pylist()
            par = _matrix(b.column("p"), m.size)
            x, here = _rows(b, d)
            e, _ = m.emission(par, x)
            first = number == 0
            trans = m.product(par, e, here, first)
            into = np.zeros((b.num_rows, m.s))
            for i, who in enumerate(ids):
                if who != last:
                    last, carry = who, np.full(m.s, 1 / m.s)
                into[i] = carry
                carry = carry @ trans[i]
                carry = carry / max(carry.sum(), TINY)
            seen, _ = m.forward(par, e, here, first, into)
            rank = m.split(par)[2][:, :, 0].argsort(1).argsort(1)
            state = np.take_along_axis(rank, seen.argmax(2), 1)
            got: list[tuple] = []
            for i, (who, c) in enumerate(zip(ids, number.tolist(), strict=True)):
                n = len(dates[i])
                span = range(n - 1, n) if c == who[1] else range(min(n, refit_every - 1)) if c == who[1] + 1 else ()
                got += [(who[0], dates[i][t], int(state[i, t])) for t in span]
            if got:
                k, t, s = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field("key").type), pa.array(t, b.schema.field("at").type.value_type), pa.array(s, pa.int32())], names=["key", "at", "state"])

    work = model.agg(F.sum(F.col("fit").cast("long") + 2)).first()[0] or 0
    got = deal(rows, work).sortWithinPartitions("key", "fit", "chunk").mapInArrow(run, f"key {kind}, at {time}, state int")
    names = ["bear", "range", "bull"] if states == 3 else [f"state_{i}" for i in range(states)]
    return got.select(F.col("key").alias(key), F.col("at").alias(order), "state", F.get(F.array(*map(F.lit, names)), F.col("state")).alias("regime"))
