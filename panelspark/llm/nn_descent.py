"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy graph search answers queries.

Equal vectors are one node (the smallest id stands for them), so a vector shared by a third of the rows is one node whose members are listed again at the
end.  The first graph comes from blocks of rows that lie side by side under random hyperplanes, all rows of a block against all; further sets of hyperplanes are
laid until few edges are new, so the descent begins near its end.  Each descent round joins, at every node, its neighbours and reverse neighbours with one another: rows (node, neighbour, code of the neighbour) are sorted by node and taken in blocks of 64, so a node that
very many others point to is many blocks, none of them left out.  Pairs closer than the farthest neighbour kept so far enter the graph.

A search begins at its own node.  A sample of the queries is measured against all nodes; as long as too few of their nearest are found, all searches go on
with twice the nodes held, and from the hubs of the graph as well.

Building and search carry the vectors themselves (32 bits a component), and every distance is measured in double precision.

Vectors that are null, zero, hold a null or non-finite component, or have another length than most take no part, neither as queries nor as candidates.
Rows without id take none either.  Rows of equal id and equal vector count once; of equal id and different vectors each counts.  A table with few
rows gives as many neighbours as there are; an empty one an empty result.  Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Kept, ship

NEIGHBOURS, TREES, PLANES, LEAF, BLOCK, BEAM = 16, 8, 12, 1024, 64, 48
#: Share of new edges below which no more trees are laid.
GROWN = 0.05
#: Nodes of most neighbours from which a search that is widened goes on as well; queries measured against all nodes, and the share of their nearest that must be found.
HUBS, SAMPLE, FOUND = 16, 64, 0.97


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (array of float) of the rows that take part."""
    v = F.col(vec_col).cast("array<float>")
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (size[0] if size else 0)).distinct()


def matrix(col: pa.Array, kind=np.float32) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()).astype(kind, copy=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1), kind)


def codes(col: pa.Array) -> np.ndarray:
    """Fixed-length byte strings as rows of components."""
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(col), -1).astype(np.float64)


def squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all; taken from the differences, so neither a far row nor close ones blur them."""
    return np.stack([np.square(x - row).sum(1) for row in x])


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str] | None, most: int) -> Iterator[pa.Table]:
    """The rows of a sorted stream in blocks of one key and at most ``most`` rows; without keys in blocks of ``most``."""
    held: pa.Table | None = None

    def cut(t: pa.Table, last: bool) -> Iterator[pa.Table | int]:
        n = t.num_rows
        if keys:
            change = np.zeros(n, bool)
            for k in keys:
                x = np.asarray(t.column(k))
                change[1:] |= x[1:] != x[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), n]
        else:
            starts = [0, n]
        for a, b in zip(starts, starts[1:], strict=False):
            full = b < n or last
            while b - a > most or (full and a < b):
                yield t.slice(a, min(most, b - a))
                a = min(a + most, b)
        yield a  # where the rows that wait for more begin

    for b in batches:
        t = pa.Table.from_batches([b])
        held = pa.concat_tables([held, t]) if held is not None and held.num_rows else t
        for x in cut(held, False):
            if isinstance(x, int):
                held = held.slice(x).combine_chunks()
            else:
                yield x
    if held is not None and held.num_rows:
        yield from (x for x in cut(held, True) if not isinstance(x, int))


def closest(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the ``m`` nearest other rows, squared distances) for each row.

    The nearest are chosen by products, from the middle of the rows so that a far row blurs no other, and measured by their differences; rows so close to
    others that products cannot tell them apart are measured by differences throughout.
    """
    mid = x - np.median(x, axis=0)
    norm = np.square(mid).sum(1)
    d = norm[:, None] + norm[None] - 2 * (mid @ mid.T)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    for i in np.flatnonzero(~(np.take_along_axis(d, near, 1).min(1) > 1e-8 * norm)):
        d[i] = np.square(x - x[i]).sum(1)
        d[i, i] = np.inf
        near[i] = np.argpartition(d[i], m - 1)[:m]
    return near, np.stack([np.square(x[c] - row).sum(1) for c, row in zip(near, x, strict=True)])


def bounds(graph: DataFrame, k: int) -> DataFrame:
    """node, far: the distance that a new neighbour must undercut."""
    return graph.groupBy("node").agg(F.max("d").alias("far"), F.count("*").alias("n")).select("node", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("far")).alias("far"))


def forest(nodes: DataFrame, n: int, dim: int, k: int, turn: int, graph: DataFrame | None = None) -> DataFrame:
    """node, nbr, d: the nearest in blocks of rows under each of several sets of random hyperplanes, if nearer than the neighbours that ``graph`` has.

    Rows on the same side of all planes, as those of a tight group, are cut into blocks along one more direction.  ``turn`` draws other hyperplanes.
    """
    draw = np.random.default_rng(11 + turn)
    planes, axes = draw.normal(size=(TREES * PLANES, dim)), draw.normal(size=(TREES, dim))
    weight = (1 << np.arange(PLANES - 1, -1, -1)).astype(np.int64)
    names = ["node", "code", "far"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = codes(b.column("code"))
                side, along = (x @ planes.T > 0).reshape(b.num_rows, TREES, PLANES) @ weight, x @ axes.T
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(side[:, t].astype(np.int32)), pa.array(along[:, t])], names=[*names, "tree", "leaf", "along"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, ["tree"], LEAF):
            if t.num_rows < 2:
                continue
            ids, far = (np.asarray(t.column(c)) for c in ("node", "far"))
            near, d = closest(codes(t.column("code")), min(k, len(ids) - 1))
            i, j = np.nonzero(d < far[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[near[i, j]]), pa.array(d[i, j])], names=["node", "nbr", "d"])

    none = F.lit(float("inf"))
    bound = nodes.withColumn("far", none) if graph is None else nodes.join(bounds(graph, k), "node", "left").withColumn("far", F.coalesce("far", none))
    placed = bound.select(*names).mapInArrow(place, "node long, code binary, far double, tree int, leaf int, along double")
    laid = placed.repartition(max(1, n * TREES // 8192), "tree", F.shiftright("leaf", PLANES - 5)).sortWithinPartitions("tree", "leaf", "along")
    return laid.mapInArrow(nearest, "node long, nbr long, d double")


def first_graph(nodes: DataFrame, n: int, dim: int, kept: Kept, k: int) -> tuple[DataFrame, str]:
    """The graph before the descent, as a kept table, and its path: trees are laid until fewer than ``GROWN`` of the edges are new."""
    graph, path = kept.write(best(forest(nodes, n, dim, k, 0), k).withColumn("fresh", F.lit(1)))
    for turn in count(1):
        found = forest(nodes, n, dim, k, turn, graph).withColumn("fresh", F.lit(1))
        new, new_path = kept.write(best(graph.select("node", "nbr", "d", F.lit(0).alias("fresh")).unionByName(found), k))
        kept.drop(path)
        graph, path = new, new_path
        total, fresh = graph.agg(F.count("*"), F.sum("fresh")).first()
        if not total or fresh < GROWN * total:
            return graph.withColumn("fresh", F.lit(1)), path


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest distinct neighbours of each node; ``fresh`` survives if the pair is not an old one."""
    extra = [F.min(c).alias(c) for c in pairs.columns if c == "fresh"]
    w = Window.partitionBy("node").orderBy("d", "nbr")
    return pairs.groupBy("node", "nbr").agg(F.min("d").alias("d"), *extra).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def descend(graph: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: node, nbr, d, fresh (1: found in this round).  ``turn`` deals the neighbours of a hub to other blocks each time."""
    far = bounds(graph, k)
    both = graph.select(F.col("node").alias("at"), F.col("nbr").alias("node"), "fresh").unionByName(graph.select(F.col("nbr").alias("at"), "node", "fresh")).groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    met = both.join(nodes.join(far, "node", "left").select("node", "code", F.coalesce("far", F.lit(float("inf"))).alias("far")), "node")
    met = met.repartition("at").sortWithinPartitions("at", F.xxhash64("node", F.lit(turn)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c, rows = [], [], [], 0
        for t in blocks(batches, ["at"], BLOCK):
            ids, fresh, far = (np.asarray(t.column(x)) for x in ("node", "fresh", "far"))
            if len(ids) < 2 or not fresh.any():
                continue
            x = codes(t.column("code"))
            d = squares(x)
            np.fill_diagonal(d, np.inf)
            i, j = np.nonzero((d < far[:, None]) & ((fresh[:, None] + fresh[None]) > 0))
            a.append(ids[i])
            b.append(ids[j])
            c.append(d[i, j])
            rows += len(i)
            if rows > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (a, b, c)], names=["node", "nbr", "d"])
                a, b, c, rows = [], [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (a, b, c)], names=["node", "nbr", "d"])

    found = met.select("at", "node", "fresh", "far", "code").mapInArrow(run, "node long, nbr long, d double").withColumn("fresh", F.lit(1))
    return best(graph.select("node", "nbr", "d", F.lit(0).alias("fresh")).unionByName(found), k)


def build(nodes: DataFrame, n: int, dim: int, kept: Kept, k: int = NEIGHBOURS, settled: float = 0.01) -> DataFrame:
    """The graph, as a kept table: rounds go on until fewer than ``settled`` of its edges are new."""
    graph, path = first_graph(nodes, n, dim, kept, k)
    for turn in count():
        new, new_path = kept.write(descend(graph, nodes, k, turn))
        kept.drop(path)
        graph, path = new, new_path
        total, fresh = graph.agg(F.count("*"), F.sum("fresh")).first()
        if not total or fresh < settled * total:
            return graph


def closer(pairs: DataFrame) -> DataFrame:
    """Adds ``d`` to pairs with the codes ``code`` and ``qcode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = np.square(codes(b.column("code")) - codes(b.column("qcode"))).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(d)], names=["q", "node", "d"])

    return pairs.select("q", "node", "code", "qcode").mapInArrow(run, "q long, node long, d double")


def ways(graph: DataFrame) -> DataFrame:
    """The edges of the graph in either direction."""
    return graph.select("node", "nbr").unionByName(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()


def own(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """q, node, d of the nodes at which the searches begin."""
    return closer(queries.select("q", F.col("start").alias("node"), "qcode").join(nodes, "node").select("q", "node", "code", "qcode"))


def hubs(queries: DataFrame, nodes: DataFrame, way: DataFrame) -> DataFrame:
    """q, node, d of the nodes of most neighbours, for every query."""
    most = way.groupBy("node").count().orderBy(F.desc("count"), "node").limit(HUBS).select("node").join(nodes, "node")
    return closer(queries.select("q", "start", "qcode").crossJoin(F.broadcast(most)).where("node <> start").select("q", "node", "code", "qcode"))


def search(queries: DataFrame, nodes: DataFrame, way: DataFrame, held: DataFrame, kept: Kept, beam: int) -> tuple[DataFrame, str]:
    """q, node, d: the ``beam`` nearest nodes found for each query (q, qcode) from those in ``held`` on, and the path of the table.

    Every hop opens the beam's unopened nodes, measures their neighbours in either direction and keeps the nearest; it ends when no unopened node is left.
    """
    held, path = kept.write(held.select("q", "node", "d", F.lit(1).alias("open")))
    order = Window.partitionBy("q").orderBy("d", "node")
    while True:
        step = held.where("open = 1").select("q", "node").join(way, "node").select("q", F.col("nbr").alias("node")).distinct().join(held.select("q", "node"), ["q", "node"], "left_anti")
        seen = closer(step.join(nodes, "node").join(queries.select("q", "qcode"), "q"))
        new = held.select("q", "node", "d", F.lit(0).alias("open")).unionByName(seen.withColumn("open", F.lit(1))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).drop("r")
        new, new_path = kept.write(new)
        kept.drop(path)
        held, path = new, new_path
        if not held.where("open = 1").limit(1).count():
            return held.select("q", "node", "d"), path


def reach(queries: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """q, n, far: for a sample of the queries the number (``top`` at most) of the nearest other nodes, by measuring all, and the distance of the last."""
    some = queries.select("q", "qcode").orderBy(F.xxhash64("q"), "q").limit(SAMPLE).collect()
    asked = [(r[0], np.frombuffer(bytes(r[1]), np.float32).astype(np.float64)) for r in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x = np.asarray(b.column("node")), codes(b.column("code"))
                for q, v in asked:
                    d = np.square(x - v).sum(1)
                    d[ids == q] = np.inf
                    near = np.argpartition(d, min(top, len(d)) - 1)[:top]
                    near = near[d[near] < np.inf]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(ids[near]), pa.array(d[near])], names=["q", "node", "d"])

    r = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
    return nodes.mapInArrow(run, "q long, node long, d double").withColumn("r", r).where(F.col("r") <= top).groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("far"))


def search_all(queries: DataFrame, nodes: DataFrame, graph: DataFrame, kept: Kept, top: int, beam: int = BEAM) -> DataFrame:
    """q, node of the nearest nodes found; the beam is doubled until ``FOUND`` of the sample's nearest are there, or doubling it finds no more."""
    way, _ = kept.write(ways(graph))
    truth, _ = kept.write(reach(queries, nodes, top))
    held, path, last = own(queries, nodes), None, -1.0
    while True:
        held, new_path = search(queries, nodes, way, held, kept, beam)
        if path:
            kept.drop(path)
        path = new_path
        got = held.where("node <> q").join(F.broadcast(truth), "q").where(F.col("d") <= F.col("far") * (1 + 1e-12)).groupBy("q").agg(F.least(F.count("*"), F.first("n")).alias("hits"))
        hits, total = got.agg(F.sum("hits")).first()[0] or 0, truth.agg(F.sum("n")).first()[0] or 0
        if hits >= FOUND * total or hits <= last:
            return held.select("q", "node")
        if last < 0:
            held = held.unionByName(hubs(queries, nodes, way).join(held, ["q", "node"], "left_anti"))
        beam, last = 2 * beam, hits


def nearest(rows: DataFrame, wanted, top: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id fulfils ``wanted(column)``, against all other rows."""
    spark = rows.sparkSession
    ship(spark)
    kept = Kept(spark, "neighbours")
    all_rows, _ = kept.write(usable(rows, id_col, vec_col))
    dim, n = all_rows.agg(F.max(F.size("v")), F.count("*")).first()
    dim = int(dim or 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), pa.array([r.tobytes() for r in q], pa.binary())], names=["node", "v", "code"])

    # equal vectors: one node, of whose rows the first top + 1 can matter
    nodes, _ = kept.write(all_rows.groupBy("v").agg(F.min("vec_id").alias("node")).select("node", "v").mapInArrow(pack, "node long, v array<float>, code binary"))
    member = all_rows.join(nodes.select("node", "v"), "v").select("node", "vec_id")
    member, _ = kept.write(member)
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1).drop("r")
    graph = build(nodes.select("node", "code"), n, dim, kept)
    ask = member.where(wanted(F.col("vec_id"))).select(F.col("vec_id").alias("q"), F.col("node").alias("start"))
    # queries with one vector walk the same way: the walk is done once a node
    walk = ask.select("start").distinct().join(nodes.select(F.col("node").alias("start"), F.col("code").alias("qcode"), F.col("v").alias("qv")), "start").withColumn("q", F.col("start"))
    walk, _ = kept.write(walk)
    met = search_all(walk, nodes.select("node", "code"), graph, kept, top)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), np.float64) - matrix(b.column("qv"), np.float64)
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(np.sqrt((x * x).sum(1)))], names=["start", "node", "score"])

    scored = met.join(nodes.select("node", "v"), "node").join(walk.select("q", "qv"), "q").mapInArrow(measure, "start long, node long, score double")
    close = scored.withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy("score", "node"))).where(F.col("r") <= top + 1).drop("r").join(first, "node")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    got = ask.join(close, "start").where("vec_id <> q").select(F.col("q").alias("query_id"), "vec_id", "score")
    return got.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
