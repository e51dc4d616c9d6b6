import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import nn_descent
from panelspark.llm.common import Kept

SCHEMA = "vec_id long, embedding array<float>, node long, v string, d float"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 0.5) for i, v in rows], SCHEMA)


def brute(rows, wanted, top=10):
    """Every usable row against all."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if wanted(q):
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:top]
            out[q] = [(i, d) for d, i in near]
    return out


def collect(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r[0], []).append((r[2], r[3]))
    return got


def test_recall_on_the_table(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = collect(nn_descent.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), lambda i: i % 100 == 0))
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_copies_ties_and_unusable_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(30)]
    rows += [(100 + i, [1, 1, 1, 1]) for i in range(40)]  # one vector, many rows
    rows += [(200, None), (300, [0, 0, 0, 0]), (400, [1, None, 2, 3]), (500, [1, float("nan"), 0, 0]), (600, [float("inf"), 0, 0, 0]), (700, [1, 2]), (None, [1, 1, 1, 2]), (0, rows[0][1])]
    got = collect(nn_descent.nearest(table(spark, rows), lambda i: i % 100 == 0))
    assert set(got) == {0, 100}
    assert [i for i, _ in got[100]] == list(range(101, 111)) and all(d == 0 for _, d in got[100])
    want = brute(rows[:70], lambda i: i == 0)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and np.allclose([d for _, d in got[0]], [d for _, d in want[0]], rtol=1e-12)


def recall(spark, rows, wanted):
    got, want = collect(nn_descent.nearest(table(spark, rows), wanted)), brute(rows, wanted)
    assert got.keys() == want.keys()
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_beside_an_outlier_row_and_within_a_tight_group(spark):
    draw = np.random.default_rng(4)
    unit = draw.normal(size=(1500, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    unit[1] *= 10_000
    unit[1000:] = unit[0] + draw.normal(size=(500, 16)) * 0.0005
    rows = list(enumerate(unit.tolist()))
    assert recall(spark, rows, lambda i: (i % 20 == 0) & (i < 1000)) >= 0.9
    assert recall(spark, rows, lambda i: (i % 20 == 0) & (i >= 1000)) >= 0.9


def test_rounds_go_on_until_settled(spark, monkeypatch):
    turns = []

    def descend(graph, nodes, k, turn):
        turns.append(turn)
        return graph.withColumn("fresh", F.lit(int(turn < 6)))

    monkeypatch.setattr(nn_descent, "descend", descend)
    nodes = spark.createDataFrame([(i, np.array([i, 1], np.float32).tobytes()) for i in range(5)], "node long, code binary")
    nn_descent.build(nodes, 5, 2, Kept(spark, "rounds"))
    assert turns == list(range(7))


def test_few_rows(spark):
    got = collect(nn_descent.nearest(table(spark, [(0, [1, 2]), (1, [2, 3]), (2, [5, 5])]), lambda i: i % 100 == 0))
    assert [i for i, _ in got[0]] == [1, 2]
    assert collect(nn_descent.nearest(table(spark, [(0, [1, 2])]), lambda i: i % 100 == 0)) == {}
    assert collect(nn_descent.nearest(table(spark, []), lambda i: i % 100 == 0)) == {}


def test_searches_widen_and_begin_at_hubs(spark, monkeypatch):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(1500, 48)) * np.exp(draw.normal(size=(1500, 1)) * 2)
    seen = []
    real = nn_descent.search
    monkeypatch.setattr(nn_descent, "NEIGHBOURS", 6)
    monkeypatch.setattr(nn_descent, "search", lambda *a: seen.append(a[-1]) or real(*a))
    monkeypatch.setattr(nn_descent.search_all, "__defaults__", (12,))
    monkeypatch.setattr(nn_descent.build, "__defaults__", (6, 0.01))
    assert recall(spark, list(enumerate(x.tolist())), lambda i: i % 50 == 0) >= 0.95
    assert seen == [12 * 2**i for i in range(len(seen))] and len(seen) > 1


def test_graph_of_vectors_without_structure(spark):
    """Trees laid until few edges are new give the descent a graph that one narrow search suffices for."""
    x = np.random.default_rng(12).normal(size=(6000, 64)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node long, code binary")
    got = {}
    for r in nn_descent.build(nodes, len(x), 64, Kept(spark, "graph")).where("node % 100 = 0").collect():
        got.setdefault(r["node"], set()).add(r["nbr"])
    near = {q: np.square(x - x[q]).sum(1).argsort()[1:11].tolist() for q in range(0, len(x), 100)}
    assert sum(len(got[q] & set(n)) for q, n in near.items()) >= 0.9 * 10 * len(near)


def test_closest_beside_a_far_row_and_among_rows_almost_equal():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 8))
    x[100:200] = x[0] + draw.normal(size=(100, 8)) * 1e-9
    x[1] *= 1e9
    near, d = nn_descent.closest(x, 5)
    want = nn_descent.squares(x)
    np.fill_diagonal(want, np.inf)
    assert np.allclose(np.sort(d, 1), np.sort(want, 1)[:, :5], rtol=1e-9) and (near != np.arange(300)[:, None]).all()
