import zlib

import numpy as np
import pyarrow as pa

from panelspark.llm import nbsvm
from panelspark.llm.queries import QUERIES
from tests.llm.common import ODD, clashing


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_classifier"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    marked = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in marked if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) >= 0.9
    assert np.mean([p for p, q in held if q == 1]) >= 0.97


def test_same_text_same_score_and_labels_do_not_enter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = nbsvm.learn(docs, labels)
    got = [tuple(r) for r in nbsvm.score(clashing(spark, ODD), m).collect()]
    by = {}
    for i, s, _ in got:
        by.setdefault(i, set()).add(s)
    assert len(got) == len(ODD) and by[0] == by[1] and len(by[5]) == 1 and by[7] == by[8] and all(0 <= s <= 1 for v in by.values() for s in v)
    kept = nbsvm.keep_good(clashing(spark, ODD), m)
    assert kept.columns == clashing(spark, []).columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(i) for i, s, p in got if p)


def test_no_labels_one_class_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = "doc_id long, quality int, toxic int"
    none = nbsvm.learn(docs, spark.createDataFrame([], schema))
    assert {r[1] for r in nbsvm.score(docs, none).collect()} == {0.5}
    ones = nbsvm.learn(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, None, 0), (4, 7, 0), (None, 1, 0)], schema))
    assert all(r[1] > 0.9 for r in nbsvm.score(docs, ones).collect())
    assert nbsvm.score(docs.limit(0), ones).collect() == []


def test_packed_rows_and_the_bound_of_the_fit(spark, sf):
    draw = np.random.default_rng(6)
    rows = [np.unique(draw.integers(0, nbsvm.SLOTS, n)).astype(np.uint32) for n in (0, 1, 30, 3000, 100_000)] + [np.array([0, 1, 255, 510, nbsvm.SLOTS - 1], np.uint32)]
    packed = nbsvm.Packed([pa.scalar(nbsvm.pack(g), pa.binary()) for g in rows])
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(packed, rows, strict=True))
    assert np.array_equal(packed[np.array([4, 2])][1], rows[2])
    docs = spark.range(12_000).selectExpr("id doc_id", "concat('text ', id % 2) text")
    # the fit runs in a task, so its rows are counted where they come from
    assert nbsvm.sample(docs, docs.selectExpr("doc_id", "int(doc_id % 2) quality")).count() == 8000


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2 + i % 3], np.uint32) if i % 2 else np.array([1, 2 + i % 3], np.uint32) for i in range(200)]
    label = np.array([i % 2 for i in range(200)])
    m = nbsvm.fit(rows, label)
    assert all((m.score(g) > 0.5) == bool(y) for g, y in zip(rows, label, strict=True))
