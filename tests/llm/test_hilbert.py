import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import hilbert
from tests.llm.common import DOCS, ODD, clashing


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, levels in ((2, 3), (3, 3)):
        grid = spark.range(1 << n * levels)
        cell = [F.shiftright("id", levels * k).bitwiseAND(F.lit((1 << levels) - 1)).cast("int") for k in range(n)]
        rows = sorted((r[0], tuple(r[1:])) for r in grid.select(hilbert.curve_index(cell, levels), *cell).collect())
        assert [r[0] for r in rows] == list(range(1 << n * levels))
        assert all(sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_rows_and_places(spark):
    rows = [(i % 90 if i < 270 else None, "w " * (i * i % 37), "en" if i % 3 else None, f"s{i % 5}", i) for i in range(300)] + [(7, "same", "de", "s1", 0)] * 500
    docs = spark.createDataFrame(rows, DOCS)
    got = hilbert.report(docs, shards=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    want = sorted((str(i), len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    again = hilbert.report(docs.repartition(5), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # the order of the curve goes on from shard to shard
    curve = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)


def test_bytes(spark):
    rows = [(i, "x" * (i * 7 % 101), "en", f"s{i % 9}", 0) for i in range(2000)]
    got = hilbert.report(spark.createDataFrame(rows, DOCS), shards=10, law="bytes").groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    total = sum(r["s"] for r in got)
    assert len(got) == 10 and all(abs(r["s"] - total / 10) <= 109 and r["m"] == r["n"] - 1 for r in got)
    with pytest.raises(ValueError):
        hilbert.places(spark.createDataFrame(rows[:3], DOCS), law="key")


def test_odd_rows(spark):
    docs = clashing(spark, ODD).withColumn("lang", F.lit("en"))
    assert hilbert.report(docs).count() == len(ODD)
    out = hilbert.rows(docs.withColumn("shard", F.lit("old")), shards=3)
    assert out.count() == len(ODD) and {r[0] for r in out.select("shard").collect()} == {0, 1, 2}
    assert set(docs.columns) <= set(out.columns)
    assert hilbert.report(docs.limit(0)).collect() == []


def test_files_are_left_out(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    limits = hilbert.write(docs, str(tmp_path / "out"), shards=16)
    assert limits.agg(F.sum("rows")).first()[0] == docs.count()
    lang, source = docs.groupBy("lang", "source").count().orderBy(F.desc("count"), "lang", "source").first()[:2]
    need = {r[0] for r in hilbert.needed(limits, lang=lang, source=source).collect()}
    back = spark.read.parquet(str(tmp_path / "out" / "rows"))
    hold = {r[0] for r in back.where((F.col("lang") == lang) & (F.col("source") == source)).select("shard").distinct().collect()}
    assert hold <= need and len(need) <= 10
    every = {r[0] for r in hilbert.needed(limits).collect()}
    assert len(every) == 16


def test_no_python_in_the_plan(spark, sf):
    assert "Python" not in hilbert.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
