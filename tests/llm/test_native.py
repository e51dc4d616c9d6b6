"""Line dedup, URL filter and mixing: whole tables against SQL, odd rows against plain Python."""


import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import line_spread, mixing, url_bloom
from panelspark.llm.queries import ORACLES, QUERIES
from tests.llm.common import DOCS, ODD, clashing


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, size):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{size}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    got = QUERIES[name](spark, f"/root/testdata/{size}")
    assert sorted(got.columns) == names
    near = lambda rows: sorted([tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows], key=str)
    assert near(tuple(r) for r in got.select(*names).collect()) == near(want)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_url_filters", "op8_mixing"])
def test_no_python_in_the_plan(spark, sf, name):
    assert "Python" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_lines(spark):
    rows = [(i, f"own {i}\nspread\nnarrow{i % 3}\n\nown {i}", f"s{i % 12}") for i in range(24)] + [(90, None, "s1"), (91, "", None), (92, "spread", "s1"), (93, "spread\nspread", None), (94, "spread\nx", "s1"), (94, "spread\nx", "s1")]
    docs = clashing(spark, rows)
    got = line_spread.drop_boilerplate(docs, 10)
    assert got.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got.count() == len(rows) and by[0] == "own 0\nnarrow0\n\nown 0" and by[90] is None and by[91] == "" and by[92] == "" and by[93] == "" and by[94] == "x"
    for n in (4, 5):  # narrow0 has 4 sites
        assert {r["doc_id"]: r["text"] for r in line_spread.drop_boilerplate(docs, n).collect()}[0] == ("own 0\n\nown 0" if n == 4 else "own 0\nnarrow0\n\nown 0")
    assert line_spread.drop_boilerplate(clashing(spark, [])).collect() == []
    assert line_spread.report(clashing(spark, ODD)).count() == len(ODD)


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, "\n".join(f"line {k}" for k in range(80, 121) if i < k), f"site {i}") for i in range(121)]
    bad = line_spread.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 100, margin=0.3)
    want = {r[0] for r in spark.createDataFrame([(f"line {k}",) for k in range(100, 121)], "x string").select(F.xxhash64("x")).collect()}
    assert {r[0] for r in bad.collect()} == want


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/a?x", "http://example.com/en/", "https://a.b.example.com/en/x#y", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/#", "http://y.org", "http://y.org/", "http://Y.org//?a=://b", "http://com/", "http://com", "http://exÄmple.org/q", "a://b://c/d", "http://list.org/a/?z=1", "http://www.list.org/a", "http://list.org/b", "http://list.org/b"]
    pages = spark.createDataFrame([(i, u, "k", "w") for i, u in enumerate(urls)], "page_id long, url string, _key string, verdict string")
    listed = spark.createDataFrame([("https://LIST.org/a",), ("https://list.org/a/",), (None,), ("bad",), ("http://list.com/c",)], "url string")
    got = {r["page_id"]: r for r in url_bloom.judge(pages, listed).collect()}
    want = {4: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 5: ("example.com", "/en/", "example.com/en/", "block"), 6: ("a.b.example.com", "/en/x", "example.com/en/", "block"), 7: ("x.net", "/es/1", "net/es/", "block"), 8: ("x.net", "/es", None, "allow"), 9: ("x.net", "/fr/", "net/fr/", "block"), 10: ("y.org", "", None, "allow"), 12: ("y.org", "//", None, "allow"), 13: ("com", "/", "com/", "allow"), 14: ("com", "", None, "allow"), 15: ("exÄmple.org", "/q", None, "allow"), 16: ("b:", "//c/d", None, "allow"), 17: ("list.org", "/a/", None, "block"), 18: ("www.list.org", "/a", None, "block"), 19: ("list.org", "/b", None, "allow")}
    assert len(got) == len(urls)
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == w
    assert all(tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == ("", "", None, "allow") for i in range(4))
    assert {r["verdict"] for r in url_bloom.judge(pages.where("page_id in (17, 18)"), listed.limit(0)).collect()} == {"allow"}
    assert url_bloom.judge(pages.limit(0), listed).collect() == []


def test_blocked_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("host"), "id").alias("_key"))
    n = 5000 // 16 + 1
    bits = url_bloom.build(keys, n)

    def passing(probe):
        may = F.lit(True)
        for w, m in enumerate(url_bloom.masks(F.col("_key"))):
            may = may & (F.col(f"_w{w}").bitwiseAND(m) == m)
        return probe.withColumn("_block", url_bloom.block(F.col("_key"), n)).join(bits, "_block").where(may).count()

    assert passing(keys) == 5000
    assert passing(spark.range(5000).select(F.concat(F.lit("other"), "id").alias("_key"))) < 100


def brute_targets(sizes, share=1.5, most=2):
    """Shares of the whole by weight; what is over a limit goes to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return full
        goal = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if goal[s] > most * sizes[s]]
        if not over:
            return full | goal
        for s in over:
            full[s] = float(most * sizes[s])
            left -= full[s]


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 50), "abcde"[min(4, i % 11)]) for i in range(600)] + [(700, None, "a"), (701, "", None), (702, "x y", None), (703, "solo " * 9, "tiny"), (704, "t", "one"), (800, "w " * 6, "a"), (800, "w " * 6, "a"), (None, "n n n", "b")]
    docs = clashing(spark, rows)
    got = mixing.mixed(docs, block_words=16).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = brute_targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(7), block_words=16).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_schedule_spreads_each_source(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2], "s", 1) for i in range(400)], "doc_id long, text string, source string, x string, i long")
    piece, _ = mixing.schedule(docs, 32)
    places = sorted(r[0] for r in piece.where("source = 'a'").select("i").distinct().collect())
    total = piece.select("i").distinct().count()
    share = len(places) / total
    assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= 3 / share
    assert piece.agg(F.sum(F.col("_y") - F.col("_x"))).first()[0] == int(1.5 * 400 * 40)


def test_mixed_documents(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2], 20) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.sample(docs)
    assert got.columns == docs.columns
    n = got.groupBy("source").count().collect()
    assert {r[0]: r[1] for r in n} == {"a": 100, "b": 50}  # weights 3 and 1: 112.5 and 37.5, a full at twice its 50
    assert mixing.sample(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
