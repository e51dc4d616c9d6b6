import collections
import hashlib
import random

from panelspark.llm import suffix_dedup
from tests.llm.common import ODD, clashing


def brute(rows):
    """Counts every window of 200 bytes."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(r[p : p + 200] for _, r in raws for p in range(len(r) - 199))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), sum(gone), sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = sorted((tuple(r) for r in suffix_dedup.report(clashing(spark, [(i, t, "s") for i, t in rows])).collect()), key=str)
    assert got == brute(rows)
    return got


def test_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sum(r[2] for r in check(spark, rows)) > 0


def test_passages_of_many_lengths_periods_and_copies(spark):
    random.seed(5)
    base = ["".join(random.choice("abcdefgh ") for _ in range(600)) for _ in range(6)]
    rows = []
    for i in range(60):
        s, a = random.choice(base), random.randint(0, 300)
        own = "".join(random.choice("abc é") for _ in range(random.randint(0, 300)))
        rows.append((i, own + s[a : a + random.randint(150, 300)] + own[: random.randint(0, 50)] + random.choice(base)[: random.randint(100, 400)]))
    hot = "the same line of text in a great many documents, longer than one anchor is, " * 2
    rows += [(200 + i, "".join(random.choice("xyz ") for _ in range(150)) + hot + "".join(random.choice("uvw ") for _ in range(150))) for i in range(80)]
    rows += [(100, "a" * 1500), (101, "ab" * 700), (102, None), (103, ""), (104, rows[0][1]), (104, rows[0][1]), (None, "x" * 400), (105, "q" * 199), (106, "r" * 200), (107, "r" * 200), (108, "s" * 200)]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(i, t) for i, t, _ in ODD if t is None or len(t) < 3000])
    assert suffix_dedup.report(clashing(spark, [])).collect() == []


def test_blind_trie_orders_and_groups():
    random.seed(1)
    for _ in range(200):
        s = ["".join(random.choice("ab") for _ in range(8)).encode() for _ in range(random.randint(1, 30))]
        got = suffix_dedup.blind_trie(s)
        assert [s[g[0]] for g in got] == sorted(set(s)) and all(len({s[i] for i in g}) == 1 for g in got) and sorted(i for g in got for i in g) == list(range(len(s)))
