import hashlib
import random
import zlib

from pyspark.sql import types as T

from panelspark.llm import prefix_trie

TALKS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The nodes as the definition states them, with every subtree listed."""
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(x)] for c, x in talks.items()}
    new = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    member, ends = {}, {}
    for c, x in new.items():
        for d in range(len(x) + 1):
            member.setdefault(tuple(x[:d]), []).append(c)
        ends.setdefault(tuple(x), []).append(c)
    child = {}
    for k in member:
        if k:
            child.setdefault(k[:-1], []).append(k)
    out = []
    for k, who in member.items():
        below = [s for s in member if s[: len(k)] == k]
        leaves = sum(s not in child for s in below)
        saved = sum((len(member[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ids = ",".join(map(str, sorted(ends.get(k, []))))
        out.append((min(who), len(k), min(member[k[:-1]]) if k else None, len(who), len(child.get(k, [])), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, TALKS))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for c in range(120):
        for t in range(rnd.choice((1, 2, 3, 5, 9, 12))):
            rows.append((c, t, rnd.choice(("user", "assistant")), rnd.choice(("a", "bb", "é", "long text"))))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, None, "y"), (1, 5, "user", ""), (2, -3, "a", "b"), (2, -5000, "a", "c"), (3, 10**12, "a", "z" * 100_000), (7, 1, "q", "q"), (9, 1, "q", "q"), (None, 1, "lost", "lost"), (1000, 2, "user", "x"), (1002, 2, "user", "x")]
    check(spark, rows)
    check(spark, [(None, 1, "a", "b")])
    check(spark, [])


def test_clashing_columns(spark):
    names = ("k1", "k2", "depth", "pos", "said", "n", "m", "w", "blk", "h", "first", "saved")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())] + [T.StructField(x, T.StringType()) for x in names])
    rows = [(c, t, "user", f"{t}{c % 2}") for c in range(12) for t in range(3)]
    got = prefix_trie.trie(spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    """A conversation of many blocks and a list of ends of many pieces."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    rows = [(c, 0, "user", "hello") for c in range(0, 400, 3)] + [(5001, t, "user", str(t)) for t in range(60)] + [(5002, t, "user", str(t)) for t in range(70)]
    check(spark, rows)
