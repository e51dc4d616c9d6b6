import re

import numpy as np
import xxhash

from panelspark.llm import components, simhash
from tests.llm.common import DOCS, ODD, clashing


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return {i: min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = np.array([brute_fingerprint(r[1]) for r in rows], np.uint64)
    want = brute_components([r[0] for r in rows], prints, 4)
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r[0]: (f"{int(prints[i]):016x}", want[i]) for i, r in enumerate(rows)}


def test_links_of_a_dense_group_and_a_chain(spark):
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(c) for c in centre}
    for c in centre[:3]:  # hundreds of near copies of one text
        for _ in range(150):
            prints.add(int(c) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 5), replace=False)))
    x = int(centre[5])
    for step in range(20):  # each within 4 bits of the one before
        x ^= sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
        prints.add(x)
    fps = sorted(prints)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = brute_components(signed, np.array(fps, np.uint64), 4)
    for distance in (4,):
        label, _ = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance)
        root = {r[0]: r[1] for r in label.collect()}
        groups, mine = {}, {}
        for i, v in enumerate(signed):
            groups.setdefault(want[i], set()).add(v)
            mine.setdefault(root.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_odd_rows(spark):
    got = [tuple(r) for r in simhash.near_duplicates(clashing(spark, ODD)).collect()]
    assert len(got) == len(ODD)
    by = {}
    for i, f, c in got:
        by.setdefault(i, set()).add((f, c))
    assert by[0] == by[1] == by[2] == {("0" * 16, 0)} and by[7] == by[8] and {c for _, c in by[7]} == {7} and {c for _, c in by[None]} == {None}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_one_of_each(spark):
    draw = np.random.default_rng(1)
    word = lambda: "".join(draw.choice(list("abcdefghij"), 6))
    long = [word() for _ in range(400)]
    near = [*long[:200], "changed", *long[201:]]
    clean = [" ".join(word() for _ in range(n)) for n in (3, 30, 300)]
    rows = [(9, " ".join(long), "en", "s", 1), (4, " ".join(near), "en", "t", 2), (6, " ".join(long), "fr", "u", 3)] + [(20 + i, t, "en", "s", 1) for i, t in enumerate(clean)] + [(20, clean[0], "en", "s", 1), (None, clean[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r[0] is None, r[0]) for r in got.collect()) == [(False, 4), (False, 20), (False, 21), (False, 22), (True, None)]
    assert simhash.one_of_each(spark.createDataFrame([], DOCS)).collect() == []


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_one_of_each_meets_all_from_the_bound_on_and_none_below(spark):
    draw = np.random.default_rng(8)
    rows, stays = [], set()
    for i in range(180):
        base = [f"w{x}" for x in draw.integers(0, 1 << 40, 300)]
        n = (3, 5, 6, 8, 9)[i % 5]
        other = list(base)
        for k in range(n):
            other[15 + 30 * k] = f"v{i}-{k}"
        s = jaccard(" ".join(base), " ".join(other))
        assert (s >= 0.8) == (n < 8)
        rows += [(2 * i, " ".join(base), "en", "s", 1), (2 * i + 1, " ".join(other), "en", "s", 1)]
        stays |= {2 * i} if s >= 0.8 else {2 * i, 2 * i + 1}
    assert {r[0] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()} == stays


def test_one_of_each_keeps_rows_of_one_id_that_are_no_copies(spark):
    draw = np.random.default_rng(9)
    text = [" ".join(f"w{x}" for x in draw.integers(0, 1 << 40, 200)) for _ in range(80)]
    near = [t.rsplit(" ", 2)[0] + " changed end" for t in text[:2]]
    # 1: the only low id of two groups; 5: many rows, one of them twice; 9: null and empty text
    rows = [(1, text[0]), (2, near[0]), (1, text[1]), (3, near[1])] + [(5, t) for t in text[10:]] + [(5, text[10]), (9, None), (9, "")]
    got = simhash.one_of_each(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()
    assert sorted((r[0], r[1] or "") for r in got) == sorted([(1, text[0]), (1, text[1]), *((5, t) for t in text[10:]), (9, "")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (100, 101)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(200)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_fingerprints_are_compared_by_their_sets(spark):
    texts = {"a": (0, range(100)), "b": (15, range(5, 105)), "c": (255, range(300, 400)), "d": (-1, range(100)), "e": (15, range(310, 400))}
    own = spark.createDataFrame([(n, len(h), fp, [i]) for i, (n, (fp, h)) in enumerate(texts.items())], "node string, n int, fp long, bands array<long>")
    sets = spark.createDataFrame([(n, list(h)) for n, (_, h) in texts.items()], "node string, h array<long>")
    groups = simhash.fingerprint_groups(own.select("node", "n", "fp"), 4)
    keys = {r["node"]: r["key"] for r in groups.collect()}
    assert keys["a"] == keys["b"] == keys["c"] == keys["e"] != keys["d"]
    kept = simhash.Kept(spark, "test")
    assert simhash.alike_components(own, sets, 0.8, kept).collect() == []
    assert {tuple(r) for r in simhash.alike_components(own, sets, 0.8, kept, groups).select("node", "root").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("e", "c")}


def test_only_texts_that_meet_another_have_their_sets_written(spark, monkeypatch):
    word = [f"w{i}" for i in range(400)]
    rows = [(1, word[:100]), (2, word[1:100]), (3, word[1:100]), *((i, word[i * 20 : i * 20 + 20]) for i in range(6, 16))]
    held = []
    real = simhash.Kept.write
    monkeypatch.setattr(simhash.Kept, "write", lambda self, df: (lambda out: held.append(out[0].count()) or out if "h" in df.columns else out)(real(self, df)))
    got = simhash.one_of_each(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], DOCS)).collect()
    assert {r[0] for r in got} == {1, *range(6, 16)}
    assert held == [2]
