import random
import re
from collections import Counter

from panelspark.llm import collocations
from tests.llm.common import DOCS, ODD, clashing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, share=50, first=2000):
    """Counts of every phrase by listing them, then the definition word by word."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(x[0] == lang and len(x[1]) > len(p) and 100 * b >= share * a and any(x[1][i : i + len(p)] == p for i in range(2)) for x, b in cand.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, x in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(x)[:first], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


def found(docs, **kw):
    return sorted(tuple(r)[:8] for r in collocations.best(docs, **kw).collect())


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["The", "of", "new", "york", "city", "É", "x-y", "a", "a", "b c"]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(("", "", "", ",", ".", "\n", "\t")) for _ in range(rnd.randrange(30))), rnd.choice(("en", "de", None)), "s", 0) for i in range(300)]
    rows += [(900 + i, "one long passage that is copied whole again and again; new york city hall", "en", "s", 0) for i in range(25)]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute(rows)
    assert len(want) > 60 and found(docs) == want
    assert found(docs, most=7) == brute(rows, first=7)
    assert found(docs.repartition(6), least=3, share=80) == brute(rows, 3, 80)


def test_paths(spark):
    rows = [(i, "p q r s t u v", "en", "s", 0) for i in range(12)] + [(50 + i, "z t u y", "en", "s", 0) for i in range(11)] + [(99, "a a a a a a a a a a a a a a", "en", "s", 0)]
    got = {(r["first"], r["last"]): (r["n"], r["words"]) for r in collocations.paths(spark.createDataFrame(rows, DOCS)).collect()}
    # t u is entered and left by two edges each, so every path ends there
    assert got == {("p q", "t u"): (12, 6), ("t u", "u v"): (12, 3), ("z t", "t u"): (11, 3), ("t u", "u y"): (11, 3), ("a a", "a a"): (12, 3)}


def test_products_beyond_64_bits(spark):
    d = spark.createDataFrame([(10**12, 10**12, 10**12 + 1), (3 * 10**11, 9 * 10**11, 10**12)], "a long, l long, r long")
    got = [r[0] for r in d.select(collocations.score("a", "l", "r")).collect()]
    assert got == [10**6 * 10**24 // (10**12 * (10**12 + 1)), 10**6 * 9 * 10**22 // (9 * 10**23)]


def test_odd_rows(spark):
    docs = clashing(spark, ODD * 6).selectExpr("*", "cast(null as string) as lang")
    rows = [(i, t, None, s) for i, t, s in ODD * 6]
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == []
