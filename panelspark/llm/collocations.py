"""Collocations from a weighted de Bruijn graph of words.

Every word of a piece starts a gram of three words, of two if it is the last but one and of one if it is the last.  Counted, the full grams are the edges of
a graph whose nodes are pairs of words: an edge leads from its first pair to its last.  All shorter counts follow from these: a pair occurs as often as edges
leave it and pieces end with it, a word as often as pairs start with it and pieces end with it.

A pair inside a unary path (one edge comes in, one goes out, each carries all of its occurrences) always stands in the same longer phrase.  Such paths are
compacted by pointer doubling: an edge of a path finds its first edge in as many rounds as the length has bits.  A path has one weight, which is the count of
each of its inner pairs; they are no collocations of their own.

Grams are summed in each task before the one shuffle, so a word, line or passage that a third of all texts hold is a row for every half million distinct grams,
and travel as lists of what follows a pair.  Only grams of the least frequency stay for the graph.  Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` and at blanks and tabs; A-Z are lower-cased.  A null text is empty, a
null language is ``und``; doc_id is not read; repeated rows count as often as they stand there; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Kept, ship

LEAST, FIRST, SHARE, SCALE = 10, 2000, 50, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All of these are single bytes in UTF-8: cuts become line feeds, tabs blanks.
TABLE = bytes.maketrans(f"{UPPER}\t.,;:!?\x0b\x0c\r".encode(), f"{LOWER} {9 * chr(10)}".encode())
#: Bytes of a piece that are split at a time, distinct grams and words that a task holds, texts that it takes from a batch at a time.
PIECE, HELD, WORDS, TEXTS = 1 << 20, 500_000, 200_000, 500
#: Parts of a language that are ranked on their own before they meet.
PARTS = 64


def word_runs(text: str) -> Iterator[tuple[list[bytes], bool]]:
    """The words of each piece; a piece beyond ``PIECE`` bytes comes in parts, of which all but the last are to be taken up to their last two words, which begin the next part."""
    for piece in text.encode("utf-8", "replace").translate(TABLE).split(b"\n"):
        at, held = 0, []
        while len(piece) - at > PIECE and (cut := piece.find(b" ", at + PIECE)) > 0:
            words = held + piece[at:cut].split()
            yield words, False
            at, held = cut, words[-2:]
        yield (held + piece[at:].split() if at else piece.split()), True


def before_and_after(of: pa.Array, reverse: bool = False) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first blank, or the last one; of a string without a blank the first part is the string."""
    parts = pc.split_pattern(of, b" ", max_splits=1, reverse=reverse)
    at, values = parts.offsets.to_numpy(), parts.values
    return values.take(pa.array(at[:-1])), values.take(pa.array(np.minimum(at[:-1] + 1, at[1:] - 1)))


def runs_of(of: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Equal neighbours as one: the strings, the sums of ``n`` and where each begins."""
    at = np.flatnonzero(np.append(True, pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)))
    return of.take(pa.array(at)), np.add.reduceat(n, at), at


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, head, tails, n: the grams of a task, summed over up to ``HELD`` distinct ones.

    A pair comes with the flow out of it (n) and all words that follow it, and how often if more than once (``york city<tab>3``); an empty word is the end of a
    piece.  A word comes with the flow out of it and no tails, and so does a language (head empty).
    """
    seen: dict[str, Counter] = {}
    flow: dict[str, Counter] = {}

    def batches_of(lang: str, head: pa.Array, tails: pa.Array, n: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(head), size):
            cols = [x.slice(at, size) for x in (head, tails, n)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cols[0])), *(x.cast(pa.large_string()).cast(pa.string()) for x in cols[:2]), cols[2]], names=["lang", "head", "tails", "n"])

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in seen.items():
            if not c:
                continue
            gram, n = pa.array(list(c), pa.large_binary()), np.fromiter(c.values(), np.int64, len(c))
            c.clear()
            order = pc.sort_indices(gram)  # what follows a pair comes together, and so does what follows a word
            gram, n = gram.take(order), n[order.to_numpy()]
            head, tail = before_and_after(gram, reverse=True)
            many = pc.binary_join_element_wise(tail, pa.array(n).cast(pa.large_string()).cast(pa.large_binary()), pa.scalar(b"\t", pa.large_binary()))
            token = pc.if_else(pc.and_(pa.array(n == 1), pc.not_equal(tail, b"")), tail, many)
            head, n, at = runs_of(head, n)
            tails = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(at, len(order))), token), pa.scalar(b" ", pa.large_binary()))
            pair = pc.match_substring(head, b" ")
            first, sums, _ = runs_of(pc.if_else(pair, before_and_after(head)[0], head), n)
            words = flow.setdefault(lang, Counter())
            for w, k in zip(first.to_pylist(), sums.tolist(), strict=True):
                words[w] += k
            yield from batches_of(lang, head.filter(pair), tails.filter(pair), pa.array(n).filter(pair), 1 << 15)
        seen.clear()

    def flows() -> Iterator[pa.RecordBatch]:
        for lang, words in flow.items():
            head = pa.array([b"", *words], pa.large_binary())
            yield from batches_of(lang, head, pa.nulls(len(head), pa.large_binary()), pa.array([sum(words.values()), *words.values()], pa.int64()), 1 << 16)
        flow.clear()

    for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            c = seen.setdefault(lang, Counter())
            for w, end in word_runs(text):
                c.update(map(b" ".join, zip(w, w[1:], w[2:], strict=False)))
                if end and w:
                    if len(w) > 1:
                        c[w[-2] + b" " + w[-1] + b" "] += 1
                    c[w[-1] + b" "] += 1
                if len(c) > HELD:
                    yield from out()
                    c = seen.setdefault(lang, Counter())
        if sum(map(len, seen.values())) > HELD:
            yield from out()
        if sum(map(len, flow.values())) > WORDS:
            yield from flows()
    yield from out()
    yield from flows()


def counts(docs: DataFrame, kept: Kept, least: int = LEAST) -> DataFrame:
    """lang, head, n, edges: pairs, words (no blank in ``head``) and languages (empty ``head``) with their counts, pairs and words of the least frequency only.

    ``edges`` of a pair: the words (and counts) of the edges of the least frequency out of it; n is the flow out of it, rarer edges and piece ends included.
    Grams are laid out by their head, so edges and nodes are counted after one shuffle; what follows a rare pair, and most pairs are, is never unfolded.
    """
    ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = own.mapInArrow(count_grams, "lang string, head string, tails string, n long").repartition("lang", "head")
    by = Window.partitionBy(F.xxhash64("head", "lang"), "head", "lang")  # the number in front is what the sort mostly compares
    row = row.withColumn("all", F.sum("n").over(by)).where((F.col("all") >= least) | (F.col("head") == ""))
    each = row.select("lang", "head", "n", F.explode_outer(F.split("tails", " ")).alias("t"))
    part = F.split("t", "\t")
    n = F.when(F.col("t").isNull(), F.col("n")).otherwise(F.coalesce(F.get(part, F.lit(1)).cast("long"), F.lit(1).cast("long")))
    each = each.select("lang", "head", F.get(part, F.lit(0)).alias("tail"), n.alias("n"))
    edge = each.groupBy("lang", "head", "tail").agg(F.sum("n").alias("n"))
    often = F.when((F.col("n") >= least) & (F.col("tail") != ""), F.struct("tail", "n"))
    node = edge.groupBy("lang", "head").agg(F.sum("n").alias("n"), F.collect_list(often).alias("edges"))
    return kept.write(node.where((F.col("n") >= least) | (F.col("head") == "")))[0]


def graph(count: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: lang, a and b (its two nodes), w1, w2, w3, n; nodes: lang, a, w1, w2, n and ``most``, the greatest weight of an edge at it, ``inner``)."""
    w = F.split("a", " ")
    node = count.where(F.col("head").contains(" ")).select("lang", F.col("head").alias("a"), "n", "edges").withColumns({"w1": F.get(w, F.lit(0)), "w2": F.get(w, F.lit(1))})
    edge = node.select("lang", "a", "w1", "w2", F.explode("edges").alias("e")).select("lang", "a", F.concat("w2", F.lit(" "), "e.tail").alias("b"), "w1", "w2", F.col("e.tail").alias("w3"), "e.n")
    out = F.coalesce(F.array_max(F.transform("edges", lambda e: e["n"])), F.lit(0).cast("long"))
    into = edge.groupBy("lang", F.col("b").alias("a")).agg(F.max("n").alias("into"))
    node = node.withColumn("out", out).join(into, ["lang", "a"], "left").withColumn("into", F.coalesce("into", F.lit(0).cast("long")))
    return edge, node.select("lang", "a", "w1", "w2", "n", F.greatest("out", "into").alias("most"), ((F.col("out") == F.col("n")) & (F.col("into") == F.col("n"))).alias("inner"))


def compact(edge: DataFrame, node: DataFrame, kept: Kept) -> DataFrame:
    """The edges with ``in_a`` and ``in_b`` (whether their nodes are inside a path), ``head`` and ``via`` (the first two nodes of their path) and ``step`` (their place on it, from 0).

    An edge that leaves an inner node goes on from the one edge that enters it.  Each round doubles how far back a node has looked; a node that has found the
    beginning of its path takes no part any more.  A path cannot close on itself, since its occurrences would have no beginning.
    """
    inner = node.where("inner").select("lang", "a")
    both = edge.join(inner.withColumn("in_a", F.lit(True)), ["lang", "a"], "left").join(inner.select("lang", F.col("a").alias("b"), F.lit(True).alias("in_b")), ["lang", "b"], "left")
    no = F.lit(False)
    edge, _ = kept.write(both.select("lang", "a", "b", "w1", "w2", "w3", "n", F.coalesce("in_a", no).alias("in_a"), F.coalesce("in_b", no).alias("in_b")))
    # one edge enters an inner node x: it comes ``far`` edges from ``to``; open: that is an inner node as well
    back, path = kept.write(edge.where("in_b").select("lang", F.col("b").alias("x"), F.col("a").alias("to"), F.col("b").alias("via"), F.lit(1).cast("long").alias("far"), F.col("in_a").alias("open")))
    while back.where("open").limit(1).count():
        of = back.select("lang", F.col("x").alias("to"), F.col("to").alias("to2"), F.col("via").alias("via2"), F.col("far").alias("far2"), F.col("open").alias("open2"))
        jump = back.where("open").join(of, ["lang", "to"]).select("lang", "x", F.col("to2").alias("to"), F.col("via2").alias("via"), (F.col("far") + F.col("far2")).alias("far"), F.col("open2").alias("open"))
        back, new_path = kept.write(back.where("not open").unionByName(jump))
        kept.drop(path)
        path = new_path
    first = back.select("lang", F.col("x").alias("a"), "to", F.col("via").alias("v"), "far")
    return edge.join(first, ["lang", "a"], "left").select(*edge.columns, F.coalesce("to", "a").alias("head"), F.coalesce("v", "b").alias("via"), F.coalesce("far", F.lit(0)).alias("step"))


def paths(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The compacted paths: lang, n (occurrences of each of their phrases), words (their length), first and last (pair of words)."""
    kept = Kept(docs.sparkSession, "collocations")
    on = compact(*graph(counts(docs, kept, least)), kept)
    return on.groupBy("lang", "head", "via").agg(F.max("n").alias("n"), (F.max("step") + 3).alias("words"), F.max_by("b", "step").alias("last")).select("lang", "n", "words", F.col("head").alias("first"), "last")


def score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)) by whole division of decimals, whose products may pass 64 bits."""
    d = "cast({} as decimal(20, 0))".format
    return F.expr(f"({d(a)} * {d(a)} * {SCALE}) div ({d(left)} * {d(right)})")


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score, path_words (of a phrase of three words: the length of the path that it lies on) of the candidates that stay."""
    kept = Kept(docs.sparkSession, "collocations")
    count = counts(docs, kept, least)
    edge, node = graph(count)
    node, _ = kept.write(node)
    edge, _ = kept.write(compact(edge, node, kept))
    word = count.where((F.col("head") != "") & ~F.col("head").contains(" ")).select("lang", F.col("head").alias("w1"), "n")
    first = word.select("lang", "w1", F.col("n").alias("f1"))
    last = lambda w: word.select("lang", F.col("w1").alias(w), F.col("n").alias("fz"))
    # the pairs inside a path have its weight; the others are looked up
    outer = node.where("not inner")
    flow_a, flow_b = outer.select("lang", "a", F.col("n").alias("fa")), outer.select("lang", F.col("a").alias("b"), F.col("n").alias("fb"))
    length = edge.groupBy("lang", "head", "via").agg((F.max("step") + 3).alias("path_words"))
    three = edge.join(flow_a, ["lang", "a"], "left").join(flow_b, ["lang", "b"], "left").join(first, ["lang", "w1"]).join(last("w3"), ["lang", "w3"]).join(length, ["lang", "head", "via"])
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), "f1", F.coalesce("fb", "n").alias("fb"), F.coalesce("fa", "n").alias("fa"), "fz", "path_words")
    three = three.select("*", score("a", "f1", "fb").alias("s1"), score("a", "fa", "fz").alias("s2"))
    low = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    three = three.select("lang", "phrase", "a", pick("f1", "fa").alias("l"), pick("fb", "fz").alias("r"), F.least("s1", "s2").alias("score"), "path_words")
    own = outer.where(F.col("most") * 100 < F.col("n") * share).join(first, ["lang", "w1"]).join(last("w2"), ["lang", "w2"])
    two = own.select("lang", F.col("a").alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("fz").alias("r")).select("*", score("a", "l", "r").alias("score"), F.lit(None).cast("long").alias("path_words"))
    total = count.where("head = ''").select("lang", "n")
    return three.unionByName(two).join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score", "path_words")


def best(docs: DataFrame, most: int = FIRST, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The first ``most`` phrases of each language with their rank; each language is ranked in ``PARTS`` parts first, of which only so many go on."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = phrases(docs, least, share).withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("_r") <= most)
    got = some.drop("_p", "_r").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


SQL = f"""
WITH RECURSIVE p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w
                     FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
     g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) v(k)),
     f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
     total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
     c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {LEAST}),
     t AS MATERIALIZED (SELECT lang, phrase, a, w[1] || ' ' || w[2] AS x, w[2] || ' ' || w[3] AS y FROM c WHERE k = 3),
     inner_pair AS MATERIALIZED (SELECT lang, phrase FROM c WHERE k = 2 AND EXISTS (FROM t WHERE t.lang = c.lang AND t.x = c.phrase AND t.a = c.a) AND EXISTS (FROM t WHERE t.lang = c.lang AND t.y = c.phrase AND t.a = c.a)),
     way AS (SELECT lang, x || '|' || y AS id, y, 3 AS words, phrase FROM t WHERE NOT EXISTS (FROM inner_pair i WHERE i.lang = t.lang AND i.phrase = t.x)
             UNION ALL SELECT way.lang, id, t.y, words + 1, t.phrase FROM way JOIN inner_pair i ON i.lang = way.lang AND i.phrase = way.y JOIN t ON t.lang = way.lang AND t.x = way.y),
     long AS (SELECT lang, phrase, max(words) OVER (PARTITION BY lang, id) AS path_words FROM way),
     cuts AS MATERIALIZED (SELECT lang, phrase, k, a, cut, array_to_string(w[:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
     often AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= {LEAST}),
     s AS MATERIALIZED (SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a) AS score
           FROM cuts JOIN often l ON l.lang = cuts.lang AND l.phrase = x JOIN often r ON r.lang = cuts.lang AND r.phrase = y),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     around AS MATERIALIZED (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, x AS phrase, a FROM t UNION ALL SELECT lang, y, a FROM t) GROUP BY ALL),
     stay AS (SELECT b.* FROM b LEFT JOIN around ON around.lang = b.lang AND around.phrase = b.phrase WHERE NOT coalesce(100 * most >= {SHARE} * b.a, false))
SELECT stay.lang, row_number() OVER (PARTITION BY stay.lang ORDER BY score DESC, a DESC, stay.phrase) AS rank, stay.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, path_words::BIGINT AS path_words
FROM stay JOIN total USING (lang) LEFT JOIN long ON long.lang = stay.lang AND long.phrase = stay.phrase AND stay.k = 3
QUALIFY rank <= {FIRST}
"""
