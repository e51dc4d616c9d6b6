"""Prefix trie of conversations by collapsing whole sequences.

Conversations that say the same are one weighted sequence, named by its smallest conv_id, with the list of the conversations that end there; only such
sequences are unfolded into prefixes.  A sequence that is a proper prefix of another leaves by an anti-join, the others are the leaves.  A node is a
distinct prefix; its members, leaves and bytes are sums over the weighted prefixes of the sequences.

A prefix is known by its length and 128 bits: the exclusive or of the hashes of its turns, each with its position.  That is a running total, so a very
long conversation is cut in blocks (of turn numbers, then of positions) whose totals are carried on, and no task needs a conversation whole.

What a subtree saves needs no pairs of nodes and ancestors: a node belongs to the sequence whose name is its smallest member, the nodes that belong to a
sequence are the lowest ones of its path, so every sequence adds to each of its prefixes its weighted bytes from there on, less those of its own nodes.

Turns are ordered by turn (null first), then role, then text; null role and text are empty; rows without conv_id are no conversation's and are left out;
repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import CRC32_SQL, CRC32_TABLE_SQL, Kept, ship

#: Turn numbers, and positions, that are ordered together; identifiers of a list that are joined to one text.
BLOCK, IDS = 4096, 512
FAMILY, LONGEST = 5, 9
NODE = ["k1", "k2", "depth"]


def numbered(talks: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), said (hash of role and text) and size (bytes of the text) of each turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = talks.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    own = own.withColumn("blk", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 62))))
    n = own.groupBy("conv_id", "blk").agg(F.count("*").alias("n"))
    before = n.select(F.col("conv_id").alias("_c"), F.col("blk").alias("_b"), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("conv_id", "blk").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    inside = own.withColumn("pos", F.row_number().over(w)).select("conv_id", "blk", "pos", said.alias("said"), F.octet_length("text").cast("long").alias("size"))
    return inside.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("blk") == F.col("_b"))).select("conv_id", (F.col("pos") + F.col("before")).alias("pos"), "said", "size")


def rebuilt(turns: DataFrame, conv: DataFrame) -> DataFrame:
    """conv_id, pos, said, size after each conversation took the first turns of the first of its family.  ``conv``: conv_id and n, its number of turns."""
    c = F.col("conv_id")
    taken = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(LONGEST))
    rule = conv.select("conv_id", taken.alias("h"), (c - c % FAMILY).alias("first"))
    lead = conv.select(F.col("conv_id").alias("_f"), F.col("n").alias("n_first"))
    rule = rule.join(lead, F.col("first") == F.col("_f"), "left").select("conv_id", "h", "first", F.least("h", F.coalesce("n_first", F.lit(0))).alias("got"))
    head = turns.where(F.col("pos") < LONGEST).withColumnRenamed("conv_id", "first")
    shared = rule.join(head, "first").where("pos <= h").select("conv_id", "pos", "said", "size")
    rest = turns.join(rule, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "said", "size")
    return shared.unionByName(rest)


def lanes() -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64("pos", "said"), F.xxhash64("said", "pos", F.lit(1))]


def prefixes(turn: DataFrame, by: str) -> DataFrame:
    """For each turn of ``by``: depth, k1, k2 (the prefix that ends with it), p1, p2 (the one before it), size, cum (bytes up to its end)."""
    a, b = lanes()
    t = turn.select(by, F.col("pos").alias("depth"), "size", a.alias("l1"), b.alias("l2"), F.expr(f"pos div {BLOCK}").alias("blk"))
    total = t.groupBy(by, "blk").agg(F.bit_xor("l1").alias("l1"), F.bit_xor("l2").alias("l2"), F.sum("size").alias("size"))
    w = Window.partitionBy(by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda w, names: [F.coalesce(f(c).over(w), F.lit(0).cast("long")).alias(n) for f, c, n in zip((F.bit_xor, F.bit_xor, F.sum), ("l1", "l2", "size"), names, strict=True)]
    before = total.select(F.col(by).alias("_by"), F.col("blk").alias("_blk"), *fold(w, ("b1", "b2", "b3")))
    inside = t.select("*", *fold(Window.partitionBy(by, "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0), ("i1", "i2", "i3")))
    both = inside.join(before, (F.col(by) == F.col("_by")) & (F.col("blk") == F.col("_blk")))
    k1, k2 = F.col("i1").bitwiseXOR(F.col("b1")), F.col("i2").bitwiseXOR(F.col("b2"))
    return both.select(by, "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("l1")).alias("p1"), k2.bitwiseXOR(F.col("l2")).alias("p2"), "size", (F.col("i3") + F.col("b3")).alias("cum"))


def list_hashes(ends: DataFrame) -> DataFrame:
    """k1, k2, depth and ends_sha256 of the ascending, comma-joined ``conv_id`` of each node.

    A list is joined in pieces of ``IDS`` consecutive numbers; the pieces pass the hash one after the other, so a list of any length takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            k1, k2, depth, sha = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha)], names=[*NODE, "ends_sha256"])

        for b in batches:
            for node, ids in zip(zip(*(b.column(c).to_pylist() for c in NODE), strict=True), b.column("ids").to_pylist(), strict=True):
                if node != last:
                    if digest:
                        done.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield out()
        if digest:
            done.append((*last, digest.hexdigest()))
            yield out()

    piece = ends.groupBy(*NODE, F.expr(f"conv_id div {IDS}").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    # numbers under zero are ordered by piece as well, piece 0 holds those on both sides of it
    ship(ends.sparkSession)
    return piece.repartition(*NODE).sortWithinPartitions(*NODE, "piece").drop("piece").mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def sequences(turn: DataFrame, conv: DataFrame) -> DataFrame:
    """conv_id and the node (k1, k2, depth) at which it ends, and total, its bytes; conversations without turns end at the root."""
    a, b = lanes()
    whole = turn.groupBy("conv_id").agg(F.bit_xor(a).alias("k1"), F.bit_xor(b).alias("k2"), F.count("*").alias("depth"), F.sum("size").alias("total"))
    zero = F.lit(0).cast("long")
    return conv.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in (*NODE, "total")])


def trie(talks: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    kept = Kept(talks.sparkSession, "trie")
    turns, _ = kept.write(numbered(talks))
    conv = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    turn, _ = kept.write(rebuilt(turns, conv))
    return nodes(turn, conv, kept)


def nodes(turn: DataFrame, conv: DataFrame, kept: Kept) -> DataFrame:
    """As ``trie``, of the turns (conv_id, pos, said, size) of the conversations ``conv``."""
    ends, _ = kept.write(sequences(turn, conv))
    seq, _ = kept.write(ends.groupBy(*NODE).agg(F.min("conv_id").alias("m"), F.count("*").alias("w"), F.max("total").alias("total")))
    lead = turn.withColumnRenamed("conv_id", "m").join(seq.select("m"), "m", "left_semi")
    zero = F.lit(0).cast("long")
    top = seq.select("m", *[zero.alias(c) for c in NODE], F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("size"), zero.alias("cum"))
    path = prefixes(lead, "m").unionByName(top)
    path, _ = kept.write(path.join(seq.select("m", "w", F.col("depth").alias("len")), "m"))
    # sequences that are no proper prefix of another are the leaves
    proper = path.where("depth < len").select(*NODE).distinct()
    leaf = seq.join(proper, NODE, "left_anti").select("m", F.lit(1).cast("long").alias("leaf"))
    node = path.groupBy(*NODE).agg(F.sum("w").alias("n_convs"), F.min("m").alias("conv_id"), F.max(F.struct("p1", "p2", "size", "cum")).alias("x"))
    node, _ = kept.write(node.select(*NODE, "n_convs", "conv_id", "x.*"))
    # the highest node that belongs to each sequence, and the one above it
    own = node.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2", (F.col("cum") - F.col("size")).alias("upto"))).alias("o")).select(F.col("conv_id").alias("m"), F.col("o.depth").alias("from"), F.col("o.p1").alias("p1"), F.col("o.p2").alias("p2"), F.col("o.upto").alias("upto"))
    own, _ = kept.write(own)
    above = node.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("from"), F.col("conv_id").alias("parent"))
    parent = own.where("from > 0").select("m", "from", "p1", "p2").join(above, ["p1", "p2", "from"]).select("m", "from", "parent")
    each = seq.select("m", "total").join(own.select("m", "from", "upto"), "m", "left").join(leaf, "m", "left")
    step = path.join(each, "m")
    after = F.col("total") - (F.col("cum") - F.col("size"))
    belongs = F.when(F.col("from").isNull(), 0).when(F.col("depth") >= F.col("from"), after).otherwise(F.col("total") - F.col("upto"))
    saved = step.select(*NODE, F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("w") * after - belongs).alias("saved"))
    named = node.join(parent, (F.col("conv_id") == F.col("m")) & (F.col("depth") == F.col("from")), "left")
    up = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    parts = [
        named.select(*NODE, "conv_id", "n_convs", up.alias("parent")),
        saved,
        node.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), F.lit(1).alias("child")),
        list_hashes(ends),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    got = every.groupBy(*NODE).agg(F.max("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), n("child").alias("n_children"), n("leaf").alias("n_leaves"), n("saved").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = f"""
WITH crc AS ({CRC32_TABLE_SQL}),
     o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, {CRC32_SQL.format("conv_id::VARCHAR")} % {LONGEST} AS h, conv_id - conv_id % {FAMILY} AS base FROM (SELECT DISTINCT conv_id FROM o), crc),
     u AS (SELECT c.conv_id, 0 AS part, o.pos AS place, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h UNION ALL SELECT c.conv_id, 1, o.pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
     r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, md5(length(role) || ':' || role || text) AS said, octet_length(encode(text)) AS size FROM u),
     p AS (SELECT conv_id, depth, size, string_agg(said, '') OVER w AS k, coalesce(string_agg(said, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
           UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
     n AS (SELECT depth, k, up, max(size) AS size, count(*) AS n_convs, min(conv_id) AS conv_id FROM p GROUP BY ALL),
     kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
     below AS (SELECT DISTINCT a.k AS top, b.k AS k FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
     sums AS (SELECT top AS k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM below JOIN n USING (k) LEFT JOIN kids USING (k) GROUP BY 1),
     ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n q ON n.up = q.k JOIN sums ON n.k = sums.k LEFT JOIN kids ON n.k = kids.k LEFT JOIN ends ON n.k = ends.k
"""
