"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``distance // 2 + 1`` segments: of at most ``distance`` differing bits one segment then has one at most.  Every segment
is indexed once for each of its bits with that bit left out, 64 rows in all, so two fingerprints within the distance meet in an equality join on some
(bit left out, rest of the segment); the join verifies the distance of the whole fingerprints.

Copies are one fingerprint.  Links within a large group of near copies are not listed pair by pair: in each bucket a fingerprint is first compared with the
least one and with its predecessor, which joins most of a group; then each bucket compares the fingerprints outside its largest
component with the others, and only pairs of different components come out.  The components are those of all links.

Words are runs of non-blank characters, A-Z lower-cased; a text of fewer words than a shingle is one shingle, a text without words has fingerprint zero and
is linked like any other; null texts have no words.  Rows without id belong to their component but never name it.  Repeated rows, an empty table and other
columns are fine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Kept, arrow_pass, ship, texts
from panelspark.llm.components import components

BITS, SEED, CHUNK = 64, 42, 1 << 16
#: Minima a band, bands: of pairs of similarity 0.8, (1 - 0.8 ** 6) ** 24 = 0.07 % share no band, of 0.85 0.0012 %.
DEEP, BANDS = 6, 24
#: Texts of a side of a tile of comparisons, and shingles that make it fewer.
TILE, SHINGLES = 1024, 1 << 21
#: What tells the orders of the minima apart.
SALT, ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, DEEP * BANDS, 1), np.uint64)
ODD |= np.uint64(1)


def digests(text: str, width: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles in order, ``CHUNK`` at a time; nothing for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return
    width = min(width, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = size.cumsum()
    begin, end = (stop - size)[: len(words) - width + 1].tolist(), (stop - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of the hashes of all shingles, repeats included."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed 64 bits) for every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([majority(digests(t, width)) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    return arrow_pass(texts(docs, id_col, text_col), run, "doc_id long, fp long")


def signatures(fp: Column, distance: int) -> Column:
    """The 64 keys of a fingerprint: the number of the bit left out, then the segment without it."""
    n = distance // 2 + 1
    keys = []
    for s in range(n):
        lo, hi = BITS * s // n, BITS * (s + 1) // n
        segment = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        keys += [segment.bitwiseAND(F.lit(((1 << (hi - lo)) - 1) & ~(1 << i))).bitwiseOR(F.lit((lo + i) << 32)) for i in range(hi - lo)]
    return F.array(*keys)


def links(fps: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(component labels of the linked fingerprints as node and root, the kept table of buckets).  ``fps``: distinct ``fp``."""
    kept = Kept(fps.sparkSession, "simhash")
    key = Window.partitionBy("key")
    seen = key.orderBy("fp")
    far = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    spread = fps.select("fp", F.explode(signatures(F.col("fp"), distance)).alias("key"))
    bucket = spread.select("key", "fp", F.first("fp").over(seen).alias("head"), F.lag("fp").over(seen).alias("prev"), F.count("*").over(key).alias("n")).where("n > 1")
    bucket, path = kept.write(bucket)
    first = bucket.where(far("fp", "prev") <= distance).select(F.col("fp").alias("a"), F.col("prev").alias("b")).unionByName(bucket.where((F.col("head") != F.col("fp")) & (far("fp", "head") <= distance)).select(F.col("fp").alias("a"), F.col("head").alias("b")))
    first, _ = kept.write(first.distinct())
    label = components(first)
    # what is left: pairs of different components in buckets of four and more; in smaller ones every pair has been compared
    of = bucket.where("n > 3").select("key", "fp").join(label.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    own = of.withColumn("size", F.count("*").over(Window.partitionBy("key", "root")))
    mixed = own.select("key", "fp", "root", F.max(F.struct("size", "root")).over(key)["root"].alias("main"), F.min("root").over(key).alias("lo"), F.max("root").over(key).alias("hi")).where("lo <> hi").drop("lo", "hi")
    mixed, mixed_path = kept.write(mixed)
    few = mixed.where("root <> main").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    pairs = few.join(mixed.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"), "main"), "key").where((F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))) & (far("a", "b") <= distance))
    second, _ = kept.write(pairs.select("a", "b").distinct())
    kept.drop(mixed_path)
    kept.drop(path)
    if second.limit(1).count():
        label = components(first.unionByName(second))
    return label, first


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the component) for every row."""
    kept = Kept(docs.sparkSession, "fingerprints")
    own, _ = kept.write(fingerprints(docs, width))
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label, _ = links(fps.select("fp"), distance)
    rooted = fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(got: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes of the shingles, ascending; a text without words has one shingle of its own."""
    return np.unique(np.concatenate(got)) if got else np.zeros(1, np.uint64)


def bands(h: np.ndarray) -> list[int]:
    """``BANDS`` numbers (signed 64 bits) of a set of hashes: each stands for its least members in ``DEEP`` orders."""
    least = np.full(DEEP * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 512):
        x = (h[None, at : at + 512] ^ SALT) * ODD
        x ^= x >> np.uint64(32)
        x *= ODD
        np.minimum(least, x.min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * DEEP : (k + 1) * DEEP].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets, none of them empty."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs ``a, b`` whose sets (``node, h``) have that similarity."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        (x, p), (y, q) = ((b.column(c).flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(b.column(c).value_lengths().to_numpy())))) for c in ("ha", "hb"))
        good = [alike(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]]) >= similarity for i in range(b.num_rows)]
        return b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), sets.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    return arrow_pass(pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "ha", "hb"), run, "a {0}, b {0}".format(sets.schema["node"].dataType.simpleString()))


def tiles(mixed: DataFrame) -> DataFrame:
    """key, f, j, node, root, side: the comparisons that a bucket needs, cut so that a tile holds ``TILE`` texts a side, or so many that ``SHINGLES`` shingles are there.

    Texts outside the bucket's largest component (side 0) meet every text of the bucket (side 1).
    """
    key = Window.partitionBy("key")
    blocks = lambda n, size: F.ceil(F.greatest(n / TILE, size / SHINGLES)).cast("int")
    few = F.col("root") != F.col("main")
    number = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    m = mixed.select("key", "node", "root", few.alias("few"), blocks(F.count("*").over(key), F.sum("n").over(key)).alias("mb"), blocks(F.count_if(few).over(key), F.sum(F.when(few, F.col("n")).otherwise(0)).over(key)).alias("fb"))
    own = m.where("few").select("key", number(0, F.col("fb")).alias("f"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"), "node", "root", F.lit(0).alias("side"))
    met = m.select("key", F.explode(F.sequence(F.lit(0), F.col("fb") - 1)).alias("f"), number(1, F.col("mb")).alias("j"), "node", "root", F.lit(1).alias("side"))
    return own.unionByName(met)


def compare(few: list[tuple[str | int, str | int, np.ndarray]], others: list[tuple[str | int, str | int, np.ndarray]], similarity: float) -> list[tuple[str | int, str | int]]:
    """Links of that similarity between (node, root, shingles) of different components; of links that join the same components one is enough."""
    if not few or not others:
        return []
    size = np.array([len(h) for _, _, h in others])
    begin = np.concatenate(([0], size.cumsum()[:-1]))
    known, at = np.unique(np.concatenate([h for _, _, h in others]), return_inverse=True)
    up: dict[str | int, str | int] = {}

    def top(x: str | int) -> str | int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    here = np.zeros(len(known), bool)
    for node, root, h in few:
        p = np.minimum(np.searchsorted(known, h), len(known) - 1)
        p = p[known[p] == h]
        here[p] = True
        both = np.add.reduceat(here[at], begin, dtype=np.int64)
        here[p] = False
        for i in np.flatnonzero(both >= similarity * (len(h) + size - both) - 1e-9).tolist():
            a, b = top(root), top(others[i][1])
            if a != b and both[i] / (len(h) + size[i] - both[i]) >= similarity:
                up[a] = b
                out.append((node, others[i][0]))
    return out


def tile_links(tile: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between the texts of each tile; a tile is held while it is compared, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sides, kind = None, ([], []), None
        for b in batches:
            kind = b.schema.field("node").type
            found: list[tuple[str | int, str | int]] = []
            value, end = b.column("h").flatten().to_numpy(), np.concatenate(([0], np.cumsum(b.column("h").value_lengths().to_numpy())))
            names = zip(*(b.column(c).to_pylist() for c in ("key", "f", "j")), strict=True)
            for i, (who, node, root, side) in enumerate(zip(names, *(b.column(c).to_pylist() for c in ("node", "root", "side")), strict=True)):
                if who != last:
                    found += compare(*sides, similarity)
                    last, sides = who, ([], [])
                sides[side].append((node, root, value[end[i] : end[i + 1]].copy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["a", "b"])
        if found := compare(*sides, similarity):
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["a", "b"])

    ship(tile.sparkSession)
    rows = tile.join(sets, "node").select("key", "f", "j", "node", "root", "side", "h")
    return rows.repartition("key", "f", "j").sortWithinPartitions("key", "f", "j", "side").mapInArrow(run, "a {0}, b {0}".format(sets.schema["node"].dataType.simpleString()))


def alike_components(own: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], similarity: float, kept: Kept, more: DataFrame | None = None) -> DataFrame:
    """node, root of the texts linked by pairs of that similarity.  ``own``: distinct ``node``, n (number of shingles), bands; ``sets``: the same nodes with ``h``, their shingles, or what makes these of given nodes; ``more``: buckets beside
    those of the bands (``key, node, n``).

    A text is compared with one least member of its buckets; then each bucket compares the texts outside its largest component with those of others, tile by
    tile, and only links that join components come out.
    """
    key = Window.partitionBy("key")
    spread = own.select("node", "n", F.explode("bands").alias("key"))
    if more is not None:
        spread = spread.unionByName(more)
    bucket, path = kept.write(spread.select("key", "node", "n", F.min("node").over(key).alias("head"), F.max("node").over(key).alias("last")).where("head <> last").drop("last"))
    # only the sets of texts that meet another are wanted
    meet = bucket.select("node").distinct()
    some, some_path = kept.write(sets(meet) if callable(sets) else sets.join(meet, "node", "left_semi"))
    first, _ = kept.write(verified(bucket.where("node <> head").groupBy(F.col("node").alias("a")).agg(F.min("head").alias("b")), some, similarity))
    label = components(first)
    of = bucket.select("key", "node", "n").join(label, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    counted = of.withColumn("size", F.count("*").over(Window.partitionBy("key", "root")))
    several = counted.select("key", "node", "n", "root", F.max(F.struct("size", "root")).over(key)["root"].alias("main"), F.min("root").over(key).alias("lo"), F.max("root").over(key).alias("hi")).where("lo <> hi").drop("lo", "hi")
    mixed, mixed_path = kept.write(several)
    second, _ = kept.write(tile_links(tiles(mixed), some, similarity))
    for p in (path, some_path, mixed_path):
        kept.drop(p)
    return components(first.unionByName(second)) if second.limit(1).count() else label


def fingerprint_groups(own: DataFrame, distance: int) -> DataFrame:
    """key, node, n: one bucket for the texts whose fingerprints ``fp`` are linked, by the index of deletion variants, in any number of steps."""
    label, _ = links(own.select("fp").distinct(), distance)
    return own.join(label.withColumnRenamed("node", "fp"), "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "node", "n")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id (then the least hash of its text) stays.

    Texts whose SimHash fingerprints are linked within ``distance`` bits, as in ``near_duplicates``, are compared by their sets of ``width``-word shingles
    themselves, and linked from a similarity (Jaccard) of ``similarity`` on.  Pairs of that similarity often differ in more bits, so texts that share one of
    ``BANDS`` bands of minima of these sets are compared as well.  Texts without words are copies of one another.  Rows of one id and
    different texts are documents of their own, equal rows of one id are one; rows without id are left alone.  Columns must have an order (no maps).
    """
    kept = Kept(docs.sparkSession, "near")
    rows = docs.where("doc_id is not null")
    each = texts(rows).select(F.md5(F.col("text").cast("binary")).alias("md5"), F.col("doc_id").alias("least"), "text")

    def sketch(b: pa.RecordBatch) -> pa.RecordBatch:
        n, fp, band = [], [], []
        for t in b.column("text").to_pylist():
            got = list(digests(t, width))
            h = shingles(got)
            n.append(len(h))
            fp.append(majority(got))
            band.append(bands(h))
        return pa.RecordBatch.from_arrays([b.column("md5"), b.column("least"), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(band, pa.list_(pa.int64()))], names=["md5", "least", "n", "fp", "bands"])

    def hashes(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(list(digests(t, width))) for t in b.column("text").to_pylist()]
        held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(h) for h in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([b.column("node"), held], names=["node", "h"])

    # neither texts nor sets are dealt out here; a text is a number from now on, fixed as the table is written once
    drawn = arrow_pass(each, sketch, "md5 string, least long, n int, fp long, bands array<long>")
    drawn = drawn.groupBy("md5").agg(F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    own, own_path = kept.write(drawn.withColumn("node", F.monotonically_increasing_id()))

    def sets(meet: DataFrame) -> DataFrame:
        want = own.join(meet, "node", "left_semi").select("node", "md5", "least")
        return arrow_pass(each.join(want, ["least", "md5"]).groupBy("least", "md5", "node").agg(F.first("text").alias("text")).select("node", "text"), hashes, "node long, h array<long>")

    label = alike_components(own.select("node", "n", "bands"), sets, similarity, kept, fingerprint_groups(own.select("node", "n", "fp"), distance))
    rooted = own.select("node", "md5", "least").join(label, "node", "left").select("md5", "least", F.coalesce("root", "node").alias("root"))
    stays, _ = kept.write(rooted.groupBy("root").agg(F.min(F.struct("least", "md5")).alias("s")).select(F.col("s.least").alias("__id"), F.col("s.md5").alias("__node")))
    kept.drop(own_path)
    # repeated rows collapse before they are dealt out; of rows that differ in another column the least stays
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = rows.select(F.col("doc_id").cast("long").alias("__id"), F.md5(text.cast("binary")).alias("__node"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    one = one.join(stays, ["__id", "__node"], "left_semi").groupBy("__id", "__node").agg(F.min("__row").alias("__row"))
    return one.select("__row.*").unionByName(docs.where("doc_id is null"))
