"""Exact removal of repeated byte strings with a suffix array of the places that can repeat, sorted deep-shallow.

A byte goes if a string of 200 bytes that covers it also starts elsewhere, in the same document or another.

1. Every window of 200 bytes has an anchor (``anchors``); neighbouring windows of one anchor form a run.  Equal runs of a batch are told at once; one for
   them and the others are dealt by the hash of their anchor and ordered by the hash of their bytes, and each looks at its neighbours only: alone in its
   anchor it repeats nothing; next to an equal run all its windows repeat; else it is open.  A hot anchor is a stream of rows here, never a group in memory.
2. Open runs, and one of the equal runs beside them, are cut from their texts in two parts (windows reaching far to the right or to the left of the anchor),
   which are dealt by the hash of the 132 bytes that all windows of a part hold.
3. Each such group's windows are suffixes to be sorted: multikey passes over eight bytes at a time down to a shallow depth, where only suffixes that are
   still equal go on; then a blind trie orders every remaining group down to 200 bytes.  Suffixes that share 200 bytes repeat.

Equal hashes of runs are taken as equal bytes (64 bits, both of anchor and run); everything open is compared byte by byte.

Null texts are empty; texts under 200 bytes lose nothing; several rows with equal id and text are documents of their own, all of which lose what the others
show; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import anchors
from panelspark.llm.anchors import GRAM, LENGTH, SEGMENT
from panelspark.llm.common import Kept, arrow_pass, ship, texts

#: Bytes that the multikey passes compare; contexts that are sorted together at least.
SHALLOW, TOGETHER = 64, 3000
#: Windows reach at least this far beyond the anchor on one side.
REACH = (LENGTH - GRAM) // 2


def entries(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """The runs of a batch of texts: gram, span, key, place (first window, offset of the anchor, number of further windows, in one number), kind.

    Runs that are equal to another of the batch repeat whatever the other tasks find (kind 1); they are dealt out evenly, under a number of their own in
    place of the anchor, and one of them (kind 2) stands for all among the runs of its anchor.  So a passage that very many documents share, or a text
    that says one thing over and over, meets in one task as one row a batch.
    """
    out: list[tuple[np.ndarray, ...]] = []
    held: list[bytes] = []
    spots: list[tuple[int, int, int]] = []  # start in the segment, key, offset in the text
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        starts = np.array([s[0] for s in spots])
        r = anchors.runs(np.frombuffer(b"".join(held), np.uint8), [*starts[1:].tolist(), size])
        if len(r.lo):
            which = np.searchsorted(starts, r.lo, "right") - 1
            at = r.lo - starts[which] + np.array([s[2] for s in spots])[which]
            out.append((r.gram, r.span, np.array([s[1] for s in spots], np.int64)[which], at << 16 | r.off << 8 | (r.hi - r.lo)))
        held.clear()
        spots.clear()
        size = 0

    for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
        raw = text.encode("utf-8", "replace")
        for at in range(0, max(len(raw) - LENGTH + 1, 0), SEGMENT - LENGTH):
            piece = raw[at : at + SEGMENT - 1]
            if len(piece) < LENGTH:
                break
            if size + len(piece) > SEGMENT:
                flush()
            spots.append((size, key, at))
            held.append(piece)
            size += len(piece)
    flush()
    if not out:
        return None
    gram, span, key, place = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((span, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (span[order][1:] == span[order][:-1])
    after, before = np.append(False, same), np.append(same, False)
    first = order[before & ~after]
    many = order[before | after]
    kind = np.zeros(len(gram), np.int32)
    kind[many] = 1
    lead = [gram[first], span[first], key[first], place[first]]
    gram = gram.copy()
    gram[many] = anchors.mix((key[many] + place[many] * 1_000_003).view(np.uint64)).view(np.int64)
    cols = [np.concatenate((a, b)) for a, b in zip((gram, span, key, place, kind), (*lead, np.full(len(first), 2, np.int32)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "span", "key", "place", "kind"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two equally long strings."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Orders equally long strings: a list of the indices of each distinct one, ascending.

    Nodes hold the position at which their strings part and one byte for each branch.  A string goes down by these bytes alone, any branch where its own
    is missing, is compared once with the string it meets, and parts from it where they differ.
    """
    size = len(strings[0])
    root: tuple = (size, [0])  # a leaf: (size, indices); a node: (position, {byte: child})
    for i, s in enumerate(strings[1:], 1):
        node = root
        while node[0] < size:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        split = common(s, strings[node[1][0]])
        if split >= size:
            node[1].append(i)
            continue
        other = strings[node[1][0]][split]
        above, node = None, root
        while node[0] < split:
            above, node = node, node[1][s[node[0]]]
        if node[0] == split:
            node[1][s[split]] = (size, [i])
        else:
            new = (split, {other: node, s[split]: (size, [i])})
            if above is None:
                root = new
            else:
                above[1][s[above[0]]] = new
    out, todo = [], [root]
    while todo:
        pos, below = todo.pop()
        if pos == size:
            out.append(below)
        else:
            todo += [below[c] for c in sorted(below, reverse=True)]
    return out


def repeated(contexts: list[bytes], group: np.ndarray) -> np.ndarray:
    """Whether each window of the contexts (end to end, ``len(context) - 199`` each) equals another window of a context of its group."""
    data = b"".join(contexts)
    size = np.array([len(c) for c in contexts])
    start, many = size.cumsum() - size, size - LENGTH + 1
    base = np.repeat(np.arange(len(contexts)), many)
    inside = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
    pos = start[base] + inside
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    word = np.zeros(len(raw), np.uint64)
    for k in range(8):
        word[: len(raw) - k] |= raw[k:] << np.uint64(56 - 8 * k)
    found = np.zeros(len(pos), bool)
    left, rank = np.arange(len(pos)), group[base].astype(np.int64)  # suffixes still equal to others, and the class each is in
    for depth in range(0, SHALLOW, 8):
        w = word[pos[left] + depth]
        order = np.lexsort((w, rank))
        left, rank, w = left[order], rank[order], w[order]
        new = np.ones(len(left), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (w[1:] != w[:-1])
        rank = new.cumsum()
        equal = np.zeros(len(left), bool)
        equal[1:] |= ~new[1:]
        equal[:-1] |= ~new[1:]
        left, rank = left[equal], rank[equal]
        if not len(left):
            return found
    cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])).tolist() + [len(left)]
    at, who = pos[left].tolist(), left.tolist()
    hit: list[int] = []
    for a, z in zip(cut, cut[1:], strict=False):
        tails = [data[p + SHALLOW : p + LENGTH] for p in at[a:z]]
        if z - a == 2:
            if tails[0] == tails[1]:
                hit += who[a:z]
            continue
        for same in blind_trie(tails):
            if len(same) > 1:
                hit += [who[a + i] for i in same]
    found[hit] = True
    return found


def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, start, stop of the repeated stretches among rows sorted by ``part``; whole groups are sorted together."""
    part: list[int] = []
    key: list[int] = []
    first: list[int] = []
    data: list[bytes] = []

    def solve(n: int) -> pa.RecordBatch | None:
        g = np.array(part[:n])
        alone = np.ones(n, bool)
        same = g[1:] == g[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        keep = np.flatnonzero(~alone).tolist()
        if not keep:
            return None
        some = [data[i] for i in keep]
        flag = repeated(some, np.unique(g[keep], return_inverse=True)[1])
        k, a, z, at = [], [], [], 0
        for i, c in zip(keep, some, strict=True):
            m = len(c) - LENGTH + 1
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flag[at : at + m].view(np.int8), [0]))))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                k.append(key[i])
                a.append(first[i] + x)
                z.append(first[i] + y - 1 + LENGTH)
            at += m
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["key", "start", "stop"]) if k else None

    for b in batches:
        part += b.column("part").to_pylist()
        key += b.column("key").to_pylist()
        first += b.column("first").to_pylist()
        data += b.column("bytes").to_pylist()
        if len(part) >= TOGETHER:
            n = len(part)
            while n and part[n - 1] == part[-1]:
                n -= 1
            if n:
                if (r := solve(n)) is not None:
                    yield r
                del part[:n], key[:n], first[:n], data[:n]
    if part and (r := solve(len(part))) is not None:
        yield r


def stretches(docs: DataFrame, keyed: DataFrame, kept: Kept) -> DataFrame:
    """key, start, stop (bytes) of repeated stretches; they overlap."""
    run = arrow_pass(keyed.select("key", "text"), entries, "gram long, span long, key long, place long, kind int")
    w = Window.partitionBy("gram").orderBy("span", "key", "place")
    seen = run.withColumn("prev", F.lag("span").over(w)).withColumn("next", F.lead("span").over(w)).where("prev is not null or next is not null or kind = 1")
    equal = (F.col("kind") > 0) | F.coalesce(F.col("prev") == F.col("span"), F.lit(False)) | F.coalesce(F.col("next") == F.col("span"), F.lit(False))
    beside = F.coalesce(F.col("prev") != F.col("span"), F.lit(False)) | F.coalesce(F.col("next") != F.col("span"), F.lit(False))
    known, _ = kept.write(seen.select("gram", "key", "place", equal.alias("equal"), beside.alias("beside")))
    lo, off, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    sure = known.where("equal").select("key", lo.alias("start"), (lo + more + LENGTH).alias("stop"))
    todo = known.where("not equal or beside").select("gram", "key", lo.alias("lo"), (lo + more).alias("hi"), (lo + off).alias("x"))
    joined = keyed.join(todo, "key").select("key", "doc_id", "gram", "lo", "hi", "x", F.encode("text", "UTF-8").alias("raw"))
    cut = lambda a, n: F.substring(F.col("raw"), (a + 1).cast("int"), n.cast("int"))
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    near = F.greatest(lo, x - REACH)  # windows from here on hold REACH bytes after the anchor
    far = F.least(hi, x - REACH - 1)  # windows up to here hold as many before it
    sides = F.array(
        F.when(near <= hi, F.struct(F.xxhash64("gram", F.lit(0), cut(x, F.lit(GRAM + REACH))).alias("part"), near.alias("first"), cut(near, hi - near + LENGTH).alias("bytes"))),
        F.when(lo <= far, F.struct(F.xxhash64("gram", F.lit(1), cut(x - REACH, F.lit(GRAM + REACH))).alias("part"), lo.alias("first"), cut(lo, far - lo + LENGTH).alias("bytes"))),
    )
    parts = joined.select("key", "doc_id", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("s.part", "key", "doc_id", "s.first", "s.bytes")
    ship(docs.sparkSession)
    found = parts.repartition("part").sortWithinPartitions("part").mapInArrow(sort_groups, "key long, start long, stop long")
    return sure.unionByName(found)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row."""
    keyed = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    kept = Kept(docs.sparkSession, "suffixes")
    spans = stretches(docs, keyed, kept).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, got in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace")
            left, at, gone, n = [], 0, 0, 0
            for s, e in merged(got or []):
                left.append(raw[at:s])
                at, gone, n = e, gone + e - s, n + 1
            left.append(raw[at:])
            rows.append((len(raw), gone, n, b"".join(left)))
        n_bytes, n_removed, n_spans, rest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_pass(keyed.join(spans, "key", "left").select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
