"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is cut into paragraphs, and these after each sentence end.  Every part is hashed into a wide vector; the fingerprint is the sum of these vectors modulo
powers of two, so it depends on the parts and their counts, not on their order, and parts can be added or taken away later:

* 4 lanes modulo 2^64 of uniform hash words, which make equal fingerprints mean equal multisets;
* 128 lanes modulo 2^16 of +1 or -1.  The mean square of the difference of two such vectors estimates how many parts differ;
* the number of parts modulo 2^32, by which that estimate is scaled to a likeness from 0 to 1.

Null texts count as empty (no part, all lanes 0).  Rows with equal ids are told apart by their text, rows without id come last.
Repeated rows, an empty table and columns of any other name are fine: only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_pass, ship, shuffle_partitions, texts

NEAR, STRONG = 128, 4


def parts(text: str) -> list[str]:
    return [p for line in text.split("\n") if line for p in line.replace(". ", ".\n").split("\n") if p]


class Multiset:
    """The sum of part vectors; ``add`` and ``remove`` undo one another."""

    __slots__ = ("count", "near", "strong")

    def __init__(self):
        self.near, self.strong, self.count = np.zeros(NEAR, np.int64), np.zeros(STRONG, np.uint64), 0

    def add(self, items: list[str], sign: int = 1) -> Multiset:
        if items:
            raw = np.frombuffer(b"".join([hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=NEAR // 8 + 8 * STRONG).digest() for p in items]), np.uint8).reshape(len(items), -1)
            ones = np.unpackbits(raw[:, : NEAR // 8], axis=1).sum(axis=0, dtype=np.int64)
            self.near = self.near + sign * (2 * ones - len(items))
            total = np.ascontiguousarray(raw[:, NEAR // 8 :]).view("<u8").sum(axis=0, dtype=np.uint64)
            self.strong = self.strong + total if sign > 0 else self.strong - total
            self.count += sign * len(items)
        return self

    def remove(self, items: list[str]) -> Multiset:
        return self.add(items, -1)

    def copy(self) -> Multiset:
        m = Multiset()
        m.near, m.strong, m.count = self.near, self.strong.copy(), self.count
        return m

    def hex(self) -> str:
        return np.array([self.count & 0xFFFFFFFF], ">u4").tobytes().hex() + self.strong.astype(">u8").tobytes().hex() + (self.near & 0xFFFF).astype(">u2").tobytes().hex()


def parse(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return int.from_bytes(raw[:4], "big"), np.frombuffer(raw[4 : 4 + 8 * STRONG], ">u8"), np.frombuffer(raw[4 + 8 * STRONG :], ">u2")


def likeness(n: int, m: int, near_a: np.ndarray, near_b: np.ndarray, same: bool) -> float:
    """1 - (parts in one but not in the other) / (all parts), estimated; 1 exactly for equal fingerprints."""
    if same:
        return 1.0
    d = (near_a.astype(np.int64) - near_b.astype(np.int64) + (1 << 15)) % (1 << 16) - (1 << 15)
    return float(min(1.0, max(0.0, 1.0 - float((d * d).mean()) / max(1, n + m))))


def like(a: Multiset, b: Multiset) -> float:
    return likeness(a.count, b.count, a.near, b.near, a.count == b.count and bool((a.strong == b.strong).all() and ((a.near - b.near) % (1 << 16) == 0).all()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_parts, fingerprint."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [Multiset().add(parts(t)) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.count for m in got], pa.int64()), pa.array([m.hex() for m in got], pa.string())], names=["doc_id", "n_parts", "fingerprint"])

    return arrow_pass(texts(docs, id_col, text_col), run, "doc_id long, n_parts long, fingerprint string")


def successors(docs: DataFrame) -> DataFrame:
    """``_part, _head, doc_id, text`` in partitions by ranges of doc_id, sorted, each range followed by a copy of the first rows of the next (after the last: of the first).

    One shuffle.  The range limits are approximate quantiles of the id column (one number per partition); so are the first ids.
    """
    n = shuffle_partitions(docs.sparkSession)
    ids = docs.select("doc_id")
    most, cuts = ids.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()
    cuts = sorted({c for c in cuts or [] if c < most}) if n > 1 else []
    last = len(cuts)
    part = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0))
    first = sorted((r[0], r[1]) for r in ids.select(part.alias("p"), "doc_id").groupBy("p").agg(F.min("doc_id")).collect())
    if not first:
        return docs.select(F.lit(0).alias("_part"), F.lit(0).alias("_head"), "doc_id", "text")
    before = [(first[i][1], first[i - 1][0]) for i in range(len(first))]  # the head of each range goes to the range before it
    here = F.struct(part.alias("_part"), F.lit(0).alias("_head"))
    to = F.create_map(*[F.lit(x) for pair in before if pair[0] is not None for x in pair]) if any(b[0] is not None for b in before) else None
    copy = F.when(F.col("doc_id").isNull(), F.lit(before[0][1]) if before[0][0] is None else F.lit(None)) if to is None else F.when(F.col("doc_id").isNotNull(), F.try_element_at(to, F.col("doc_id"))).otherwise(F.lit(None))
    there = F.struct(copy.cast("int").alias("_part"), F.lit(1).alias("_head"))
    rows = docs.select(F.explode(F.when(copy.isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_at"), "doc_id", "text").select("_at._part", "_at._head", "doc_id", "text")
    return rows.repartition(n, "_part").sortWithinPartitions("_part", "_head", F.col("doc_id").asc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """The last quarter of the code points gives way to as many first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every text, of its edited text (kept up incrementally: the changed parts are taken away and added) and the likeness to both neighbours."""

    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(i, text: str, mine: Multiset, after: str, other: Multiset) -> tuple:
        new = edited(text, after)
        keep = text.rfind("\n", 0, len(text) - len(text) // 4) + 1  # whole lines before the edit stay as they are
        changed = mine.copy().remove(parts(text[keep:])).add(parts(new[keep:]))
        return (i, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), mine.hex(), changed.hex(), like(mine, changed), like(mine, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, closed = None, False
        for b in batches:
            out = []
            for p, head, i, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0] == p and closed:
                    continue  # more rows with the id of the head
                if held and held[0] != p:
                    held = None
                mine = Multiset().add(parts(text))
                if held:
                    out.append(pair(*held[1:], text, mine))
                held, closed = (p, i, text, mine), bool(head)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ship(docs.sparkSession)
    return successors(texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
