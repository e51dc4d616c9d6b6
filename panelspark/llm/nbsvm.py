"""Quality classifier: naive Bayes support vectors.

Features are indicators: the distinct n-grams of a text (bytes, 3 and 4 long, hashed to 2^20), and how varied they are (the share of distinct
4-grams among all, in tenths, for each power of four of the length).  Each is scaled by its log-count ratio between the classes;
a linear hinge-loss model over the scaled indicators (unit length) is fitted by dual coordinate descent; a logistic curve fitted on rows left out of
that fit turns margins into probabilities.

The fit reads at most ``max_rows`` labelled rows (those with the smallest hash of their id), so it is the same at any size of the table; scoring is one
pass over all documents.  A null text counts as empty and scores what an empty text scores; rows without label are scored as well; a null or other label
is no label; several labels of one id count by their mean (0.5 and over: 1).  Without labels, or with one class only, every score is the share of class 1
(0.5 if there is none).  Repeated rows give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_pass, texts

BITS = 20
MAX_ROWS = 8000
CHUNK = 1 << 20
#: Indicators that state the variety of a text; as many as give it weight beside the n-grams.
SPREAD = 24
SLOTS = (1 << BITS) + 16 * 11 * SPREAD


def grams(text: str) -> np.ndarray:
    """The distinct hashed byte 3-grams and 4-grams, ascending."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen: list[np.ndarray] = []
    for at in range(0, max(len(b) - 2, 0), CHUNK):
        c = b[at : at + CHUNK + 3].astype(np.uint32)
        three = c[:-2] | c[1:-1] << 8 | c[2:] << 16
        four = three[:-1] | c[3:] << 24
        both = np.concatenate((three * np.uint32(2654435761), four * np.uint32(2246822519) ^ np.uint32(0x5BD1E995)))
        seen.append(np.unique(both >> np.uint32(32 - BITS)))
    got = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0] if seen else np.zeros(0, np.uint32)
    # a text that says one thing again and again has few grams for its length; block: length in powers of 4, then the share in tenths
    n = max(1, 2 * len(b))
    block = (min(int(math.log(n, 4)), 15) * 11 + min(10, 10 * len(got) // n)) * SPREAD
    return np.concatenate((got, (1 << BITS) + np.arange(block, block + SPREAD, dtype=np.uint32)))


def pack(g: np.ndarray) -> bytes:
    """Ascending numbers as their gaps, one byte each, and one of 255 more for every 255 in a gap."""
    gap = np.diff(g.astype(np.int64), prepend=0)
    end = (gap // 255 + 1).cumsum()
    out = np.full(int(end[-1]) if len(g) else 0, 255, np.uint8)
    out[end - 1] = gap % 255
    return out.tobytes()


class Packed:
    """Rows of indicators that are unpacked when they are visited."""

    def __init__(self, parts: list[pa.Scalar]):
        self.parts = parts

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, at: int | np.ndarray) -> np.ndarray | Packed:
        if isinstance(at, np.ndarray):
            return Packed([self.parts[i] for i in at])
        if at >= len(self.parts):
            raise IndexError(at)
        b = np.frombuffer(self.parts[at].as_buffer(), np.uint8)
        return b.cumsum(dtype=np.uint32)[b < 255]


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times hinge weight
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, g: np.ndarray) -> float:
        norm = math.sqrt(float(np.square(self.ratio[g]).sum())) if len(g) else 0.0
        return (float(self.weights[g].sum()) / norm if norm else 0.0) + self.bias

    def score(self, g: np.ndarray) -> float:
        z = self.slope * self.margin(g) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(SLOTS, alpha), np.full(SLOTS, alpha)]
    for g, y in zip(rows, label, strict=True):
        counts[int(y)][g] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, c: float, passes: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """min 1/2 |w|^2 + c sum max(0, 1 - y w.x) over rows scaled to unit length, with a bias feature of 1; both classes get the same total weight.

    A row's values are taken from ``ratio`` when it is visited, so nothing is held beside its indicators.
    """
    w, bias = np.zeros(SLOTS), 0.0
    y, alpha = 2.0 * label - 1, np.zeros(len(rows))
    size = np.array([float(np.square(ratio[g], dtype=np.float64).sum()) ** 0.5 or 1.0 for g in rows])
    top = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            g = rows[i]
            v = ratio[g] / size[i]
            slack = y[i] * (float(w[g] @ v) + bias) - 1
            new = min(max(alpha[i] - slack / 2, 0.0), top[i])  # a row and its bias feature have squared length 2
            if step := (new - alpha[i]) * y[i]:
                w[g] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        r, q = t - p, p * (1 - p) + 1e-9
        h = np.array([[float((q * margins * margins).sum()) + 1e-3, float((q * margins).sum())], [float((q * margins).sum()), float(q.sum()) + 1e-3]])
        da, db = np.linalg.solve(h, [float((r * margins).sum()) - 1e-3 * a, float(r.sum()) - 1e-3 * b])
        a, b = a + float(np.clip(da, -3, 3)), b + float(np.clip(db, -3, 3))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], label: np.ndarray, c: float = 1.0, passes: int = 12) -> Model:
    none = np.zeros(SLOTS, np.float32)
    if len(set(label.tolist())) < 2:
        share = min(max(float(label.mean()), 1e-3), 1 - 1e-3) if len(label) else 0.5
        return Model(none, none, 0.0, 1.0, math.log(share / (1 - share)))
    ratio = log_count_ratio(rows, label)

    def one(at: np.ndarray) -> tuple[np.ndarray, float]:
        return dual_coordinate_descent(rows[at] if isinstance(rows, Packed) else [rows[i] for i in at], ratio, label[at], c, passes)

    out = np.arange(len(rows)) % 5 == 4
    if len(set(label[out].tolist())) < 2 or len(set(label[~out].tolist())) < 2:
        out = np.ones(len(rows), bool)
        w, bias = one(np.arange(len(rows)))
    else:
        w, bias = one(np.flatnonzero(~out))
    held = Model((w * ratio).astype(np.float32), ratio, bias, 1.0, 0.0)
    slope, shift = logistic(np.array([held.margin(rows[i]) for i in np.flatnonzero(out)]), label[out].astype(np.float64))
    return Model(held.weights, ratio, bias, slope, shift)


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.col(id_col).cast("string")) % 5) == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, label, grams of the rows of the fit; their ids (at most ``max_rows``, not held out) are broadcast."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("doc_id is not null and q in (0, 1)")
    chosen = marked.where(~held_out()).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([pack(grams(t)) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "label", "grams"])

    return arrow_pass(texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), run, "doc_id long, label int, grams binary")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on the rows of ``sample``: one task reads their n-grams and fits, the driver gets the model alone."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("grams"), b.column("label").to_numpy()) for b in batches]
        label = np.concatenate([y for _, y in held]).astype(np.int64) if held else np.zeros(0, np.int64)
        m = fit(Packed([g for c, _ in held for g in c]), label)
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "ratio": m.ratio.tobytes(), "bias": float(m.bias), "slope": float(m.slope), "shift": float(m.shift)}])

    got = sample(docs, labels, max_rows).repartition(1).sortWithinPartitions("doc_id", F.octet_length("grams"), "grams").mapInArrow(solve, "weights binary, ratio binary, bias double, slope double, shift double").first()
    if got is None:
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(got["weights"], np.float32), np.frombuffer(got["ratio"], np.float32), got["bias"], got["slope"], got["shift"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([shared.value.score(grams(t)) for t in b.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow_pass(texts(docs), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that score at least ``threshold``: one pass, no join, so rows without or with equal ids are judged by their own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        good = [shared.value.score(grams(t or "")) >= threshold for t in b.column(at).to_pylist()]
        return b.filter(pa.array(good, pa.bool_()))

    return arrow_pass(docs, run, docs.schema)
