"""Content-defined anchors: every string of ``length`` bytes holds one, chosen by its own bytes alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LENGTH, GRAM = 200, 64
#: Bytes that are hashed at a time; positions in such a segment fit in 20 bits.
SEGMENT = 1 << 19
POSITION = (1 << 20) - 1


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, m, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


MULTIPLIER = 0x5851F42D4C957F2D
_SIZE = SEGMENT + LENGTH + 1
POWER, INVERSE = _powers(MULTIPLIER, _SIZE), _powers(pow(MULTIPLIER, -1, 1 << 64), _SIZE)
BYTE = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, from running minima of blocks of ``w`` in either direction."""
    n = len(a)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = a
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


@dataclass
class Runs:
    """Windows lo..hi of a segment share the anchor at ``lo + off``; ``gram`` and ``span`` hash the anchor and the bytes lo..hi + LENGTH."""

    gram: np.ndarray
    span: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    off: np.ndarray


def runs(data: np.ndarray, ends: list[int]) -> Runs:
    """``data``: bytes of texts end to end (a segment); ``ends``: where each stops.  Windows do not cross the ends."""
    n = len(data)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * POWER[:n], out=h[1:])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return Runs(none, none, none, none, none)
    gram = mix((h[GRAM:] - h[:-GRAM]) * INVERSE[: n - GRAM + 1])
    m = n - GRAM + 1
    least = sliding_least((gram & ~np.uint64(POSITION)) | np.arange(m, dtype=np.uint64), LENGTH - GRAM + 1)
    valid = np.ones(n - LENGTH + 1, bool)
    for e in ends:
        valid[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return Runs(none, none, none, none, none)
    anchor = (least[at] & np.uint64(POSITION)).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.logical_or(anchor[1:] != anchor[:-1], at[1:] != at[:-1] + 1, out=new[1:])
    first = np.flatnonzero(new)
    lo, hi, x = at[first], at[np.append(first[1:], len(at)) - 1], anchor[first]
    span = mix((h[hi + LENGTH] - h[lo]) * INVERSE[lo] + (hi - lo).astype(np.uint64))
    return Runs(gram[x].view(np.int64), span.view(np.int64), lo, hi, x - lo)
