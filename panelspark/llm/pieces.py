"""SentencePiece (BPE with byte fallback) encoding with byte spans in the source, and decoding.

The text is normalised by the longest prefix that the model's compiled character map holds, and every normalised character keeps
the source bytes it came from.  The normalised text is cut where no piece can reach across (before a run of word marks, around a
line feed, which no piece holds); the library merges a unit once per task and the result is remembered, so most units are one look-up.
The running sum of the piece lengths, read through the alignment, gives each piece's byte span in the original text.

Nulls count as empty texts, an empty text has only the begin and end ids, repeated rows give repeated rows, an empty table an
empty result, other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.common import arrow_pass, texts

MARK = "▁"
#: Entries, and bytes of units and ids with 200 for each entry, that a task remembers before it starts afresh; bounds its memory.
REMEMBERED, REMEMBERED_BYTES = 300_000, 1 << 27


codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose values are offsets into a pool of zero-ended strings."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units, self.pool = np.frombuffer(blob[4 : 4 + n], "<u4").tolist(), blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest mapped prefix at ``at`` and its replacement; (0, b'') if none."""
        u, best = self.units, (0, b"")
        if not u:
            return best

        def offset(x: int) -> int:
            return (x >> 10) << ((x & 512) >> 6)

        node = offset(u[0])
        for i in range(at, len(data)):
            node ^= data[i]
            x = u[node]
            if x & 0x800000FF != data[i]:
                break
            node ^= offset(x)
            if x >> 8 & 1:
                start = u[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.pool[start : self.pool.index(b"\0", start)])
        return best


class PieceCodec:
    """Encoder and decoder of one model, built from the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("made for BPE models with byte fallback, a leading word mark and kept blanks")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.pieces = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        normal = [p.piece for p in m.pieces if p.type == 1]
        if any(k in (4, 5) for k in self.kind):
            raise ValueError("user-defined and unused pieces are not handled")
        self.byte_of = np.array([int(p.piece[3:5], 16) if p.type == 6 else -1 for p in m.pieces], np.int64)
        self.width = np.array([1 if p.type == 6 else len(p.piece) if p.type == 1 else 0 for p in m.pieces], np.int64)
        self.bos, self.eos = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        if MARK not in normal or any("\n" in p or MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("made for models none of whose pieces goes on over a line feed or holds a word mark after another character")
        self.unit = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        spec.precompiled_charsmap, spec.name = b"", "identity"  # what it gets is normalised already
        self.library = SentencePieceProcessor(model_proto=m.SerializeToString())
        mark = self.library.piece_to_id(MARK)
        self.feed = next(i for i, p in enumerate(m.pieces) if p.type == 6 and p.piece == "<0x0A>")
        self.always = {"": b"", MARK: struct.pack("<I", mark), "\n": struct.pack("<I", self.feed)}
        self.begin, self.end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in m.pieces]
        self.known, self.held = dict(self.always), 0

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text with its leading mark, and for each of its characters (and the end) the source byte it starts at."""
        data = text.encode("utf-8", "replace")
        out, at, i = [MARK], [0], 0
        while i < len(data):
            n, new = self.map.longest(data, i)
            if not n:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = data[i : i + n]
            for c in new.decode("utf-8", "replace"):
                out.append(MARK if c == " " else c)
                at.append(i)
            i += n
        return "".join(out), np.array([*at, len(data)], np.int64)

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of new units.  The library merges them all in one text, a line feed before each and after the last, at whose id the result is cut."""
        ids = np.array(self.library.encode("\n" + "\n".join(new).replace(MARK, " ") + "\n"), "<u4")
        raw, at = ids.tobytes(), (4 * np.flatnonzero(ids == self.feed)).tolist()
        self.known.update(zip(new, [raw[i + 4 : j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        self.held += len(raw) + 4 * sum(map(len, new)) + 200 * len(new)

    def covered(self, ids: np.ndarray) -> np.ndarray:
        """Normalised characters up to the end of each piece; of a character's byte pieces only the last covers it."""
        byte = self.byte_of[ids]
        n = self.width[ids]
        inner = byte >= 0
        if inner.any():
            n[:-1] -= inner[:-1] & ((byte[1:] & 0x1C0) == 0x80)
        return n.cumsum()

    def decode(self, ids: list[int]) -> str:
        """Begin and end ids vanish, word marks become blanks, the leading one goes; bytes that form no character become U+FFFD each."""
        first = next((i for i in ids if self.kind[i] != 3), None)
        raw = b"".join([self.surface[i] for i in ids])
        raw = raw[1:] if first is not None and self.pieces[first].startswith(MARK) else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "each_byte")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end, and the source byte at which each piece ends."""
        if not text:
            return np.array([self.bos, self.eos], "<u4"), np.zeros(2, np.int64)
        ends = None
        if not self.map.units and text[0] != " " and "  " not in text and MARK not in text:
            units = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        else:
            norm, ends = self.normalise(text)
            units = self.unit.findall(norm)
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known, self.held = dict(self.always), 0
        known = self.known
        got = list(map(known.get, units))
        if None in got:
            self.learn(list({u for u, g in zip(units, got, strict=True) if g is None}))
            got = [known[u] if g is None else g for u, g in zip(units, got, strict=True)]
        ids = np.frombuffer(b"".join((self.begin, *got, self.end)), "<u4")
        stops = self.covered(ids[1:-1])
        if ends is not None:
            stops = ends[stops]
        elif text.isascii():
            stops -= 1
        else:
            wide = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            stops = np.concatenate(([0, 0], np.cumsum(1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF), dtype=np.int64)))[stops]
        return ids, np.concatenate(([0], stops, stops[-1:]))


def model_bytes(path: str) -> bytes:
    """The model file, read once where the job is declared and sent to the tasks (under 1 MB)."""
    return Path(path).read_bytes()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (begin and end included), piece_ends (source byte at which each piece ends; it starts where the one before ends)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    codec: list[PieceCodec] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not codec:
            codec.append(PieceCodec(shared.value))
        rows = [codec[0].encode(t) for t in b.column("text").to_pylist()]
        off = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([r[k] for r in rows]).astype(t))) for k, t in ((0, np.int32), (1, np.int64))]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], names=["doc_id", "ids", "piece_ends"])

    return arrow_pass(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>, piece_ends array<long>")


def encode_digest(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of the piece ends as 64-bit integers): ``encode`` with its lists digested in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    codec: list[PieceCodec] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not codec:
            codec.append(PieceCodec(shared.value))
        n, cols = [], ([], [], [])
        for t in b.column("text").to_pylist():
            ids, ends = codec[0].encode(t)
            back = codec[0].decode(ids.tolist())
            n.append(len(ids))
            for out, raw in zip(cols, (ids.tobytes(), back.encode("utf-8", "replace"), ends.astype("<i8").tobytes()), strict=True):
                out.append(hashlib.sha256(raw).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in cols)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return arrow_pass(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that its ids stand for; a null or empty list gives an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    codec: list[PieceCodec] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not codec:
            codec.append(PieceCodec(shared.value))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([codec[0].decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return arrow_pass(encoded.select(id_col, ids_col), run, "doc_id long, text string")
