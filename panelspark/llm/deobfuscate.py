"""Personal data with offset-preserving deobfuscation.

Plain identifiers (email, ip, card, phone) are found in the text itself.  Then the text runs through a chain of small transducers, each of which rewrites
pieces of it and keeps, for every character it writes, the source range it stands for: homoglyphs and invisible characters, spelled digits (four
languages), at/dot disguises.  The same detectors read the rewritten text; a finding that touches rewritten characters is mapped back to source characters
and added unless it overlaps a plain finding of its kind.

Positions are code points, ends exclusive.  Null texts count as empty; texts of any length are read whole, in time linear in their length; repeated rows
give repeated rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.common import arrow_pass, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like the Latin letter beside them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
INVISIBLE = "​‌‍⁠﻿­"
# Number words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TO_ASCII = str.maketrans(HOMOGLYPHS)
ODD = re.compile("[" + "".join(HOMOGLYPHS) + INVISIBLE + "０-９Ａ-Ｚａ-ｚ＠．＋－٠-٩۰-۹०-९𝟎-𝟿]")
NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Three number words or digits in a row at least, of which one is a word; "plus" may lead.
SPELLED = re.compile(rf"\b(?:plus[ -]+)?(?:(?:{NUMBER})\b|[0-9])(?:[ -]{{0,2}}(?:\b(?:{NUMBER}|dot|point|punkt|punto)\b|[0-9.]))+", re.I)
WORDY = re.compile(rf"[ -]*\b(plus|{NUMBER}|dot|point|punkt|punto)\b[ -]*", re.I)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
AT_BOXED = re.compile(rf"[ ]?{OPEN}[ ]?(?:at|ät|arroba|arobase|@)[ ]?{CLOSE}[ ]?", re.I)
DOT_BOXED = re.compile(rf"[ ]?{OPEN}[ ]?(?:dot|punkt|point|punto|\.)[ ]?{CLOSE}[ ]?", re.I)
#: name at host dot tld
AT_WORDS = re.compile(r"(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)*? dot [A-Za-z])", re.I)
DOT_WORDS = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.I)
DOT_HINT = re.compile(r" dot ", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: at each @ the run of local characters before it, back to the end of the match before."""
    out, free, i = [], 0, text.find("@")
    while i >= 0:
        a = i
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        if a < i and (m := DOMAIN.match(text, i + 1)):
            out.append((a, m.end()))
            free = m.end()
        else:
            free = max(free, i)  # no local part reaches over an @
        i = text.find("@", max(i + 1, free))
    return out


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Tape:
    """A rewritten text with the source range of each of its characters and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.stop, self.new = text, array("i", range(len(text))), array("i", range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the ranges (ascending, apart) by the strings; every new character stands for the whole range."""
        if not edits:
            return
        text, start, stop, new, at = [], array("i"), array("i"), bytearray(), 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            stop += self.stop[at:a]
            new += self.new[at:a]
            if put and b > a:
                text.append(put)
                start += self.start[a : a + 1] * len(put)
                stop += self.stop[b - 1 : b] * len(put)
                new += b"\1" * len(put)
            at = b
        self.text, self.start, self.stop, self.new = "".join(text), start, stop, new


def plain_character(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    d = unicodedata.digit(c, None)
    return str(d) if d is not None else unicodedata.normalize("NFKC", c)


def spell(part: str) -> str:
    return WORDY.sub(lambda m: "+" if (w := m[1].lower()) == "plus" else DIGIT_WORDS.get(w, "."), part).replace(" ", "")


def spelled(text: str) -> bool:
    """Whether a number word stands beside a digit or another word; one that only ends a sentence does not count."""
    return any(WORDY.search(m[0]) and len(spell(m[0]).rstrip(".")) > 1 for m in SPELLED.finditer(text))


def edits_of(text: str):
    """The transducers in order; each gets the text that the one before left."""
    if not text.isascii():
        yield lambda t: [(m.start(), m.end(), plain_character(m[0])) for m in ODD.finditer(t)]
    yield lambda t: [(*m.span(), "@") for m in AT_BOXED.finditer(t)]
    yield lambda t: [(*m.span(), ".") for m in DOT_BOXED.finditer(t)]
    yield lambda t: [(*m.span(), "@") for m in AT_WORDS.finditer(t)] if DOT_HINT.search(t) else []
    yield lambda t: [(*m.span(), ".") for m in DOT_WORDS.finditer(t)] if DOT_HINT.search(t) else []
    yield lambda t: [(*m.span(), spell(m[0])) for m in SPELLED.finditer(t) if WORDY.search(m[0])] if spelled(t) else []


BOX = re.compile(rf"{OPEN}[ ]?(?:at|ät|arroba|arobase|dot|punkt|point|punto|@|\.)[ ]?{CLOSE}", re.I)


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Findings that only the rewritten text shows, in source positions."""
    boxed = any(c in text for c in "[({<") and BOX.search(text)
    if not (boxed or DOT_HINT.search(text) or spelled(text) or (not text.isascii() and ODD.search(text))):
        return []
    tape = Tape(text)
    for find in edits_of(text):
        tape.rewrite(find(tape.text))
    if not any(tape.new):
        return []
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    near, end = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)  # the first plain finding that does not end before, the end of the last one added
    out = []
    for kind, a, b in detect(tape.text):  # ascending within a kind, as their source ranges are
        if any(tape.new[a:b]):
            x, y, plain = tape.start[a], tape.stop[b - 1], taken[kind]
            while near[kind] < len(plain) and plain[near[kind]][1] <= x:
                near[kind] += 1
            if x >= end[kind] and (near[kind] == len(plain) or plain[near[kind]][0] >= y):
                out.append((kind, x, y))
                end[kind] = y
    return out


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda f: (KINDS.index(f[0]), f[1], f[2])))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain findings), base_sha256, spans (all), n_disguised."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, sha, spans, more = {k: [] for k in KINDS}, [], [], []
        for t in b.column("text").to_pylist():
            base = detect(t)
            extra = disguised(t, base)
            for k in KINDS:
                counts[k].append(sum(f[0] == k for f in base))
            sha.append(hashlib.sha256((w := written(base)).encode()).hexdigest())
            spans.append(written(base + extra) if extra else w)
            more.append(len(extra))
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"],
        )

    return arrow_pass(texts(docs, id_col, text_col), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
