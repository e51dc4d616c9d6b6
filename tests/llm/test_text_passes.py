"""Personal data, fingerprints and sentence pieces against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from panelspark.llm import deobfuscate, multiset_hash, pieces
from panelspark.llm.queries import QUERIES, piece_model
from tests.llm.common import ODD, clashing


def plain_findings(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    f = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    f += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    f += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return f + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_plain_findings():
    random.seed(3)
    for _ in range(20000):
        t = "".join(random.choice("a1.@@-+ 0(9)b%") for _ in range(random.randint(1, 60)))
        assert sorted(deobfuscate.detect(t)) == sorted(plain_findings(t))


def test_pii_query(spark, sf):
    text = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op7_pii"](spark, sf).collect():
        base = sorted(plain_findings(text[r["doc_id"]]), key=lambda f: (deobfuscate.KINDS.index(f[0]), f[1]))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert hashlib.sha256(said.encode()).hexdigest() == r["base_sha256"] and set(said.split(",")) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in deobfuscate.KINDS] == [sum(f[0] == k for f in base) for k in deobfuscate.KINDS]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail john [at] example [dot] com now", ["john [at] example [dot] com"]),
        ("mail john(at)example.com now", ["john(at)example.com"]),
        ("mail john dot doe at example dot com now", ["john dot doe at example dot com"]),
        ("jоhn@exаmple.com", ["jоhn@exаmple.com"]),
        ("call plus one five five five one two three four five six seven ok", ["plus one five five five one two three four five six seven"]),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs sieben an", ["plus vier neun drei null eins zwei drei vier fünf sechs sieben"]),
        ("４１１１ 1111 1111 1111", ["４１１１ 1111 1111 1111"]),
        ("ip one nine two dot one six eight dot one dot one", ["one nine two dot one six eight dot one dot one"]),
        ("an ordinary sentence at work. dot com, one two (at) all", []),
        ("plain a@b.com stays", []),
    ],
)
def test_disguises(text, want):
    found = deobfuscate.disguised(text, deobfuscate.detect(text))
    assert [text[a:b] for _, a, b in found] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("call +1 five 5 5 one 2 3 four 5 6 7 now", ["+1 five 5 5 one 2 3 four 5 6 7"]),
        ("call plus 1 five 5 five 0 one 0 two 3 four now", ["plus 1 five 5 five 0 one 0 two 3 four"]),
        ("ip one.2.3.four or 10 punkt 20 punkt 30 punkt 40", ["one.2.3.four", "10 punkt 20 punkt 30 punkt 40"]),
        ("4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one", ["4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"]),
        ("write to John At mail Dot example dOt Com now", ["John At mail Dot example dOt Com"]),
        ("John DOT Doe at example Dot com", ["John DOT Doe at example Dot com"]),
        ("one. Chapter 5 one", []),
    ],
)
def test_mixed_disguises(text, want):
    found = deobfuscate.disguised(text, deobfuscate.detect(text))
    assert [text[a:b] for _, a, b in found] == want


def test_very_many_findings_in_one_text():
    """Plain and disguised addresses by turns: every one is found at its place, none twice; a long text keeps 8 bytes a character besides itself."""
    parts, want, at = [], {"plain": [], "added": []}, 0
    for i in range(8000):
        for kind, form in (("added", f"user{i} [at] mail{i}.example.com"), ("plain", f"a{i}@x{i}.org")):
            parts.append(form + ", ")
            want[kind].append(("email", at, at + len(form)))
            at += len(form) + 2
    text = "".join(parts)
    base = deobfuscate.detect(text)
    assert base == want["plain"]
    began = time.process_time()
    assert deobfuscate.disguised(text, base) == want["added"]
    assert time.process_time() - began < 4
    tape = deobfuscate.Tape(text)
    assert tape.start.itemsize + tape.stop.itemsize == 8


def test_pii_odd_rows(spark):
    got = deobfuscate.find_personal_data(clashing(spark, [*ODD, (50, "9" * 60_000 + "a." * 20_000 + "@", "s")]))
    assert got.count() == len(ODD) + 1 and deobfuscate.find_personal_data(clashing(spark, [])).collect() == []


def neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return [(order[i], order[(i + 1) % len(order)]) for i in range(len(order))]


def check_fingerprints(rows, got):
    want = []
    for (i, t), (_, after) in neighbours(rows):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        whole = lambda x: multiset_hash.Multiset().add(multiset_hash.parts(x))
        a, b, c = whole(t), whole(new), whole(after)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), multiset_hash.like(a, b), multiset_hash.like(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fingerprint_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_document_fingerprints"](spark, sf).collect()
    check_fingerprints(rows, got)
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.3


def test_fingerprint_odd_rows(spark):
    for rows in (ODD, ODD[:1], ODD[3:4], [(i * 1000 - 5000, f"text {i}. and\nmore {i}", "s") for i in range(40)], [(None, "b", "s"), (None, "a a a a a", "s")]):
        check_fingerprints([(i, t) for i, t, _ in rows], multiset_hash.compare_with_next(clashing(spark, rows)).collect())
    assert multiset_hash.compare_with_next(clashing(spark, [])).collect() == []


def test_multiset_hash_is_homomorphic():
    a, b = ["x", "y", "x", "z"], ["q", "y"]
    m = multiset_hash.Multiset().add(a).add(b)
    assert m.hex() == multiset_hash.Multiset().add([*b, *reversed(a)]).hex() and m.copy().remove(b).hex() == multiset_hash.Multiset().add(a).hex()
    assert multiset_hash.Multiset().add(a).hex() != multiset_hash.Multiset().add(["x", "y", "z"]).hex()
    n, _, near = multiset_hash.parse(m.hex())
    assert n == 6 and len(near) == multiset_hash.NEAR


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(pieces.model_bytes(piece_model()))


def odd_texts():
    random.seed(1)
    fixed = ["", " ", "   a", "a  b\n\n c ▁ d▁▁e", "▁x", "<s> <unk> <0x0A> </s>", "\t\tx \r\n y", "日本語 テスト🙂", "\n", "\n\n a", "x " * 3, "word" * 4000, "\0a"]
    return fixed + ["".join(random.choice(" ▁\nabcé🙂the<>0x") for _ in range(random.randint(1, 60))) for _ in range(2000)]


def test_pieces_against_the_library(library, codec):
    for t in odd_texts():
        want = library.encode(t, add_bos=True, add_eos=True)
        ids, ends = codec.encode(t)
        assert ids.tolist() == want and codec.decode(want) == library.decode(want)
        spans = [(int(a), int(b)) for a, b in zip(ends[:-2], ends[1:-1], strict=True)]
        assert spans == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def test_remembered_bytes_are_bounded(library, codec, monkeypatch):
    """Long units without blanks that never come again: the memory starts afresh beyond its bytes, the ids stay those of the library."""
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 200_000)
    rng, most = random.Random(5), 0
    for _ in range(300):
        text = "\n".join("".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(150)) for _ in range(3))
        assert codec.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)
        most = max(most, codec.held)
    assert 200_000 < most < 220_000


def test_decoding_any_ids(library, codec):
    random.seed(4)
    for _ in range(2000):
        ids = [random.choice([random.randrange(32000), random.randrange(3, 259), random.randrange(3, 259)]) for _ in range(6)]
        assert codec.decode(ids) == library.decode(ids)


def test_character_map_is_followed(codec):
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    n = SentencePieceNormalizer(rule_name="nmt_nfkc")
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    other = pieces.PieceCodec(pieces.model_bytes(piece_model()))
    other.map = pieces.CharacterMap(m.normalizer_spec.precompiled_charsmap)
    for t in ("ﬁne ① ｆｕｌｌ　ｗｉｄｔｈ", "Å é ㌔", "abc"):
        norm, at = other.normalise(t)
        assert norm == n.normalize(t) and at[0] == at[1] == 0 and at[-1] == len(t.encode())
    ids, ends = other.encode("ﬁne")
    assert ids.tolist() == codec.encode("fine")[0].tolist() and ends[-1] == len("ﬁne".encode())


def test_piece_query_and_round_trip(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    for r in QUERIES["op10_sentencepiece"](spark, sf).collect():
        ids = library.encode(text[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    model = pieces.model_bytes(piece_model())
    back = {r[0]: r[1] for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert back == text
    odd = pieces.encode(clashing(spark, ODD), model)
    assert odd.count() == len(ODD) and {tuple(r["ids"]) for r in odd.where("doc_id < 2").collect()} == {(1, 2)} and pieces.encode(clashing(spark, []), model).collect() == []
