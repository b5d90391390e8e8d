import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tierspan.llm import packing

TEXTS = ["Hello, world! It's a test.", "a  b   c", " lead and trail ", "\n\nnew\nlines\n", "", None, "tab\there\r\nx", "é ñ ç 漢字   nb", "x y", "a <|endoftext|> b", "1234 don't we'll", "word " * 700, "\x1c a\x1fb", " ", "\n", "q" * 5000]


def ids_of(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [2]


def pack32(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder()
    for text in TEXTS:
        assert encoder.packed(text or "") == pack32(ids_of(text)[:-1]), text


def test_encoder_equals_the_tokenizer_on_random_texts():
    rng = random.Random(8)
    encoder, tok = packing.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    atoms = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "'s", "'", "Hello", "the", "9", "123", "...", "#", "é", "ß", "漢字", "\U0001f600", "_", "-", "don't", "\x1c", "\x85", "e\u0301"]
    for _ in range(4000):
        text = "".join(rng.choices(atoms, k=rng.randint(0, 14)))
        assert encoder.packed(text) == pack32(tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_cut_puts_the_short_piece_first():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_plan_fills_without_gaps_and_nearly_best():
    rng = random.Random(1)
    for size, n in ((16, 200), (1024, 5000), (10, 0)):
        counts = {}
        for _ in range(n):
            k = min(size, max(1, int(rng.expovariate(3 / size))))
            counts[k] = counts.get(k, 0) + 1
        sequences, seen = {}, {}
        for length, a, b, first, offset in packing.plan(counts, size):
            seen.setdefault(length, []).append((a, b))
            for r in range(a, b):
                sequences.setdefault(first + r - a, []).append((offset, length))
        for length, spans in seen.items():
            assert [x for a, b in sorted(spans) for x in range(a, b)] == list(range(counts[length]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        total = sum(k * v for k, v in counts.items())
        assert len(sequences) <= 1.02 * total / size + 2


def test_pack_round_trip(spark):
    docs = spark.createDataFrame([(i % 9, t, 1, "b") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, piece int, length string")
    packed = packing.pack(docs, 64, keep_ids=True)
    rows = packed.collect()
    assert len(rows) == sum(len(packing.cut(len(ids_of(t)), 64)) for t in TEXTS) * 2
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["ids"]))
    made = {r[0]: pack32(r[1]) for r in packing.sequences(packed).collect()}
    assert made == {k: b"".join(x for _, x in sorted(v)) for k, v in by_sequence.items()}
    want = sorted(pack32(ids_of(t))[4 * s : 4 * (s + n)] for t in TEXTS * 2 for s, n in packing.cut(len(ids_of(t)), 64))
    assert sorted(r["ids"] for r in rows) == want
    assert all(sum(len(x) for _, x in v) <= 256 for v in by_sequence.values())


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
