"""Pieces, token counts and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import AWKWARD, awkward, rows_of
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from tokenizers import Tokenizer

from tapewright.llm import packing, pieces, tokencounts
from tapewright.llm.charmap import CharacterMap
from tapewright.llm.segments import SegmentCache, byte_tokenizer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "ß", "日", "😀", "▁", "<s>", "<|endoftext|>", "'s", "12", "!?", " ", "​"]
PARTS += ["\x00", "\x1f", "\x85", "ｱ", "ﾊﾟ", "①", "\r\n", "　", "İ", "ſ", "𝐀", "א", "́", "﻿"]


@pytest.fixture(scope="module")
def strange():
    chosen = random.Random(5)
    return ["".join(chosen.choice(PARTS) for _ in range(chosen.randint(0, 25))) for _ in range(4000)]


def test_segmented_ids_are_the_librarys(strange):
    library = SentencePieceProcessor(model_file=PIECES)
    encoder = pieces.PieceEncoder(PIECES)
    assert encoder.by_segments
    for text, (ids, spelled) in zip(strange, encoder.encode(strange)):
        want = library.encode(text)
        assert np.frombuffer(ids, "<i4").tolist() == want and spelled == ",".join(map(str, want))
    library = Tokenizer.from_file(BYTES)
    for text, ids in zip(strange, byte_tokenizer(BYTES).encode(strange)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_spans_follow_the_source(strange):
    encoder = pieces.PieceEncoder(PIECES)
    for text in strange[:1500]:
        found = encoder.library.encode(text, return_type="proto").pieces
        starts, ends = encoder.spans(text, np.array([p.id for p in found], int))
        if found:
            assert starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()
        for piece, start, end in zip(found, starts, ends):
            assert encoder.library.is_byte(piece.id) or (piece.begin, piece.end) == (start, end)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
def test_character_map_normalises_as_the_library(rule, strange):
    library = SentencePieceNormalizer(rule_name=rule)
    spec = library.serialized_normalizer_spec
    own = CharacterMap.of_spec(spec() if callable(spec) else spec)
    for text in strange[:1500]:
        normal, origin = own.normalise(text)
        assert bytes(normal).decode() == library.normalize(text)
        assert len(origin) == len(normal) + 1 and (np.diff(origin) >= 0).all()


def test_segment_cache_forgets_and_stays_right():
    cache = SegmentCache(lambda parts: [p.upper() for p in parts], most=4)
    for n in range(50):
        words = [f"w{n % 7}", "often", f"x{n}"]
        known = cache.learn([words])
        assert all(known[w] == w.upper() for w in words) and len(known) <= 4


def test_encoded_rows(spark):
    library = SentencePieceProcessor(model_file=PIECES)
    found = pieces.piece_digests(awkward(spark), PIECES)
    want = []
    for key, text in AWKWARD:
        ids = library.encode(text or "")
        decoded = library.decode(ids) if ids else ""
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        want.append((key, len(ids), *digests, len((text or "").encode())))
    order = lambda row: tuple((x is not None, str(x)) for x in row)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes") == sorted(want, key=order)
    whole = pieces.encode_pieces(awkward(spark), PIECES).where("doc_id = 10").first()
    assert whole.decoded == AWKWARD[-1][1].replace("▁", " ") and whole.ends[-1] == len(AWKWARD[-1][1].encode())
    assert pieces.piece_digests(awkward(spark, []), PIECES).count() == 0


def test_counts_come_from_the_cache(spark, work):
    library = Tokenizer.from_file(BYTES)
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in AWKWARD]
    order = lambda row: tuple((x is not None, str(x)) for x in row)
    docs, cache = awkward(spark), work + "/cache"
    for _ in range(2):
        assert rows_of(tokencounts.count_tokens(docs, BYTES, cache), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=order)
        # Each distinct text once, the row repeated with its id twice; nothing in the second run.
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in AWKWARD}) + 1
    # What is stored is used: a changed count shows.
    name = tokencounts.tokenizer_digest(BYTES)
    row = [(name, bytearray(hashlib.sha256(b"word").digest()), 99)]
    spark.createDataFrame(row, tokencounts.SCHEMA).write.parquet(work + "/other")
    found = tokencounts.count_tokens(docs.where("doc_id = 5"), BYTES, work + "/other")
    assert found.first().n_tokens == 99
    # Another tokenizer has its own counts.
    library = SentencePieceProcessor(model_file=PIECES)
    found = tokencounts.count_tokens(docs.where("doc_id = 5"), PIECES, work + "/other")
    assert found.first().n_tokens == len(library.encode("word"))
    assert tokencounts.count_tokens(awkward(spark, []), BYTES, work + "/none").count() == 0


def test_pieces_have_binary_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 4096):
        cut = packing.binary_pieces(n)
        assert sum(length for _, length in cut) == n and all(length & (length - 1) == 0 and length <= 2048 for _, length in cut)
        assert [s for s, _ in cut] == list(np.cumsum([0] + [length for _, length in cut])[:-1])


def test_packing_keeps_every_id(spark, work):
    library = Tokenizer.from_file(BYTES)
    docs = awkward(spark)
    packed = packing.pack(docs, BYTES).cache()
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    held = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        held.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    ids = sorted(i for r in rows for i in r.ids)
    assert ids == sorted(i for _, t in AWKWARD for i in [*library.encode(t or "", add_special_tokens=False).ids, 1])
    eight = sorted(held[(8, len(library.encode(AWKWARD[7][1]).ids) + 1)], key=lambda r: r.start)
    assert [i for r in eight for i in r.ids] == [*library.encode(AWKWARD[7][1]).ids, 1]
    # Sequences of one length are one range of ids.
    by_id = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_id == sorted(by_id)
    packing.write_buckets(packed, work + "/buckets")
    assert spark.read.parquet(work + "/buckets").count() == len(rows)
    assert packing.pack(awkward(spark, []), BYTES, with_ids=False).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTES, longest=1000)


def test_segments_encoded_together_are_those_encoded_alone():
    """Words with marks, letters of two blocks, white space of all kinds, the tokenizer's special string."""
    from tapewright.llm.segments import ByteTokenizer, little_endian

    chosen = random.Random(1)
    parts = ["a", "word", "é", "ß", "ǅ", "ɐ", "ʰ", "ำ", "Ġ", "😀", "1", ".", ",", "!", ":", ";?", "'s", "'", "x.y", "<|endoftext|>", "<|end"]
    parts += [" ", " ", " ", "  ", "\n", "\t", "\x1c", " ", "　"]
    texts = ["".join(chosen.choice(parts) for _ in range(chosen.randint(0, 25))) for _ in range(20_000)]
    tokenizer = ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    alone = [little_endian(found.ids) for found in tokenizer.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(tokenizer.encode(texts)) == alone
    assert list(tokenizer.encode(texts)) == alone


def test_few_segments_go_to_the_library_however_lines_meet(monkeypatch):
    """Words of two lines are known apart, and a known segment is not encoded again; what is forgotten is encoded anew."""
    from tapewright.llm import segments

    words = [f"{a}{b}" for a in ("alpha", "beta", "né", "<|endoftext|>", "1", "!") for b in ("", "x", "y.", "<|endoftext|>")]
    texts = [f"so {a}{end}{b} is" for a in words for b in words for end in ("\n", "\n\n", "\n\n\n")]
    texts += ["\n", "\n\n", "\nx", "x\n", " \nx y", "x \ny", "\t\n\nx\ty \n", None, ""]
    tokenizer = segments.ByteTokenizer(BYTES)
    alone = [segments.little_endian(found.ids) for found in tokenizer.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert list(tokenizer.encode(texts)) == alone
    assert len(tokenizer.known) < 5 * len(words)
    seen = []
    encoded = tokenizer._encoded
    monkeypatch.setattr(tokenizer, "_encoded", lambda parts: seen.append(len(parts)) or encoded(parts))
    assert list(tokenizer.encode(texts)) == alone and seen == [0]
    monkeypatch.setattr(segments, "KNOWN", 50)
    monkeypatch.setattr(segments, "BYTE_BLOCK", 2_000)
    assert list(tokenizer.encode(texts + texts)) == alone + alone and sum(seen) > 50
