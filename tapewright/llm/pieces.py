"""SentencePiece encoding that keeps every piece's place in the source, and decoding.

The text is normalised by the model's own compiled character map, longest prefix first, with the source byte of every byte of the normal
form (`charmap`). The ids are the library's. A piece covers as many bytes of the normal form as it spells, so running
sums of the pieces' lengths, sent through the alignment, give each piece's span of source bytes: spans follow one another
without a gap from the first byte to the last. The space that the model puts before the text has no source.

Ids of a model whose map is empty, that keeps spaces, and none of whose pieces has the space mark behind another character are
looked up by segments (`segments`); other models, and texts that hold the mark itself, are encoded whole.

Defined results: null and empty texts have no piece and decode to nothing. Rows keep their number, with null and repeated ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm.charmap import MARK, CharacterMap
from tapewright.llm.segments import SegmentCache, blocks, little_endian, mark_segments
from tapewright.llm.tables import whole_texts


class PieceEncoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            model = file.read()
        self.library = SentencePieceProcessor(model_proto=model)
        self.map = CharacterMap.of_model(model)
        mark = MARK.decode()
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        single = [self.library.is_byte(i) for i in range(len(pieces))]
        self.lengths = np.array([1 if one else len(p.encode()) for p, one in zip(pieces, single)], np.int64)
        self.unknown = self.library.unk_id()
        plain = not self.map.trie and not self.map.drop_spaces and self.map.add_space and self.map.mark_spaces
        self.by_segments = plain and any(single) and not any(mark in p.lstrip(mark) for p in pieces)
        self.segments = SegmentCache(self._learn)

    def _learn(self, parts: list[str]) -> Iterator[tuple[bytes, str]]:
        return map(_stored, self.library.encode(parts, num_threads=1))

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids of each text: as little-endian 32-bit bytes, and in decimal joined by commas."""
        mark = MARK.decode()
        for block in blocks(texts):
            cut = [mark_segments(t) if self.by_segments and mark not in t else None for t in block]
            known = self.segments.learn([parts for parts in cut if parts is not None])
            for text, parts in zip(block, cut):
                if parts is None:
                    yield _stored(self.library.encode(text))
                else:
                    found = [known[p] for p in parts]
                    yield b"".join([f[0] for f in found]), ",".join([f[1] for f in found])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in the source's bytes, of every piece."""
        normal, origin = self.map.normalise(text)
        sizes = self.lengths[ids]
        if len(ids) and (ids == self.unknown).any():
            # An unknown piece spells what it stands for, which only the library knows.
            found = self.library.encode(text, return_type="proto").pieces
            sizes = np.where(ids == self.unknown, [len(p.piece.encode()) for p in found], sizes)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces do not spell the normal form")
        return origin[ends - sizes], origin[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """The worker's own, which keeps its segments from task to task."""
    return PieceEncoder(path)


def _stored(ids: list[int]) -> tuple[bytes, str]:
    return little_endian(ids), ",".join(map(str, ids))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, starts, ends, decoded of every document; spans are in bytes of the text."""
    return _encoded(docs, model_path, ["ids array<int>", "starts array<long>", "ends array<long>", "decoded string"])


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, covered_bytes: digests of what encode_pieces gives.

    spans_sha256 is over the ends of all spans as little-endian 64-bit integers.
    """
    columns = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "spans_sha256 string", "covered_bytes long"]
    return _encoded(docs, model_path, columns)


def _encoded(docs: DataFrame, model_path: str, columns: list[str]) -> DataFrame:
    whole = columns[0].startswith("ids ")
    schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], _KINDS[c.split()[1]]) for c in columns)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            out = []
            for key, text, (stored, spelled) in zip(batch["doc_id"].to_pylist(), texts, encoder.encode(texts)):
                ids = np.frombuffer(stored, "<i4")
                starts, ends = encoder.spans(text, ids)
                decoded = encoder.decode(ids)
                if whole:
                    out.append((key, ids, starts, ends, decoded))
                else:
                    digests = (_sha(spelled.encode()), _sha(decoded.encode()), _sha(ends.astype("<i8").tobytes()))
                    out.append((key, len(ids), *digests, int((ends - starts).sum())))
            for at in range(0, len(out), 500):
                part = list(zip(*out[at : at + 500]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(part, schema)], schema=schema)

    return whole_texts(docs).mapInArrow(rows, "doc_id long, " + ", ".join(columns))


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
