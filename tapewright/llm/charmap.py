"""A SentencePiece model's text normalisation with the source of every byte.

The model file holds a compiled character map: a double-array trie over UTF-8 prefixes, and the replacements it points to. At each place
the longest prefix in the map is replaced; where there is none, one character stays as it is. Then come the model's rules on
spaces: a space before the text, runs of spaces made one, spaces at the ends dropped, spaces marked. Beside the normal
form stands, for each of its bytes, the byte of the source it comes from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MARK = "▁".encode()


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; values are ints, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class CharacterMap:
    units: np.ndarray  # the trie; empty if the map is
    replacements: bytes
    add_space: bool = True
    drop_spaces: bool = True
    mark_spaces: bool = True

    @classmethod
    def of_model(cls, model: bytes) -> CharacterMap:
        """From a serialised model."""
        return cls.of_spec(dict(_fields(model)).get(3, b""))

    @classmethod
    def of_spec(cls, spec: bytes) -> CharacterMap:
        """From a serialised normalizer specification."""
        found = dict(_fields(spec))
        compiled = found.get(2, b"")
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        units = np.frombuffer(compiled[4 : 4 + size], "<u4")
        flags = (bool(found.get(n, 1)) for n in (3, 4, 5))
        return cls(units, compiled[4 + size :], *flags)

    def __post_init__(self):
        self.trie = self.units.tolist()
        self.starts = frozenset(b for b in range(256) if self.trie and self._step(self._offset(self.trie[0]), b) is not None)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """Place of the child's unit."""
        place = node ^ byte
        return place if place < len(self.trie) and self.trie[place] & 0x800000FF == byte else None

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix in the map that stands at a place, and what replaces it."""
        if not self.trie or source[at] not in self.starts:
            return None
        node, best = self._offset(self.trie[0]), None
        for n, byte in enumerate(source[at:], 1):
            place = self._step(node, byte)
            if place is None:
                break
            unit = self.trie[place]
            node = place ^ self._offset(unit)
            if unit >> 8 & 1:
                start = self.trie[node] & 0x7FFFFFFF
                best = n, self.replacements[start : self.replacements.index(0, start)]
        return best

    def normalise(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the normal form; the source byte of each, and the source's end behind them."""
        source = text.encode()
        if not self.trie and not self.drop_spaces:
            return self._spaces_only(source)
        chunks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(source):
            found = self.longest(source, at)
            if found is None:
                n = 1 if source[at] < 0x80 else 2 if source[at] < 0xE0 else 3 if source[at] < 0xF0 else 4
                found = n, source[at : at + n]
            chunks.append((found[1], at, at + found[0]))
            at += found[0]
        out, origin, end = bytearray(), [], len(source)
        space = MARK if self.mark_spaces else b" "
        if self.drop_spaces:
            while chunks and chunks[0][0] in (b"", b" "):
                chunks.pop(0)
        if chunks and self.add_space:
            out += space
            origin += [chunks[0][1]] * len(space)
        after_space = self.drop_spaces
        for replaced, start, _ in chunks:
            if after_space:
                replaced = replaced.lstrip(b" ")
            for part in _parts(replaced):
                put = space if part == b" " else part
                out += put
                origin += [start] * len(put)
            if replaced:
                after_space = self.drop_spaces and replaced.endswith(b" ")
        if self.drop_spaces:
            while out.endswith(space) and len(out):
                end = origin[-len(space)]
                del out[-len(space) :], origin[-len(space) :]
        return np.frombuffer(bytes(out), np.uint8), np.array([*origin, end], np.int64)

    def _spaces_only(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of an empty map: bytes stay, but for spaces and the one before the text."""
        if not source:
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        data = np.frombuffer(source, np.uint8)
        space = np.frombuffer(MARK if self.mark_spaces else b" ", np.uint8)
        width = np.where(data == 32, len(space), 1)
        first = len(space) if self.add_space else 0
        origin = np.concatenate((np.zeros(first, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]))
        out = np.repeat(data, width)
        ends = np.cumsum(width)[data == 32]
        for i, byte in enumerate(space):
            out[ends - len(space) + i] = byte
        return np.concatenate((space[: first], out)), origin


def _parts(replaced: bytes) -> list[bytes]:
    """Runs without a space, and single spaces, in order."""
    parts: list[bytes] = []
    for i, run in enumerate(replaced.split(b" ")):
        if i:
            parts.append(b" ")
        if run:
            parts.append(run)
    return parts
