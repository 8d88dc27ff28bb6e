"""Token ids of whole texts, by way of segments that tokenize independently and recur.

Invented or natural, a corpus repeats its words: encoding each distinct one once per worker is far cheaper than encoding the
texts. Both tokenizers here allow exact cuts.

- Byte-level BPE: the pre-tokenizer starts a new token at a lone space between two characters that are not white space, whatever
  stands around it, and never lets a token run across one. So a text may be cut before every such space. It also starts one where white space begins with
  a line end, and no token before that looks ahead. So a text may be cut before every line end behind another character.
- BPE pieces with a space mark: merges can't cross a space if no piece of the vocabulary has the mark behind another character.
  So a text may be cut before every lone space (runs of spaces stay with the word behind them).

The library itself encodes the segments; nothing of its rules is repeated here but where the cuts are. New segments of a byte-level BPE go to it
many to a call, joined by the spaces or line ends they were cut at: a token that begins with the space byte, or the first of those that begin with a line end,
begins a segment. A block's segments are numbered by Arrow, and only the distinct ones are looked up among those known; its ids are gathered from theirs by numpy.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct segments in each of a worker's two generations.
CACHE = 400_000
#: Distinct segments of byte-level BPE that a worker knows; beyond, it keeps those of the last block.
KNOWN = 1_000_000
#: Characters of text that are looked up together, and those of byte-level BPE.
BLOCK = 1_000_000
BYTE_BLOCK = 8_000_000
#: Segments that are encoded in one string.
JOINED = 256

#: What a byte-level BPE writes for the space byte and for the line end at the beginning of a token.
_SPACE_BYTE, _LINE_BYTE = "Ġ", "Ċ"
_OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_NO_SPACE = "[^" + "".join(rf"\x{{{ord(c):x}}}" for c in [" ", "\n", *_OTHER_SPACE]) + "]+$"
_LONE = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n))")
_MARK_LONE = re.compile(r"(?<! ) (?=[^ ])")


def byte_segments(text: str) -> tuple[str, str | list[str] | None]:
    """What stands before the first cut, and the other segments: those that begin with a line end have it, all others lack their leading space.

    They are a list if white space stands in other ways than as lone spaces and line ends, else one string with spaces between them.
    """
    if text.endswith(" ") or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACE):
        head, *rest = _LONE.split(text)
        return head, rest
    if "\n" in text:
        text = text.replace("\n", " \n")
        while "\n \n" in text:
            text = text.replace("\n \n", "\n\n")
    head, space, rest = text.partition(" ")
    return head, rest if space else None


def mark_segments(text: str) -> list[str]:
    """The text cut at lone spaces, for a tokenizer that puts a space before the text: every segment lacks its leading space."""
    if not text:
        return []
    spaced = " " + text
    if "  " in spaced or spaced.endswith(" "):
        parts = _MARK_LONE.split(spaced)
        return [parts[0][1:], *parts[1:]] if parts[0] else parts[1:]
    return text.split(" ")


class SegmentCache:
    """What `encode` makes of a list of distinct segments, remembered in two generations, so that frequent ones stay."""

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = CACHE):
        self.encode, self.most, self.known, self.older = encode, most, {}, {}

    def learn(self, documents: list[list[str]]) -> dict:
        """A dictionary that holds every segment of the documents."""
        missing = set(chain.from_iterable(documents)).difference(self.known)
        if len(self.known) + len(missing) > self.most:
            self.older, self.known = self.known, {}
            missing = set(chain.from_iterable(documents))
        if missing:
            again = missing.intersection(self.older)
            self.known.update((s, self.older[s]) for s in again)
            new = list(missing.difference(again))
            self.known.update(zip(new, self.encode(new)))
        return self.known


def blocks(texts: Iterable[str | None], most: int = BLOCK) -> Iterator[list[str]]:
    """The texts in order, some millions of characters at a time; null is empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def little_endian(ids: list[int]) -> bytes:
    """Ids as 32-bit integers."""
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library: ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.begins = {mark: np.zeros(max(vocabulary.values()) + 1, bool) for mark in (_SPACE_BYTE, _LINE_BYTE)}
        for mark, begins in self.begins.items():
            begins[[i for token, i in vocabulary.items() if token.startswith(mark)]] = True
        self.heads = SegmentCache(self._ids)
        self.known, self.ids = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.starts = self.sizes = np.empty(0, np.int64)

    def _ids(self, parts: list[str]) -> Iterator[bytes]:
        for found in self.library.encode_batch_fast(parts, add_special_tokens=False):
            yield little_endian(found.ids)

    def _learn(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, among which are those of the segments, and where each segment's start and how many they are."""
        places = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(pc.is_null(places))
        places = pc.fill_null(places, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        places[places < 0] = len(self.known) + np.arange(len(new))
        ids, starts, sizes = self._encoded(new)
        ids, starts = np.concatenate((self.ids, ids)), np.concatenate((self.starts, starts + len(self.ids)))
        sizes = np.concatenate((self.sizes, sizes))
        found = starts[places], sizes[places]
        if len(starts) > KNOWN:
            self.known, self.ids, self.sizes = distinct, _gathered(ids, *found), found[1]
            self.starts = np.cumsum(self.sizes) - self.sizes
        else:
            self.known, self.ids, self.starts, self.sizes = pa.concat_arrays([self.known, new]), ids, starts, sizes
        return ids, *found

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _learn, of segments that begin with a line end or that a space stands before."""
        spaced = pc.match_substring_regex(parts, "^" + _NO_SPACE).to_numpy(zero_copy_only=False)
        lines = pc.match_substring_regex(parts, r"^\n+" + _NO_SPACE).to_numpy(zero_copy_only=False)
        # With white space inside, a segment's end could belong together with what follows it.
        chosen = [np.flatnonzero(kind) for kind in (spaced, lines, ~(spaced | lines))]
        found = [*self._in_rows(parts.take(pa.array(chosen[0])), _SPACE_BYTE), *self._in_rows(parts.take(pa.array(chosen[1])), _LINE_BYTE)]
        found.append(self._alone(parts.take(pa.array(chosen[2]))))
        sizes = np.empty(len(parts), np.int64)
        starts = np.empty(len(parts), np.int64)
        order = np.concatenate(chosen)
        sizes[order] = np.concatenate([s for _, s in found])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids for ids, _ in found]), starts, sizes

    def _alone(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and the number of each one's."""
        held = list(self._ids([p if p[:1] == "\n" else " " + p for p in parts.to_pylist()]))
        return np.frombuffer(b"".join(held), "<u4"), np.array([len(h) // 4 for h in held], np.int64)

    def _in_rows(self, parts: pa.Array, mark: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As _alone, of segments that have no white space but where they begin, many to a string; a mark begins each."""
        space = "" if mark == _LINE_BYTE else " "
        firsts = [*range(0, len(parts), JOINED), len(parts)]
        lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), parts)
        rows = [space + row for row in pc.binary_join(lists, pa.scalar(space, parts.type)).to_pylist()]
        for first, last, found in zip(firsts, firsts[1:], self.library.encode_batch_fast(rows, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            begins = self.begins[mark][ids]
            if mark == _LINE_BYTE:
                begins[1:] &= ~begins[:-1]
            starts = np.flatnonzero(begins)
            if len(starts) == last - first and starts[0] == 0:
                yield ids, np.diff(starts, append=len(ids))
            else:
                yield self._alone(parts.slice(first, last - first))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for block in blocks(texts, BYTE_BLOCK):
            cut = [byte_segments(text) for text in block]
            # Texts in one string first, then those in lists.
            order = sorted(range(len(cut)), key=lambda i: isinstance(cut[i][1], list))
            lists = [cut[i][1] for i in order if isinstance(cut[i][1], list)]
            strings = [cut[i][1] for i in order[: len(order) - len(lists)]]
            segments = pa.concat_arrays(
                [pc.split_pattern(pa.array(strings, pa.large_string()), " "), pa.array(lists, pa.list_(pa.large_string()))]
            )
            ids, ends = self._texts([cut[i][0] for i in order], segments)
            found = [b""] * len(cut)
            for i, start, end in zip(order, [0, *ends], ends):
                found[i] = ids[start:end].tobytes()
            yield from found

    def _texts(self, heads: list[str], segments: pa.ListArray) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts, and where each text's end; a text is its head and the segments of its row."""
        numbered = segments.flatten().dictionary_encode()
        ids, starts, sizes = self._learn(numbered.dictionary)
        # Behind the distinct segments come the heads, each of which stands before its text's segments.
        first = list(map(self.heads.learn([heads]).__getitem__, heads))
        head_sizes = np.array([len(h) // 4 for h in first], np.int64)
        starts = np.concatenate((starts, len(ids) + np.cumsum(head_sizes) - head_sizes))
        sizes = np.concatenate((sizes, head_sizes))
        ids = np.concatenate((ids, np.frombuffer(b"".join(first), "<u4")))
        last = np.cumsum(pc.fill_null(pc.list_value_length(segments), 0).to_numpy(zero_copy_only=False)) + np.arange(len(heads))
        at = np.concatenate(([0], last[:-1] + 1))
        places = np.empty(len(numbered) + len(heads), np.int64)
        others = np.ones(len(places), bool)
        others[at] = False
        places[at] = len(numbered.dictionary) + np.arange(len(heads))
        places[others] = numbered.indices.to_numpy(zero_copy_only=False)
        held = sizes[places]
        return _gathered(ids, starts[places], held), np.cumsum(held)[last].tolist()


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at the starts, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())]


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """The worker's own, which keeps its segments from task to task."""
    return ByteTokenizer(path)
