"""Token ids of whole texts by the tokenizers library, remembered by piece.

Both vocabularies split a text before they merge: no token crosses a single blank or line feed that stands between two
other characters, nor the place between an ASCII letter and a comma or full stop, and no special token holds any of
them. So the bytes of a whole batch are cut there at once, Arrow finds the distinct pieces, the library encodes each
piece that this worker has not met yet, and ids are gathered by index. Texts repeat most pieces, which makes this many
times faster than encoding them whole. The ids are those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: like there, the string of a special token in a text
gives its id, unless ``special_as_text`` asks for ordinary text.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut needs neighbours that are surely no white space: ASCII signs, or letters of U+00C0 to U+07FF in two bytes.
_ASCII = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
_LEAD = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF)
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
#: Pieces that a worker remembers, about 250 bytes each, and the bytes of the longest such piece.
_MOST_PIECES, _LONGEST = 1_000_000, 64
#: Bytes of text that are cut at once.
_PART = 4 << 20


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in slices of about ``_PART`` bytes, of at least one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        held = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, held + _PART, side="right")))
        yield texts.slice(at, end - at)
        at = end


class PieceEncoder:
    """``encode(texts, end_id)`` gives the ids of all texts in a row, each with its end id, and where each one begins."""

    def __init__(self, path: str, *, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._known: dict[bytes, int] = {}
        #: Ids of the known pieces in a row; where each piece begins, and after the last one the end.
        self._ids, self._from = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.fill_null(texts, "").cast(pa.large_binary())
        ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        first, ends = int(ends[0]), ends - ends[0]
        if not ends[-1]:
            return np.full(len(whole), end_id, np.uint32), np.arange(len(whole) + 1)
        data = np.frombuffer(whole.buffers()[2], np.uint8)[first : first + int(ends[-1])]
        starts = self._cuts(data, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        slot = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        n = self._from[slot + 1] - self._from[slot]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.arange(upto[-1]) + np.repeat(self._from[slot] - upto[:-1], n)]
        at = upto[np.searchsorted(starts, ends)]
        return np.insert(ids, at[1:], end_id), at + np.arange(len(at))

    @staticmethod
    def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin: at the start of each text that is not empty, and at each safe place."""
        gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
        gap = gap[(gap > 1) & (gap < len(data) - 1)]
        before, after = data[gap - 1], data[gap + 1]
        safe = (_ASCII[before] | ((before >= 0x80) & (before < 0xC0) & _LEAD[data[gap - 2]])) & (_ASCII[after] | _LEAD[after])
        # The byte after a text's last one belongs to another text.
        last = np.zeros(len(data) + 1, bool)
        last[ends] = True
        safe &= ~last[gap + 1]
        begins = np.zeros(len(data), bool)
        begins[gap[safe]] = True
        mark = np.flatnonzero((data == 0x2C) | (data == 0x2E))
        begins[mark[(mark > 0) & _LETTER[data[mark - 1]]]] = True
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        return np.flatnonzero(begins)

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        """The place of each distinct piece. New ones are encoded; those to remember come first behind the known ones."""
        count = len(self._known)
        found = np.fromiter(map(self._known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            new = sorted(new.tolist(), key=lambda k: len(pieces[k]) > _LONGEST)
            own = [pieces[k] for k in new]
            made = [e.ids for e in self._tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in own], add_special_tokens=False)]
            ends = self._from[count] + np.cumsum(list(map(len, made)))
            self._from, self._ids = _room(self._from, count + len(made) + 1), _room(self._ids, int(ends[-1]))
            self._ids[self._from[count] : ends[-1]] = np.fromiter(chain.from_iterable(made), np.uint32)
            self._from[count + 1 : count + len(made) + 1] = ends
            found[new] = np.arange(count, count + len(made))
            # Frequent pieces come early; once full, others are encoded again where they occur.
            short = bisect_left(own, True, key=lambda p: len(p) > _LONGEST)
            self._known.update(zip(own[: min(short, max(0, _MOST_PIECES - count))], range(count, count + len(made)), strict=False))
        return found


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that tasks share what it remembers."""
    return PieceEncoder(path)
