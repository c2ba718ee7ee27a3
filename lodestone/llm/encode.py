"""Token ids by the tokenizers library, each distinct piece of text encoded once a worker.

A text is cut where every supported pre-tokenizer cuts it too: before a single
space between visible characters, and where letters, digits and ASCII marks
meet. Next to an apostrophe, a run of white space or any character whose class
isn't known here there is no cut, so a piece is always a whole number of
pre-tokens with all that the library looks at. Texts that hold the string of a
special token are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from . import text as X

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces kept by a worker; beyond it the cache starts anew, and it goes with its encoder when a task of another kind begins.
CACHE = 1_000_000

_SPACE, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[range(0x30, 0x3A)] = _DIGIT
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = _MARK


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; U+00C0 to U+00FF but for the two signs among them are letters, what isn't known is 0."""
    out = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = _LETTER
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces, every row's start among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(data)
    seen = kind > _SPACE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = edge[:n].copy()
    inner = np.flatnonzero((kind[1:-1] == _SPACE) & seen[:-2] & seen[2:] & ~edge[1 : n - 1] & ~edge[2:n]) + 1
    cut[inner] = True
    cut[inner[data[inner] != 0x20] + 1] = True
    cut[1:] |= seen[1:] & seen[:-1] & (kind[1:] != kind[:-1])
    return np.flatnonzero(cut)


class Encoder:
    """``encode`` gives the ids of a string column and where each row's begin."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.end = config["model"].get("end_of_word_suffix") or ""
        self.bytewise = "ByteLevel" in json.dumps(config["pre_tokenizer"]) and (self.end or not config["normalizer"])
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.width[i] = token.endswith(self.end) if self.end else len(token)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _joined(self, pieces: list[str], units: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain pieces out of one text that has them apart, cut again where their units end.

        A unit is a byte or, where tokens mark the end of a word, a word.
        """
        sep = " " if self.end else "\n"
        ids = np.array(self.tokenizer.encode_batch_fast([sep.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        if not len(ids) or int(ids.max()) >= len(self.width):
            return None
        done = np.cumsum(self.width[ids])
        ends = np.cumsum(units + (not self.end)) - (not self.end)
        if done[-1] != ends[-1]:
            return None
        last = np.searchsorted(done, ends)
        first = np.concatenate([[0], last[:-1] + 1 + (not self.end)])
        if (done[last] != ends).any() or (first > last).any():
            return None
        lengths = last + 1 - first
        if not self.end:
            ids = np.delete(ids, last[:-1] + 1)
        return ids, lengths

    def _add(self, pieces: list[str], units: np.ndarray | None) -> None:
        found = self._joined(pieces, units) if units is not None else None
        if found is None:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter(chain.from_iterable(each), np.uint32, int(lengths.sum()))
        else:
            flat, lengths = found
        n = len(self.known)
        for name, more in (("flat", self.size + len(flat)), ("start", n + len(lengths)), ("length", n + len(lengths))):
            old = getattr(self, name)
            if len(old) < more:
                setattr(self, name, np.concatenate([old, np.zeros(max(more - len(old), len(old)), old.dtype)]))
        self.flat[self.size : self.size + len(flat)] = flat
        self.start[n : n + len(lengths)] = self.size + np.cumsum(lengths) - lengths
        self.length[n : n + len(lengths)] = lengths
        self.size += len(flat)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def places(self, pieces: list[str]) -> list[int]:
        """Places of a few pieces."""
        new = [x for x in dict.fromkeys(pieces) if x not in self.known]
        if len(self.known) + len(new) > CACHE:
            self._clear()
            new = list(dict.fromkeys(pieces))
        if new:
            self._add(new, None)
        return [self.known[x] for x in pieces]

    def pieces(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place in the tables of each piece of ``data`` that starts at ``at``."""
        if not len(at):
            return np.zeros(0, np.int64)
        ends = np.append(at, len(data)).astype(np.int32)
        col = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = col.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) + len(names) > CACHE:
            self._clear()
        place = np.fromiter(map(self.known.get, names.tolist(), repeat(-1)), np.int64, len(names))
        at = np.flatnonzero(place < 0)
        if len(at):
            units = self._units(col.dictionary.take(pa.array(at)))
            for plain in (True, False):
                some = at[(units > 0) == plain]
                for i in range(0, len(some), 20_000):
                    new = some[i : i + 20_000]
                    place[new] = len(self.known) + np.arange(len(new))
                    self._add(names[new].tolist(), units[units > 0][i : i + 20_000] if plain else None)
        return place[col.indices.to_numpy()]

    def _units(self, pieces: pa.Array) -> np.ndarray:
        """Units of each plain piece: a run of one known class, a space before it at most; 0 for any other."""
        data, offsets = X.raw(pieces)
        first, size = offsets[:-1], np.diff(offsets)
        if not self.bytewise:
            return np.zeros(len(first), np.int64)
        kind = classes(data)
        other = kind <= _SPACE
        space = data[first] == 0x20
        odd = np.concatenate([[0], np.cumsum(other)])
        plain = (odd[offsets[1:]] - odd[first] == space) & (size > space)
        words = np.where(kind[offsets[1:] - 1] == _DIGIT, size - space, 1)
        return np.where(plain, words if self.end else size, 0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = X.strings(column)
        data, offsets = X.raw(column)
        whole = self._whole(data, offsets)
        if len(whole):
            rows = column.to_pylist()
            parts = self.encode(pa.array(["" if i in whole else t for i, t in enumerate(rows)], column.type))
            split = [parts[0][a:b] for a, b in zip(parts[1][:-1], parts[1][1:], strict=True)]
            for i in whole:
                split[i] = np.array(self.tokenizer.encode(rows[i], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(split), np.concatenate([[0], np.cumsum([len(s) for s in split])])
        at = cuts(data, offsets)
        piece = self.pieces(data, at)
        lengths = self.length[piece]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.start[piece] - total[:-1], lengths)]
        return ids, total[np.searchsorted(at, offsets)]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Rows with the string of a special token in any case."""
        low, out = X.LOWER[data].tobytes(), set()
        for s in self.special:
            at = low.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(s) <= offsets[row + 1]:
                    out.add(row)
                at = low.find(s, at + 1)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Encoder, pa.RecordBatch]]:
    """Blocks of a task's batches with the encoder, which keeps its pieces for the next task of this kind."""
    for block in X.blocks(batches, "text", keep=True):
        yield encoder(path), block


def _forget() -> None:
    if _encoders:
        _encoders.clear()
        X.release()


X.caches.append(_forget)
