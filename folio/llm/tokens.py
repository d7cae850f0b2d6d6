"""Encoding with a file of the tokenizers library, piece by piece through a cache.

A byte-level BPE that splits its text before merging never joins across a
single space or line feed that stands between two characters that are no white
space, nor between a letter and a mark behind it: a text is the concatenation
of the pieces between such places. A run of texts is cut at all of them at once,
over its bytes; its distinct pieces are found in the worker's cache or encoded,
and the ids are gathered in the order of the pieces. White space of any other
kind stays inside a piece.

Pieces and ids, cached or not, are Arrow and numpy arrays, not Python objects.
Memory is bounded by RUN_BYTES of text (a longer text is taken apart at such
places too) and by CACHE_BYTES: a full cache keeps the pieces that were met most
recently, half of it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at once.
RUN_BYTES = 4 << 20
#: Bytes of a worker's cache, about.
CACHE_BYTES = 32 << 20
#: Longer pieces are encoded whenever they are met.
LONGEST_CACHED = 64

#: Bytes that are ASCII white space, the separators 28 to 31 included.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_CUT_AT = np.zeros(256, bool)
_CUT_AT[[10, 32]] = True
#: The first byte of white space beyond ASCII, and the bytes that follow it.
_WIDE = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), 0xE3: (b"\x80\x80",)}
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ENCODERS: dict[str, PieceEncoder] = {}


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are, or are part of, white space of any kind."""
    out = _SPACE[data]
    for lead, rests in _WIDE.items():
        at = np.flatnonzero(data == lead)
        for rest in rests if len(at) else ():
            own = at[at + len(rest) < len(data)]
            for k, byte in enumerate(rest):
                own = own[data[own + 1 + k] == byte]
            for k in range(len(rest) + 1):
                out[own + k] = True
    return out


def behind_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these places have a letter before them: Latin of one or two bytes, Cyrillic; others count as none."""
    one = data[at - 1]
    lead = np.where(at > 1, data[at - 2], 0)
    latin = (lead == 0xC3) & (one != 0x97) & (one != 0xB7) & (one >= 0x80)
    return _LETTER[one] | latin | (((lead == 0xD0) | (lead == 0xD1)) & (one >= 0x80))


def piece_offsets(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin, and the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    space = spaces(data)
    inner = np.flatnonzero(_CUT_AT[data[1:-1]]) + 1
    inner = inner[~(space[inner - 1] | space[inner + 1])]
    # A text's first and last characters have no neighbour beyond it.
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inner = inner[~(edge[inner] | edge[inner + 1])]
    cut[inner] = True
    cut[inner[data[inner] == 10] + 1] = True
    marks = np.flatnonzero(_MARK[data[1:]]) + 1
    marks = marks[~edge[marks]]
    cut[marks[behind_letter(data, marks)]] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


def stretches(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """What stands between offsets, as an array over the same bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(data))])


def gathered(table: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """table[first[k] : first[k] + n[k]] for each k, end to end."""
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    at += np.repeat((first - ends + n).astype(np.int32), n)
    return table[at]


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Tokens that begin with a space, as byte-level vocabularies write it.
        self.opens = np.zeros(self.vocabulary, bool)
        self.opens[[k for token, k in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True
        self.pieces = pa.array([], pa.large_binary())
        self.ids, self.first, self.n, self.met = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.round = 0

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pieces, and how many each has."""
        out, n = [], []
        for at in range(0, len(pieces), 4096):
            for got in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces[at : at + 4096]], add_special_tokens=False):
                out.append(np.array(got.ids, np.uint32))
                n.append(len(got.ids))
        return np.concatenate([np.empty(0, np.uint32), *out]), np.array(n, np.int64)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each piece's begin, and how many it has.

        Pieces that begin with their only space are encoded as one text: a token that opens with a space opens a piece.
        """
        plain = np.fromiter((x[:1] == b" " and len(x) > 1 and x.count(b" ") == 1 for x in pieces), bool, len(pieces))
        ids, n = [], np.zeros(len(pieces), np.int64)
        places = np.flatnonzero(plain)
        for at in range(0, len(places), 4096):
            own = places[at : at + 4096]
            part = [pieces[k] for k in own]
            got = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.opens[got])
            if len(starts) == len(own) and starts[0] == 0:
                n[own] = np.diff(np.append(starts, len(got)))
            else:
                got, n[own] = self._each(part)
            ids.append(got)
        rest = np.flatnonzero(~plain)
        got, n[rest] = self._each([pieces[k] for k in rest])
        order = np.concatenate([places, rest])
        first = np.zeros(len(pieces), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([*ids, got]), first, n

    def _keep(self, chosen: np.ndarray) -> None:
        self.pieces = self.pieces.take(pa.array(chosen))
        self.ids = gathered(self.ids, self.first[chosen], self.n[chosen])
        self.n, self.met = self.n[chosen], self.met[chosen]
        self.first = np.cumsum(self.n) - self.n

    def _known(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's place in the cache, which knows all of them afterwards."""
        self.round += 1
        place = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        self.met[place[place >= 0]] = self.round
        if len(missing):
            new = pieces.take(pa.array(missing))
            ids, first, n = self._learn(new.to_pylist())
            place[missing] = len(self.pieces) + np.arange(len(missing))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.first, self.n = np.append(self.first, first + len(self.ids)), np.append(self.n, n)
            self.ids = np.append(self.ids, ids)
            self.met = np.append(self.met, np.full(len(missing), self.round))
        return place

    def _trim(self) -> None:
        sizes = pc.binary_length(self.pieces).to_numpy()
        if int(sizes.sum()) + 4 * len(self.ids) + 32 * len(sizes) > CACHE_BYTES:
            cost = sizes + 4 * self.n + 32
            latest = np.argsort(-self.met, kind="stable")
            latest = latest[sizes[latest] <= LONGEST_CACHED]
            self._keep(np.sort(latest[np.cumsum(cost[latest]) <= CACHE_BYTES // 2]))

    def _run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts in their order, and how many each text has."""
        offsets = piece_offsets(data, bounds)
        if len(offsets) < 2:
            return np.empty(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        found = stretches(data, offsets).dictionary_encode()
        place = self._known(found.dictionary)[found.indices.to_numpy()]
        n = self.n[place]
        ids = gathered(self.ids, self.first[place], n)
        self._trim()
        before = np.append(0, np.cumsum(n))[np.searchsorted(offsets, bounds)]
        return ids, np.diff(before)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text, some RUN_BYTES at a time."""
        out, at, size = [], 0, RUN_BYTES
        while at < len(data):
            part = data[at : at + size]
            if at + size < len(data):
                offsets = piece_offsets(part, np.array([0, len(part)]))
                if len(offsets) < 3:
                    size *= 2
                    continue
                part = part[: offsets[-2]]
            out.append(self._run(part, np.array([0, len(part)]))[0])
            at, size = at + len(part), RUN_BYTES
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [x.astype("<u4").tobytes() for _, ids, n in self.runs(texts) for x in np.split(ids, np.cumsum(n)[:-1])]

    def runs(self, texts, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids of each text) of runs of texts; every text's ids end with end_id, if it is given."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN_BYTES, side="right")) - 1)
            own = data[bounds[at] : bounds[to]]
            if len(own) > RUN_BYTES:
                ids = self._long(own)
                n = np.array([len(ids)], np.int64)
            else:
                ids, n = self._run(own, bounds[at : to + 1] - bounds[at])
            if end_id is not None:
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                ids, n = out, n + 1
            yield at, ids, n
            at = to


def encoder(path: str) -> PieceEncoder:
    """One for each file and worker process, which has a core of its own: the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
