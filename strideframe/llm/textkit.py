"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than space and TAB..CR, the pattern ``[^\\x20\\x09-\\x0D]+``
(these bytes never occur inside a UTF-8 character).  Words and word runs get 64-bit
polynomial hashes from prefix sums, so that any run costs the same whatever its length.  Texts
are taken in slices of about half a megabyte; one long text is cut at white space, so that memory
follows the number of its words, not its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64
_BYTE_BASE, _WORD_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, with every ASCII sign that is neither letter nor digit as white space.
PLAIN = np.array([_LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mixed(np.arange(1, 257, dtype=U64) * U64(_BYTE_BASE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 17)
        held = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = held
    return held[0][:n], held[1][:n]


def run_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """The hash of ``values[start:stop]`` for each pair of positions; equal runs have equal hashes."""
    power, inverse = _powers(base, len(values) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * power[:-1])])
    return mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(U64) * U64(0x632BE59BD9B4E019))


def second_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """As :func:`run_hashes` with an independent base: together they identify a run by 128 bits."""
    return run_hashes(values, start, stop, _SECOND_BASE)


@dataclass
class Words:
    """The words of some texts: hashes, byte ranges in ``data`` and the range of words of each text."""

    data: np.ndarray
    code: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text_of(self, lo: int, hi: int) -> list[bytes]:
        """The words ``lo:hi`` as bytes."""
        raw = self.data.tobytes() if hi - lo > 64 else None
        return [(raw[a:b] if raw is not None else self.data[a:b].tobytes()) for a, b in zip(self.start[lo:hi].tolist(), self.stop[lo:hi].tolist())]

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """For each text, its words where ``keep`` holds, joined by one space."""
        length = (self.stop - self.start)[keep]
        owner = self.owner()[keep]
        n_words = np.bincount(owner, minlength=len(self.first) - 1)
        size = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=length + 1, minlength=len(self.first) - 1).astype(np.int64))])
        out = np.full(size[-1], 0x20, np.uint8)
        at = np.cumsum(length + 1) - (length + 1)
        step = np.ones(int(length.sum()), np.int64)
        if len(length):
            ends = np.cumsum(length)
            source, target = self.start[keep], at
            begin = ends - length
            from_, to = step.copy(), step
            from_[begin] = source - np.concatenate([[0], (source + length - 1)[:-1]])
            to[begin] = target - np.concatenate([[0], (target + length - 1)[:-1]])
            out[np.cumsum(to)] = self.data[np.cumsum(from_)]
        raw = out.tobytes()
        return [raw[size[i] : size[i + 1] - 1] if n_words[i] else b"" for i in range(len(n_words))]


def _scan(data: np.ndarray, edges: np.ndarray, fold: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if fold is not None:
        data = fold[data]
    solid = ~_SPACE[data]
    before = np.concatenate([[False], solid[:-1]])
    before[edges[edges < len(data)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]])
    after[edges[edges > 0] - 1] = False
    stop = np.flatnonzero(solid & ~after) + 1
    return start, stop, run_hashes(_BYTE_CODE[data], start, stop, _BYTE_BASE)


def _cuts(data: np.ndarray) -> list[int]:
    """Positions that cut one long text into slices at white space; a longer word stays whole."""
    cuts, at = [0], 0
    while len(data) - at > SLICE_BYTES:
        gaps = np.flatnonzero(_SPACE[data[at + SLICE_BYTES :]][: 1 << 16])
        if not len(gaps):
            gaps = np.flatnonzero(_SPACE[data[at + SLICE_BYTES :]])
            if not len(gaps):
                break
        at += SLICE_BYTES + int(gaps[0])
        cuts.append(at)
    return [*cuts, len(data)]


def words_of(texts: pa.Array, lower: bool = False, fold: np.ndarray | None = None) -> Words:
    """The words of an Arrow string array; a null is an empty text. ``lower``: A-Z as a-z; ``fold``: another table of bytes."""
    fold = _LOWER if lower else fold
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    if len(data) > 2 * SLICE_BYTES and len(texts) == 1:
        cuts = _cuts(data)
        parts = [(_scan(data[a:b], np.array([0, b - a]), fold), a) for a, b in zip(cuts, cuts[1:])]
        start, stop, code = (np.concatenate([p[i] + (a if i < 2 else U64(0)) for p, a in parts]) for i in range(3))
    else:
        start, stop, code = _scan(data, edges, fold) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
    return Words(data, code, start, stop, np.searchsorted(start, edges))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``SLICE_BYTES``; at least one row each."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
