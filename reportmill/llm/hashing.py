"""Vectorised word and shingle hashing over Arrow string buffers.

Everything here works on whole batches of text at once: a batch is one byte
buffer with document offsets, words are found with table lookups, and word
hashes come from differences of one running polynomial sum.  No Python loop
touches a character or a word.  Buffers are cut at white space so that memory
stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut at white space near this size.
SEGMENT = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODE = _stream(11, 256)
GRAM_FACTOR = _stream(12, 64) | U64(1)
_BASE = int(_stream(13, 1)[0]) | 1
_tables: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables:
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
                row = np.full(SEGMENT + 1, base, dtype=U64)
                row[0] = 1
                _tables[name] = np.multiply.accumulate(row)
    return _tables["p"], _tables["inv"]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_end(data: np.ndarray, at: int, end: int) -> int:
    """Where the word at ``at`` ends, looked for a segment at a time."""
    while at < end:
        spaces = np.flatnonzero(SPACE[data[at : min(end, at + SEGMENT)]])
        if len(spaces):
            return at + int(spaces[0])
        at += SEGMENT
    return end


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most SEGMENT, cut between texts, else at white space; a longer word is a range of its own."""
    at, end = 0, int(offsets[-1])
    while at < end:
        to = min(end, at + SEGMENT)
        if to < end:
            cut = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if cut <= at:
                spaces = np.flatnonzero(SPACE[data[at:to]])
                cut = at + int(spaces[-1]) + 1 if len(spaces) else _word_end(data, to, int(offsets[np.searchsorted(offsets, at, side="right")]))
            to = cut
        yield at, to
        at = to


def _long_word(word: np.ndarray, lower: bool) -> int:
    """The running sum of a word of more than a segment."""
    power, _ = _powers()
    total, step, factor = 0, pow(_BASE, SEGMENT, 1 << 64), 1
    for at in range(0, len(word), SEGMENT):
        part = word[at : at + SEGMENT]
        total += factor * int((BYTE_CODE[LOWER[part] if lower else part] * power[: len(part)]).sum(dtype=U64))
        factor = factor * step % (1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text) for words ``[^\\x20\\x09-\\x0D]+``.

    The second array has one more entry than there are texts.  ``lower`` maps
    A-Z to a-z first.  A word of any length is one; its hash is carried along.
    """
    power, inverse = _powers()
    hashes, starts = [], []
    with np.errstate(over="ignore"):
        for a, b in _segments(data, offsets):
            if b - a > SEGMENT:
                hashes.append(mix64(np.array([_long_word(data[a:b], lower)], U64) + U64(b - a)))
                starts.append(np.array([a]))
                continue
            part = data[a:b]
            inside = ~SPACE[part]
            edge = np.zeros(len(part), dtype=bool)
            breaks = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
            edge[breaks] = True
            first = inside.copy()
            first[1:] &= ~inside[:-1] | edge[1:]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | edge[1:]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(BYTE_CODE[LOWER[part] if lower else part] * power[: len(part)], out=total[1:])
            hashes.append(mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(U64)))
            starts.append(s + a)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words; runs that cross texts are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:n] * GRAM_FACTOR[0]
        for i in range(1, k):
            out += words[i : i + n] * GRAM_FACTOR[i]
        return mix64(out + U64(k))


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One-element array: the hash of all the words as one run."""
    with np.errstate(over="ignore"):
        at = np.arange(len(words), dtype=U64)
        factor = mix64(at + U64(0x5851F42D4C957F2D)) | U64(1)
        factor[: min(len(words), 64)] = GRAM_FACTOR[: min(len(words), 64)]
        return mix64(np.array([(words * factor).sum(dtype=U64) + U64(len(words))], dtype=U64))
