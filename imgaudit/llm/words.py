"""Words of whole Arrow batches of text as arrays of 64-bit hashes, without a Python loop per word.

A byte table gives each byte a class: 0 separates, any other class is part of a word, and a word
is a maximal run of one class inside one text. Words are hashed over their bytes after A-Z became
a-z, by differences of a running polynomial, so a whole batch costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a single longer text is handled alone.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_classes(separators: str) -> np.ndarray:
    """Class 1 for all bytes but those of the ASCII ``separators``."""
    table = np.ones(256, dtype=np.uint8)
    table[[ord(c) for c in separators]] = 0
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_classes("\x20\x09\x0a\x0b\x0c\x0d")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = byte_classes("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
#: Words and runs of punctuation apart, for language models.
MODEL = np.where(SPACED == 0, 0, np.where(ALNUM == 1, 1, 2)).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes in all, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _spans(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    bounds = np.concatenate(([0], edge, [len(cls)]))
    inside = cls[bounds[:-1]] != 0
    return bounds[:-1][inside], bounds[1:][inside]


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of one text's bytes, in pieces that end between words."""
    parts, at = [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(table[data[at:stop]] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                gaps = np.flatnonzero(table[data[stop:]] == 0)
                stop = stop + int(gaps[0]) if len(gaps) else len(data)
        piece = data[at:stop]
        starts, ends = _spans(table[piece])
        parts.append((_hash(piece, starts, ends), starts + at, ends + at))
        at = stop
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def batch_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes, starts, ends, bounds) for each block of texts.

    ``bounds`` has the range of words of each text; starts and ends count bytes in ``data``.
    """
    for first, last in blocks(offsets):
        at, stop = int(offsets[first]), int(offsets[last])
        if last == first + 1:
            hashes, starts, ends = words_of(data[at:stop], table)
            yield first, hashes, starts + at, ends + at, np.array([0, len(hashes)])
            continue
        # one separator goes between texts, so that no word crosses from one into the next
        own = offsets[first : last + 1] - at
        spread = np.zeros(stop - at + last - first, dtype=np.uint8)
        keep = np.ones(len(spread), dtype=bool)
        keep[own[1:] + np.arange(last - first)] = False
        spread[keep] = data[at:stop]
        cls = np.zeros(len(spread), dtype=np.uint8)
        cls[keep] = table[data[at:stop]]
        starts, ends = _spans(cls) if len(cls) else (own[:0], own[:0])
        hashes = _hash(spread, starts, ends)
        texts = own + np.arange(last - first + 1)
        bounds = np.searchsorted(starts, texts)
        shift = at - np.repeat(np.arange(last - first), np.diff(bounds))
        yield first, hashes, starts + shift, ends + shift, bounds


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if there are fewer, of none if empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = total * _ORDER + hashes[k : n - size + 1 + k]
    return mix(total)
