"""Words and lines of whole texts as numpy arrays: spans and 64-bit hashes.

Word grammar: ``[^\\x20\\x09-\\x0D]+``. Everything works on the UTF-8 bytes of a bounded
run of texts (``runs``); a null text counts as empty. Hashes are sums of per-byte random
values times per-position odd factors, then mixed; equal hashes are taken as equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20  # a run ends once it holds so many bytes; one longer text is a run by itself
_random = np.random.default_rng(20240607)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_factors = np.empty(0, np.uint64)


def position_factors(n: int) -> np.ndarray:
    """Odd factors of the first ``n`` positions."""
    global _factors
    if len(_factors) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _factors = mix(np.arange(1, size + 1, dtype=np.uint64) * M3) | np.uint64(1)
    return _factors[:n]


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    buffers = texts.buffers()
    if n == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    if buffers[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def runs(texts: pa.Array | pa.ChunkedArray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of successive runs of about ``limit`` bytes of texts."""
    data, offsets = text_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 offsets of the texts among the words.

    ``outside`` says which bytes belong to no word.
    """
    inside = ~outside[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start and end of each line (split at \n only), and the n + 1 offsets of the texts among the lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    return starts, ends, np.concatenate([[0], np.searchsorted(breaks, offsets[1:]) + np.arange(1, len(offsets))])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each (ordered, disjoint) span; empty spans hash alike."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(lengths)
    # In chunks of whole spans, as a byte takes some forty while it is hashed.
    upto = np.cumsum(lengths[full])
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + RUN_BYTES, "right")))
        some = full[i:j]
        own = lengths[some]
        first = np.cumsum(own) - own
        position = np.arange(first[-1] + own[-1]) - np.repeat(first, own)
        at = position + np.repeat(starts[some], own)
        out[some] = np.add.reduceat(BYTE_VALUE[data[at]] * position_factors(int(own.max()))[position], first)
        i = j
    return mix(out + lengths.astype(np.uint64) * M3)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; a shorter text is one shingle, none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        out = mix(out * M3 + words[i: n - width + 1 + i])
    return out
