"""numpy views of a batch of texts: no step goes character by character in Python."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_caches: list[dict] = []


def kept(cache: dict) -> dict:
    """Registers a cache that lives from task to task in a Python worker."""
    _caches.append(cache)
    return cache


def release(but: dict | None = None) -> None:
    """Gives back what earlier tasks of this worker keep: other operators' caches (all but
    one that the caller goes on with), Arrow's pool and the free pages of the C library."""
    global _pow, _inv
    for cache in _caches:
        if cache is not but:
            cache.clear()
    if len(_pow) > 1 << 16:
        _pow, _inv = _pow[: 1 << 16].copy(), _inv[: 1 << 16].copy()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (or binary values) and where each begins (with the end). Null
    texts are empty."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, size: int = 1_000_000):
    """(from, to) of rows with about so many bytes of text."""
    import pyarrow.compute as pc

    ends = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_pylist()])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, to
        at = to


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each run of bytes that are no white space; runs end with the text."""
    inside = ~SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Bytes of the parts that a long text is worked on in.
PART = 2_000_000


def parts(raw: np.ndarray, size: int = PART):
    """(from, to) of parts of a text of about so many bytes, cut before single blanks with
    three letters (or bytes of other scripts) on either side. A text without such blanks
    gives longer parts."""
    at = 0
    while at < len(raw):
        to = at + size
        while to < len(raw):
            near = raw[to - 3 : to + size + 3]
            letter = _LETTER[near]
            k = len(near) - 6
            if k <= 0:
                to = len(raw)
                break
            ok = near[3 : 3 + k] == 0x20
            for j in (0, 1, 2, 4, 5, 6):
                ok &= letter[j : j + k]
            found = np.flatnonzero(ok)
            if len(found):
                to += int(found[0])
                break
            to += size
        yield at, min(to, len(raw))
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_pow = _powers(_BASE, 1 << 16)
_inv = _powers(_INVERSE, 1 << 16)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: a polynomial over random byte codes, from prefix sums."""
    global _pow, _inv
    if len(raw) > len(_pow):
        _pow, _inv = _powers(_BASE, len(raw) + len(raw) // 4), _powers(_INVERSE, len(raw) + len(raw) // 4)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * _pow[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inv[starts])
