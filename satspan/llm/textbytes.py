"""Word and shingle hashes of whole Arrow batches of texts, as numpy arrays.

Texts stay UTF-8 bytes in one buffer; words are runs of non-blank bytes, so the
work per text is a handful of array passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A random odd number for each byte value, from a fixed seed.
_BYTE_KEY = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_KEY = _BYTE_KEY[_LOWER]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each text starts (n + 1)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each: bounded memory."""
    texts = batch.column(batch.schema.get_field_index(column))
    at = text_bytes(texts)[1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    inside = ~blank[data] if blank is not _BLANK else (data != 32) & (data - np.uint8(9) > 4)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[1:-1][at[1:-1] < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(at, start, side="right") - 1


_KNOWN: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse, kept for the next batch."""
    if len(_KNOWN[0]) < n:
        for k, x in enumerate((_PRIME, _INVERSE)):
            grown = np.full(n + n // 4, x, dtype=U)
            grown[0] = 1
            _KNOWN[k] = np.multiply.accumulate(grown, out=grown)
    return _KNOWN[0], _KNOWN[1]


#: Bytes whose powers and sums are held at once.
HASH_BLOCK = 1 << 17


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word (a sum of keyed powers, finalised).

    Words are taken in blocks of about ``HASH_BLOCK`` bytes, so that the memory
    does not grow with the text; a longer word is a block of its own.
    """
    out = np.zeros(len(start), dtype=U)
    a = 0
    while a < len(start):
        base = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, base + HASH_BLOCK, side="right")))
        size = int(end[b - 1]) - base
        power, back = _powers(size + 1)
        total = np.zeros(size + 1, dtype=U)
        keyed = _LOWER_KEY[data[base : base + size]]
        keyed *= power[:size]
        np.cumsum(keyed, out=total[1:])
        first, last = start[a:b] - base, end[a:b] - base
        # Divided by the power of the start, so that place does not matter.
        out[a:b] = mix((total[last] - total[first]) * back[first] + (last - first).astype(U))
        a = b
    return out


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of k words; a text with fewer words
    gives its whole sequence as one, a text without words none."""
    seed = mix(np.arange(1, k + 1, dtype=U))
    n = len(words)
    out, of = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    if n >= k:
        whole = doc[: n - k + 1] == doc[k - 1 :]
        total = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            total += mix(words[j : n - k + 1 + j] ^ seed[j])
            total *= _PRIME
        out, of = mix(total[whole]), doc[: n - k + 1][whole]
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        for d in short:
            total = U(counts[d])
            with np.errstate(over="ignore"):
                for j, w in enumerate(words[first[d] : first[d + 1]]):
                    total = (total + mix(np.array([w ^ seed[j]], dtype=U))[0]) * _PRIME
            extra.append(total)
        out = np.concatenate([out, mix(np.array(extra, dtype=U))])
        of = np.concatenate([of, short])
    return out, of


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = text_bytes(column)
    start, end, doc = word_spans(data, at)
    hashes, of = shingle_hashes(word_hashes(data, start, end), doc, len(column))
    if len(of) and (of[:-1] > of[1:]).any():
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(column) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
