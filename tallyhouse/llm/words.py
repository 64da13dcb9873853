"""Words of whole Arrow text batches as numpy arrays: bounds, documents and 64-bit hashes.

All functions work on the UTF-8 bytes of a batch at once. A null text is an empty text. Hashes are sums modulo
2**64 of random byte values times powers of an odd number, so the hash of any span is the difference of two prefix
sums; they are used as candidates or as one half of a 128-bit key.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyhouse.llm.kept import kept

SPACES = (0x20, *range(0x09, 0x0E))
SLICE_BYTES = 1 << 20
GROUP = 1 << 16


def separators(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


BY_SPACE = separators(*SPACES)
#: Everything in ASCII but digits and lower-case letters.
BY_PUNCTUATION = separators(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Texts:
    """``data`` holds the bytes of all texts, ``inside`` whether they are in a word, ``offsets`` where each text begins;
    word arrays are parallel."""

    data: np.ndarray
    inside: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def first_word(self) -> np.ndarray:
        """For each text the number of its first word, and at the end the number of words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split(texts: pa.Array, table: np.ndarray = BY_SPACE, lower: bool = False) -> Texts:
    """Words are the longest runs without a separator; no word crosses a text's end."""
    data, offsets = utf8(texts)
    if lower:
        data = LOWER[data]
    inside = ~table[data]
    begins, last = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(offsets[1:], starts, side="right")
    return Texts(data, inside, offsets, starts, np.flatnonzero(last) + 1, doc)


def joined(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All words, a single space after each, and where each word begins."""
    sizes = t.ends - t.starts
    begins = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    inside = np.flatnonzero(t.inside)
    out[inside + np.repeat(begins - t.starts, sizes)] = t.data[inside]
    return out, begins


def sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        values, width = pick(values[: len(values) - width], values[width:]), 2 * width
    rest = n - width
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


@kept(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of ``base`` modulo 2**64."""
    return _powers(base, 1 << max(10, int(n - 1).bit_length()))[:n]


@kept(8)
def _base(seed: int) -> tuple[int, int, np.ndarray]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, 1 << 63)) | 1
    return base, pow(base, -1, 1 << 64), rng.integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit number over all others, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray | Callable[[int, int], np.ndarray], starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, starts in order; values are 64-bit numbers or a function
    that gives a range of them.

    Works through the spans in groups that fit a processor's cache; a span's hash does not depend on its place.
    """
    base, inverse, _ = _base(seed)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + GROUP)))
        low, high = int(starts[at]), int(ends[to - 1])
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        part = values(low, high) if callable(values) else values[low:high]
        np.cumsum(part * powers(base, high - low), out=sums[1:])
        out[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * powers(inverse, high - low)[starts[at:to] - low]
        at = to
    return mix(out)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span of bytes."""
    table = _base(seed)[2]
    return span_hashes(lambda low, high: table[data[low:high]], starts, ends, seed)


def word_hashes(t: Texts, seed: int = 1) -> np.ndarray:
    return byte_hashes(t.data, t.starts, t.ends, seed)


def window_hashes(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of every ``n`` consecutive numbers; windows over a text's end are the caller's to leave out."""
    at = np.arange(max(0, len(hashes) - n + 1))
    return span_hashes(hashes, at, at + n, seed + 1000)


def give_back() -> None:
    """Return what this worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library on Linux
    if trim:
        trim(0)


def lean(work: Callable[..., pa.Table], *args: object) -> pa.Table:
    """``work`` on a group, as ``frugal`` on a partition."""
    try:
        return work(*args)
    finally:
        give_back()


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on a partition, after which the worker gives back to the system what it has freed; workers wait for
    their next task with all they ever needed, else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
