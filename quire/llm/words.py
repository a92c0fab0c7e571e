"""Word splitting and hashing shared by the text operators of this subpackage.

Everything works on batches: the words of many texts are hashed through one
dictionary and laid end to end in one array, so that n-gram hashes cost a few
array operations for the batch instead of a loop for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(31)

#: Lower-cases A-Z only.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def blank_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of UTF-8 text lower-cased in A-Z."""
    return _ALNUM.findall(text.translate(LOWER))


class WordHash(dict):
    """word -> 64-bit hash, kept for words seen before; cleared when it gets large."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> SHIFT)) * MIX_A
    x = (x ^ (x >> SHIFT)) * MIX_B
    return x ^ (x >> SHIFT)


def flatten(texts: list[list[bytes]], hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the n+1 offsets of the texts in them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return hashes.of(chain.from_iterable(texts), int(offsets[-1])), offsets


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place (n-k+1 values, across texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * MIX_A + h[j : j + n]
    return mix(acc)


def starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where k words of one text start, and the text each belongs to."""
    room = np.maximum(np.diff(offsets) - k + 1, 0)
    owner = np.repeat(np.arange(len(room)), room)
    first = np.cumsum(room) - room
    return np.arange(int(room.sum())) - first[owner] + offsets[:-1][owner], owner


def covered(places: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in some [place, place + length)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, places, 1)
    np.add.at(delta, places + lengths, -1)
    return np.cumsum(delta[:n]) > 0


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        total = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()])
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes, empty for null."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    return [b"" if x is None else x for x in values.to_pylist()]
