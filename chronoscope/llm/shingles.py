"""Sets of hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each ASCII-lower-cased word of all texts, and where each text's words begin and the last end.

    Each distinct word is hashed once, byte by byte over all of them at the same time."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    bounds = (offsets - offsets[0]).astype(np.int64)
    keep = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not keep.all():  # empty words at the ends of a text
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        words = words.filter(pa.array(keep))
    coded = words.dictionary_encode()
    hashes = string_hashes(coded.dictionary)
    return (hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)), bounds


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a sum of scrambled (byte, place) pairs, so that one pass over the bytes is enough."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    scrambled = mixed((place.astype(np.uint64) << np.uint64(8) | data) * MULTIPLIERS[0] + MULTIPLIERS[1])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(scrambled, dtype=np.uint64)])
    return mixed(sums[starts + lengths] - sums[starts] + lengths.astype(np.uint64) * MULTIPLIERS[2])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and each text's bounds. A shorter text is one shingle, without words none."""
    counts = np.diff(bounds)
    short = (counts > 0) & (counts < width)
    many = np.where(short, 1, np.maximum(0, counts - width + 1))
    out = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], many)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = mixed(total + padded[at + k] * MULTIPLIERS[k % 3] + np.uint64(k))
    rows = np.flatnonzero(short)  # all words of a short text as one; the salt keeps it apart from runs of full width
    value = np.zeros(len(rows), np.uint64)
    for k in range(width - 1):
        has = counts[rows] > k
        value[has] = mixed(value[has] + words[bounds[rows[has]] + k] * MULTIPLIERS[k % 3] + np.uint64(k + 1000))
    total[out[rows]] = value
    return total, out


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text one after the other, and their bounds."""
    found, bounds = shingle_hashes(*word_hashes(texts), width)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((found, row))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    sizes = np.bincount(row[new], minlength=len(bounds) - 1)
    return found[new], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
