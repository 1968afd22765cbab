"""Words and word hashes of texts, over whole batches of bytes with numpy.

A word's hash sums independent random 64-bit values, one for each (place within a block of BLOCK bytes, byte), over each
of its blocks; the blocks' sums are mixed with their number and summed, and the whole is mixed with the length. No two
words collide by the form of the hash, as they would under a polynomial mod 2**64: two different words meet with odds of
2**-64. Memory is bounded by PIECE bytes of text at a time, however long a text is; a longer word is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Small enough for the arrays of a piece to stay in a core's cache.
PIECE = 1 << 16
#: Places that have values of their own.
BLOCK = 64
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The value of byte b (0 for a separator, else the byte + 1) at place p of its block, at p * 257 + b.
VALUES = mix64(np.arange(1, BLOCK * 257 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
VALUES[::257] = 0


def _codes(letters: np.ndarray) -> np.ndarray:
    """1 + each byte, A-Z as a-z; 0 for bytes that aren't letters."""
    byte = np.arange(256)
    byte[65:91] += 32
    return np.where(letters, byte + 1, 0).astype(np.int64)


_blank = np.zeros(256, bool)
_blank[[0x20, *range(9, 14)]] = True
#: Words `[^\x20\x09-\x0D]+`, A-Z lower-cased.
PLAIN = _codes(~_blank)
_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Runs of ASCII letters and digits and of all further characters.
LETTERS = _codes(_alnum)


def _blocks(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each word the sum of its blocks' mixed sums."""
    many = -(-(ends - starts) // BLOCK)
    first = np.cumsum(many) - many
    turn = np.arange(int(many.sum())) - np.repeat(first, many)
    begin = np.repeat(starts, many) + BLOCK * turn
    stop = np.minimum(begin + BLOCK, np.repeat(ends, many))
    return np.add.reduceat(mix64(sums[stop] - sums[begin] + turn.astype(np.uint64) * _U(0xD1342543DE82EF95)), first)


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    at = np.flatnonzero(padded[1:] != padded[:-1])
    return at[::2], at[1::2]


def word_bounds(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of data."""
    return _edges((table != 0).take(np.frombuffer(data, np.uint8)))


def piece_words(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, prefix sums of the bytes' values, hashes) of the words of a piece of bytes."""
    code = table.take(np.frombuffer(data, np.uint8))
    starts, ends = _edges(code != 0)
    # Of each byte its place in its word: the index less that of the last start.
    last = np.concatenate(([0], starts))
    place = np.arange(len(code)) - np.repeat(last, np.diff(np.append(last, len(code))))
    place &= BLOCK - 1
    place *= 257
    place += code
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(VALUES.take(place), out=sums[1:])
    size = ends - starts
    if len(size) and size.max() > BLOCK:
        total = _blocks(starts, ends, sums)
    else:
        total = mix64(sums[ends] - sums[starts])
    return starts, ends, sums, mix64(total + size.astype(np.uint64) * _U(0xA24BAED4963EE407))


def _pieces(data: bytes, table: np.ndarray, size: int) -> Iterator[bytes]:
    """data cut between words into pieces of about size bytes."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while True:
            gaps = np.flatnonzero(table[np.frombuffer(data, np.uint8, min(size, len(data) - end), end)] == 0)
            if len(gaps):
                end += int(gaps[0]) + 1
                break
            end = min(end + size, len(data))
            if end == len(data):
                break
        yield data[at:end]
        at = end
    yield data[at:]


def batches(texts: Iterable[str | None], size: int = PIECE) -> Iterator[list[bytes]]:
    """The texts as bytes, grouped to about size bytes."""
    group, total = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if group and total + len(data) > size:
            yield group
            group, total = [], 0
        group.append(data)
        total += len(data) + 1
    if group:
        yield group


def word_hashes(group: list[bytes], table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds): text i has the words bounds[i]:bounds[i + 1]."""
    lengths = np.fromiter((len(x) + 1 for x in group), np.int64, len(group))
    data = b" ".join(group) + b" "
    if len(data) <= 2 * PIECE:
        starts, _, _, hashes = piece_words(data, table)
        return hashes, np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    found, at, where = [], 0, []
    for piece in _pieces(data, table, PIECE):
        starts, _, _, hashes = piece_words(piece, table)
        found.append(hashes)
        where.append(starts + at)
        at += len(piece)
    return np.concatenate(found), np.concatenate(([0], np.searchsorted(np.concatenate(where), np.cumsum(lengths))))


_STEPS = mix64(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of width words; of all words, if fewer; none of none."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, width)
    total = words[: n - k + 1] * _STEPS[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _STEPS[j]
    return np.unique(mix64(total + _U(k)))
