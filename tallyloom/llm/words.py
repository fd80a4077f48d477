"""Words of many texts at once: positions and 64-bit hashes with NumPy, over the bytes of an Arrow column.

A word is a longest run of bytes other than x20 and x09-x0D. Its hash takes eight bytes at a time, each step an exclusive or and a
mixing bijection, from a key and the word's length; words of more than LONG bytes go through keyed BLAKE2b. Texts are
worked through in pieces of about PIECE bytes, cut where a word ends, so the memory beside the result doesn't depend on
the length of a text. `shared_shingles` compares shingles by their words, where hashes aren't enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
LONG = 64
KEY = 0x2545F4914F6CDD1D

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets at which they begin and end. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about PIECE bytes that end where a text or a word ends."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + PIECE)
        if to < end:
            last = offsets[np.searchsorted(offsets, to, "right") - 1]
            if last > at:
                to = int(last)
            else:  # within one long text
                back = np.flatnonzero(SEPARATOR[data[at:to]])
                stop = int(offsets[np.searchsorted(offsets, at, "right")])
                if len(back):
                    to = at + int(back[-1]) + 1
                else:
                    while to < stop and not SEPARATOR[data[to]]:
                        ahead = np.flatnonzero(SEPARATOR[data[to : to + PIECE]])
                        to = min(stop, to + int(ahead[0]) if len(ahead) else to + PIECE)
        yield at, to
        at = to


def _hashes(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the words at these places."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - first
    out = mix(size.astype(np.uint64) ^ np.uint64(KEY))
    left, at, rest = np.arange(len(first)), first, size
    for _ in range(LONG // 8):
        out[left] = mix(out[left] ^ (eight[at] & _HEADS[np.minimum(rest, 8)]))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
        if not len(left):
            return out
    for i in left:
        word = text[first[i] : end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY.to_bytes(8, "little")).digest(), "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False):
    """Hashes of the words of all texts in order, and the n + 1 offsets among them of each text's words.

    lower: A-Z count as a-z. spans: give the words' first and end positions in data too.
    """
    hashes, begins, ends = [], [], []
    for a, b in _pieces(data, offsets):
        piece = data[a:b]
        word = ~SEPARATOR[piece]
        new = np.zeros(b - a + 1, bool)  # where a text begins
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        new[inner] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | new[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | new[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if not len(s):
            continue
        hashes.append(_hashes(_LOWER[piece] if lower else piece, s, e))
        begins.append(s + a)
        ends.append(e + a)
    none = np.zeros(0, np.int64)
    first = np.concatenate(begins) if begins else none
    out = np.concatenate(hashes) if hashes else none.astype(np.uint64), np.searchsorted(first, offsets)
    return (*out, first, np.concatenate(ends) if ends else none) if spans else out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, text boundaries disregarded."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : j + n]
    return mix(h)


def within(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of the n grams of k words, which lie within one text."""
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = offsets[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles (hashes, ascending) of every text, A-Z lowered, and their n + 1 offsets.

    A text of fewer than k words but one at least has its whole sequence as its only shingle.
    """
    words, at = word_hashes(*text_column(column), lower=True)
    n = np.diff(at)
    grams = gram_hashes(words, k)
    ok = within(at, k, len(grams))
    doc = np.repeat(np.arange(len(n)), n)
    owner, found = doc[: len(grams)][ok], grams[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            h[has] = mix(h[has] * np.uint64(0xD6E8FEB86659FD93) + words[at[short[has]] + j] + np.uint64(j + 1))
        owner, found = np.concatenate([owner, short]), np.concatenate([found, h])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[keep], found[keep]
    return found, np.searchsorted(owner, np.arange(len(n) + 1))


_LOWER_TABLE = _LOWER.tobytes()


def lower_words(text: str | bytes | None) -> list[bytes]:
    """The words of a text, A-Z lowered."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_LOWER_TABLE).split()


def shared_shingles(a: list[bytes], b: list[bytes], k: int = 5) -> tuple[int, int, int]:
    """How many distinct shingles two word sequences have in common, and how many each has, by the words themselves."""

    def shingles(w: list[bytes]) -> set[tuple]:
        return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()

    if len(a) + len(b) <= 1 << 16:
        x, y = shingles(a), shingles(b)
        return len(x & y), len(x), len(y)
    # long texts: the same over numbers of words, without an object for each shingle
    number: dict[bytes, int] = {}
    both = [np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x)) for x in (a, b)]
    if min(len(a), len(b)) < k:
        return 0, len(shingles(a)) if len(a) < k else _distinct(both[0], k), len(shingles(b)) if len(b) < k else _distinct(both[1], k)
    ids = _joined(np.concatenate(both), k)
    x, y = np.unique(ids[: len(a) - k + 1]), np.unique(ids[len(a) :])
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def _joined(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive ones, equal where they are equal."""
    out = numbers
    for j in range(1, k):
        pair = out[:-1] * (int(numbers.max()) + 1) + numbers[j:]
        out = np.unique(pair, return_inverse=True)[1]
    return out


def _distinct(numbers: np.ndarray, k: int) -> int:
    return len(np.unique(_joined(numbers, k)))
