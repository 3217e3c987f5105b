"""Words of many texts at once, as 64-bit hashes, with numpy.

A word is a run of bytes other than space and 0x09 to 0x0D in the UTF-8 text. Its bytes are taken eight
at a time, each eight mixed into the hash of those before; a word above ``LONG`` bytes is hashed by
blake2b. A word of up to eight bytes has a hash that no other word of its length has. Whoever must not take
one word for another compares the bytes (:func:`same`). Buffers of texts stay near ``CHUNK`` bytes: long
texts are cut at white space, and only a single longer word makes a buffer longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 20
LONG = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (splitmix64), element by element."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def eights(data: bytes) -> np.ndarray:
    """The eight bytes at every place of the data, as one number; zeros follow its end."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))


def hash_words(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the words at these places of the data."""
    at, length = eights(data), end - start
    value = mix((at[start] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _ODD))
    rest = np.flatnonzero((length > 8) & (length <= LONG))
    done = 8
    while len(rest):
        more = at[start[rest] + done] & _MASK[np.minimum(length[rest] - done, 8)]
        value[rest] = mix((value[rest] ^ more) * _ODD + np.uint64(done))
        done += 8
        rest = rest[length[rest] > done]
    for i in np.flatnonzero(length > LONG).tolist():
        value[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return value


def same(a: bytes, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """Whether the words of ``a`` equal those of ``b``, a pool of bytes, place by place."""
    length = a_end - a_start
    out = length == b_length
    at, other = eights(a), np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))
    rest, done = np.flatnonzero(out), 0
    while len(rest):
        mask = _MASK[np.minimum(length[rest] - done, 8)]
        out[rest] &= (at[a_start[rest] + done] ^ other[b_start[rest] + done]) & mask == 0
        done += 8
        rest = rest[(length[rest] > done) & out[rest]]
    return out


@dataclass
class Words:
    """The words of one buffer: byte positions, hashes, and the text each belongs to."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def _buffers(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Texts joined by line feeds into buffers: bytes, places where texts begin, their numbers."""
    parts: list[bytes] = []
    at: list[int] = []
    who: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        begin = 0
        while begin < len(text):
            stop = len(text)
            if stop - begin > CHUNK:
                stop = begin + CHUNK
                piece = text[begin:stop]
                cut = max(piece.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
                if cut > 0:
                    stop = begin + cut
                else:  # inside a word: go on to its end
                    while stop < len(text) and not IS_SPACE[text[stop]]:
                        stop += 1
            piece = text[begin:stop] if begin or stop < len(text) else text
            if size and size + len(piece) > CHUNK:
                yield b"\n".join(parts), at, who
                parts, at, who, size = [], [], [], 0
            parts.append(piece)
            at.append(size)
            who.append(i)
            size += len(piece) + 1
            begin = stop
    if parts:
        yield b"\n".join(parts), at, who


def scan(texts: list[bytes]) -> Iterator[Words]:
    """The words of all texts, buffer by buffer, in order."""
    for data, at, who in _buffers(texts):
        raw = np.frombuffer(data, np.uint8)
        word = ~IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            continue
        doc = np.asarray(who)[np.searchsorted(at, start, "right") - 1]
        yield Words(raw, start, end, hash_words(data, start, end), doc)


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    found = [(w.hash, w.doc) for w in scan(texts)]
    count = np.zeros(len(texts), np.int64)
    for _, doc in found:
        count += np.bincount(doc, minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(count)])
    return np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64), bounds


def windows(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text: hash, text number, first word's place."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += h[j : j + n] * factor[j]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    inside = np.flatnonzero(np.arange(n) + width <= bounds[doc + 1])
    return mix(total[inside]), doc[inside], inside


def shingles(h: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of each text (hash, text number); a text of fewer words is one shingle."""
    value, doc, _ = windows(h, bounds, width)
    short = [i for i in range(len(bounds) - 1) if 0 < bounds[i + 1] - bounds[i] < width]
    if short:
        extra = [windows(h[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]),
                         int(bounds[i + 1] - bounds[i]))[0] for i in short]
        value, doc = np.concatenate([value, *extra]), np.concatenate([doc, short])
    return value, doc
