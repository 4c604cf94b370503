"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` over the text's UTF-8 bytes, unchanged. Hashing goes over all
bytes of a batch in pieces of bounded size, which may end inside a word; beside the bytes themselves,
memory follows the piece and the number of words, not the length of a text or of a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places of a word that have a factor of their own; further ones multiply it by one for their page.
_PAGE = 4096
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    _PLACE = mix(np.arange(1, _PAGE + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _factors(place: np.ndarray) -> np.ndarray:
    if place.max(initial=0) < _PAGE:
        return _PLACE[place]
    out = _PLACE[place % _PAGE]
    far = np.flatnonzero(place >= _PAGE)
    if len(far):
        with np.errstate(over="ignore"):
            out[far] *= mix((place[far] // _PAGE).astype(np.uint64) * _STEP) | np.uint64(1)
    return out


def slices(sizes: Sequence[int], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs ``[lo, hi)`` of rows of at most ``limit`` bytes together (a longer row stands alone)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _piece_sums(buf: np.ndarray, spaces: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and sum of terms of each word in a piece whose first word has ``before`` bytes in the pieces before."""
    inside = ~spaces[buf]
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8))))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lens)
    if before:
        place = place.astype(np.int64)
        place[: lens[0]] += before
    with np.errstate(over="ignore"):
        return starts, ends, np.add.reduceat(_BYTE[buf[inside]] * _factors(place), first)


def words(texts: Sequence[bytes], spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts joined by newlines: the bytes, each word's start, end and hash, and the words of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    parts: list[list[np.ndarray]] = []
    for a in range(0, len(buf), PIECE):
        last = next((p for p in reversed(parts) if len(p[0])), None)
        goes_on = last is not None and last[1][-1] == a and not spaces[buf[a]]
        start, end, total = _piece_sums(buf[a : a + PIECE], spaces, a - int(last[0][-1]) if goes_on else 0)
        start, end = start + a, end + a
        if goes_on:
            with np.errstate(over="ignore"):
                last[1][-1], last[2][-1] = end[0], last[2][-1] + total[0]
            start, end, total = start[1:], end[1:], total[1:]
        parts.append([start, end, total])
    starts, ends, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    with np.errstate(over="ignore"):
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * _STEP)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, bounds)
    counts = np.diff(np.concatenate(([0], cuts)))
    return buf, starts, ends, hashes, counts


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` hashes, in order; ``len(h) - k + 1`` of them."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    return mix(_roll(h, k))


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    if k == 1:
        return h
    half = k // 2
    a = _roll(h, half)
    n = len(h) - 2 * half + 1
    with np.errstate(over="ignore"):
        r = a[:n] * np.uint64(pow(int(_BASE), half, 1 << 64)) + a[half : half + n]
        if k % 2:
            r = r[: len(h) - k + 1] * _BASE + h[k - 1 :]
    return r


def owner(counts: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def within(counts: np.ndarray, k: int) -> np.ndarray:
    """Whether the run of ``k`` words from each position lies in one text."""
    of = owner(counts)
    return of[: len(of) - k + 1] == of[k - 1 :] if len(of) >= k else np.empty(0, bool)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
