"""HyperMinHash sketches of word bags, in NumPy, for Arrow batches.

A text is the bag of its words: the k-th occurrence of a word is an element of its own, so that Jaccard similarity of
elements is the similarity of bags. Each of REGISTERS buckets hashes all elements, keeps the least value and stores of
it the count of leading zeros (4 bits) and the MANTISSA bits after the leading one: one byte. All words weigh the same, as
in the similarity that decides: with less weight on short words, pairs whose edits fall on the others would be missed.

Behind the registers a sketch holds the bag's size and PARITY bits: bit i says whether an odd number of elements hash to
i. Bits that differ are at most the elements that only one of two bags has, which gives a test that no pair over a
threshold can fail.
"""
from __future__ import annotations

import re

import numpy as np
import xxhash

REGISTERS, MANTISSA = 128, 4
PARITY = 192
SIZE_AT, PARITY_AT = REGISTERS + 1, REGISTERS + 3  # after the level, two bytes of size, then the parities
WIDTH = PARITY_AT + PARITY // 8
WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_cache: dict[str, int] = {}
_CACHE_MAX = 1_000_000  # words; beyond it the cache starts anew


def words(text: str | None) -> list[str]:
    """The longest runs of letters or digits, lower-cased; null gives none."""
    if not text:
        return []
    if "İ" in text:  # its lower case is two characters and would end the run
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def _word_hashes(flat: list[str]) -> np.ndarray:
    """32-bit hash of each word."""
    if len(_cache) > _CACHE_MAX:
        _cache.clear()
    get, out = _cache.get, []
    for w in flat:
        h = get(w)
        if h is None:
            h = _cache[w] = xxhash.xxh32_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def elements(bags: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(element hashes, start of each bag); no bag may be empty."""
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    h = _word_hashes([w for b in bags for w in b])
    key = np.repeat(np.arange(len(bags), dtype=np.uint64) << np.uint64(32), sizes) | h
    key.sort()
    n = np.arange(len(key))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    occurrence = (n - np.maximum.accumulate(np.where(first, n, 0))).astype(np.uint64)
    h = key & np.uint64(0xFFFFFFFF)
    mixed = (h + occurrence * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes) - sizes


def sketches(bags: list[list[str]]) -> np.ndarray:
    """uint8 [len(bags), WIDTH]: registers, level of the bag's size, size (65,535 at most), parities. No bag may be empty."""
    out = np.empty((len(bags), WIDTH), np.uint8)
    if not bags:
        return out
    e, start = elements(bags)
    ends, at = np.append(start[1:], len(e)), 0
    out[:, REGISTERS] = np.clip(np.rint(4 * np.log2(ends - start)), 0, 255)
    out[:, SIZE_AT:PARITY_AT] = np.minimum(ends - start, 65535).astype("<u2").view(np.uint8).reshape(-1, 2)
    bit = np.repeat(np.arange(len(bags)) * PARITY, ends - start) + ((e.astype(np.uint64) * np.uint64(PARITY)) >> np.uint64(32)).astype(np.int64)
    out[:, PARITY_AT:] = np.packbits((np.bincount(bit, minlength=len(bags) * PARITY) & 1).astype(np.uint8).reshape(-1, PARITY), axis=1)
    by, plus = _A[:, None], _B[:, None]
    while at < len(bags):  # some 512 elements at once, to stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(ends, start[at] + 512)))
        s, t = start[at], ends[to - 1]
        if to == at + 1 and t - s > 65536:  # one very long text
            v = np.full((REGISTERS, 1), 0xFFFFFFFF, np.uint32)
            for x in range(s, t, 65536):
                y = min(t, x + 65536)
                v = np.minimum(v, (by * e[None, x:y] + plus).min(1, keepdims=True))
        else:
            v = by * e[None, s:t]
            v += plus
            v = np.minimum.reduceat(v, start[at:to] - s, axis=1)
        # A double's first 16 bits: exponent, which tells the zeros, and 4 bits after the leading one.
        top = (v.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)).astype(np.int64)
        zeros = np.clip(32 + 1022 - (top >> MANTISSA), 0, 15)
        out[at:to, :REGISTERS] = ((zeros << MANTISSA) | (top & (2**MANTISSA - 1))).T
        at = to
    return out


def _chance() -> np.ndarray:
    """[level, level]: how often registers of two unrelated bags of those sizes agree."""
    size = 2.0 ** (np.arange(256) / 4)
    z, f = np.divmod(np.arange(256), 2**MANTISSA)
    # The least of `size` uniform values (as shares of 2**32) is exponential.
    lo = (1 + f / 2**MANTISSA) * 2.0 ** -(z + 1)
    hi = (1 + (f + 1) / 2**MANTISSA) * 2.0 ** -(z + 1)
    p = np.exp(-size[:, None] * lo) - np.exp(-size[:, None] * hi)
    return p @ p.T


_CHANCE: list[np.ndarray] = []


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of each pair of sketches, corrected for registers that agree by chance."""
    if not _CHANCE:
        _CHANCE.append(_chance())
    agree = (a[:, :REGISTERS] == b[:, :REGISTERS]).mean(1)
    c = _CHANCE[0][a[:, REGISTERS], b[:, REGISTERS]]
    return (agree - c) / (1 - c)


def picks(bands: int, rows: int) -> np.ndarray:
    """[bands, rows] registers of each band: cut from as many shuffles of all registers as are needed. Bands of no rows
    hold everything together."""
    if not rows:
        return np.zeros((bands, 0), np.int64)
    rng, per = np.random.default_rng(7), REGISTERS // rows
    return np.concatenate([rng.permutation(REGISTERS)[: per * rows].reshape(per, rows) for _ in range(-(-bands // per))])[:bands]


def agreement(sk: np.ndarray, group: np.ndarray) -> np.ndarray:
    """[REGISTERS + 1]: share of all pairs of sketches that are of one group and agree in so many registers."""
    n, x, at = np.zeros(REGISTERS + 1), np.ascontiguousarray(sk[:, :REGISTERS]), np.arange(len(sk))
    for i in range(0, len(x), 32):
        same = (x[i : i + 32, None] == x[None]).sum(2)
        n += np.bincount(same[(at[i : i + 32, None] < at) & (group[i : i + 32, None] == group)], minlength=REGISTERS + 1)
    return n / max(1, len(x) * (len(x) - 1) / 2)


def band_keys(sk: np.ndarray, pick: np.ndarray, group: np.ndarray) -> np.ndarray:
    """uint64 [bands, len(sk)] keys of bands of up to 8 registers; equal only within a group."""
    out = np.empty((len(pick), len(sk)), np.uint64)
    g = group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i, p in enumerate(pick):
        row = np.zeros((len(sk), 8), np.uint8)
        row[:, : len(p)] = sk[:, p]
        x = row.view(np.uint64)[:, 0] + g
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        out[i] = x
    return out


def bag_similarity(a: list[str], b: list[str]) -> float:
    """Sum of the smaller counts over sum of the larger counts; 0 for two empty bags."""
    from collections import Counter

    x, y = Counter(a), Counter(b)
    common = (x & y).total()
    return common / max(1, len(a) + len(b) - common)
