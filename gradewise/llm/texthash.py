"""Vectorised text hashing: whole batches of texts as one array of code points, no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
MIX_A, MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points in one window of work; bounds memory, not what is read.
WINDOW = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits of ``x``."""
    x = x ^ (x >> _U(30))
    x = x * MIX_A
    x = x ^ (x >> _U(27))
    x = x * MIX_B
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POWERS: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, WINDOW + 1024))
    return have[:n]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_LOW = mix(np.arange(1 << 16, dtype=_U) + _U(0x1234567))


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``cps[start:end]``: a polynomial over mixed code points, then mixed with the length."""
    n = len(cps)
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    values = sums[1:]
    np.take(_LOW, cps & 0xFFFF, out=values)
    high = np.flatnonzero(cps >> 16)
    values[high] += (cps[high] >> 16).astype(_U) * MIX_A
    values *= _power_table(_BASE, n)
    np.cumsum(values, out=values)
    raw = sums[ends]
    raw -= sums[starts]
    raw *= _power_table(_BASE_INVERSE, n + 1)[starts]
    raw += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(raw)


def groups_by_size(sizes: np.ndarray, limit: int = WINDOW) -> Iterator[slice]:
    """Runs of neighbouring items whose sizes add up to ``limit`` at most (a larger item stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield slice(start, len(sizes))


def words_of(texts: list[str], lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``texts`` in order, and how many words each text has.

    A word is a run of code points other than space and U+0009 to U+000D; only A to Z are lower-cased.
    """
    cps = codepoints("\n".join(texts) + "\n").copy()
    if lower_ascii:
        cps[(cps >= 65) & (cps <= 90)] += 32
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    closes = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    upto = np.searchsorted(starts, closes, side="left")
    return span_hashes(cps, starts, ends), np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's ``width``-word shingles.

    A text of fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    words, counts = words_of(texts)
    factors = constants(width, 77)
    n = len(words)
    sums = np.zeros(n, dtype=_U)
    for k in range(width):
        sums[: n - k] += words[k:] * factors[k]
    sums = mix(sums + _U(width))
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(sums[at : at + c - width + 1]))
        elif c:
            few = (words[at : at + c] * factors[:c]).sum(dtype=_U, keepdims=True)
            out.append(mix(few + constants(c, 99)[-1:]))
        else:
            out.append(np.zeros(0, dtype=_U))
        at += c
    return out
