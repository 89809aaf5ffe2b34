"""Hashed character n-gram counts of whole texts, a window of code points at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gradewise.llm.texthash import codepoints

#: Code points that are counted at once; a text of any length goes through in such windows.
STRETCH = 1 << 16


def bucket_counts(text: str, sizes: tuple[int, ...], dim: int) -> np.ndarray:
    """How often each of ``dim`` buckets is hit by the n-grams (n in ``sizes``) of ``text``, as int64."""
    out = np.zeros(dim, dtype=np.int64)
    widest = max(sizes)
    shift = np.uint32(32 - (dim.bit_length() - 1))
    for at in range(0, max(len(text), 1), STRETCH):
        cps = codepoints(text[at : at + STRETCH + widest - 1])
        fresh = min(STRETCH, len(text) - at)
        for n in sizes:
            count = min(fresh, len(cps) - n + 1)
            if count <= 0:
                continue
            h = cps[:count] * np.uint32(0x9E3779B1) + np.uint32(n)
            for k in range(1, n):
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA77)
                h += cps[k : k + count] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x27D4EB2F)
            out += np.bincount(h >> shift, minlength=dim)
    return out


def count_rows(texts: Iterator[str], sizes: tuple[int, ...], dim: int, n: int) -> np.ndarray:
    rows = np.zeros((n, dim), dtype=np.float32)
    for i, t in enumerate(texts):
        rows[i] = bucket_counts(t, sizes, dim)
    return rows
