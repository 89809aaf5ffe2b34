"""Byte-level BPE over whole batches of text: vectorised pre-tokenisation, merges only for pieces not met before.

``PieceEncoder`` splits text by the rule of the public pattern (contractions, an optional space before a run of letters,
numbers or other marks, white space runs that leave their last mark to what follows). It works on arrays of code point
classes rather than with a regular expression, hashes every piece to 64 bits and asks the merge table only for pieces
that its cache lacks. The cache is bounded: at ``CACHE`` pieces it starts anew, which costs time and changes nothing.
Ids whose bytes are not the text's (two pieces of one hash, about one in 10**13 new pieces) are made anew by the library.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np

from gradewise.llm.texthash import WINDOW, codepoints, span_hashes

CACHE = 250_000
#: Code points and sorted positions that no piece crosses, to piece starts.
Splitter = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Suffixes that follow an apostrophe as a piece of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_APOSTROPHE = ord("'")
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point: white space, letter, number, anything else."""
    if not _CLASSES:
        import regex

        everything = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, everything):
                out[codepoints(m.group())] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def piece_starts(cps: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pieces start in ``cps``; ``breaks`` are sorted positions that no piece crosses (the first is 0)."""
    n = len(cps)
    kind = classes()[cps]
    edge = np.zeros(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[breaks] = True
    start = edge[:n].copy()
    is_break = np.zeros(n + 1, dtype=bool)
    is_break[breaks] = is_break[n] = True
    # the last mark of a white space run that is followed by something stands apart; a plain space joins what follows
    ends_space = np.flatnonzero((kind == SPACE) & edge[1:] & ~is_break[1:])
    start[ends_space] = True
    joins = ends_space[cps[ends_space] == 32]
    start[joins + 1] = False
    # contractions: an apostrophe that starts a piece, alone in its run, then one of the suffixes
    marks = np.flatnonzero((cps == _APOSTROPHE) & start)
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == LETTER) & ~is_break[marks + 1]]
    for m in marks.tolist():
        tail = cps[m + 1 : m + 3]
        two = chr(tail[0]) + chr(tail[1]) if len(tail) == 2 and not is_break[m + 2] else ""
        take = 2 if two in CONTRACTIONS else 1 if chr(tail[0]) in CONTRACTIONS else 0
        if take:
            start[m + 1] = False
            if m + 1 + take < n:
                start[m + 1 + take] = True
    return np.flatnonzero(start)


def safe_cut(cps: np.ndarray, starts: np.ndarray) -> int:
    """The last piece start that text after the window cannot move, or 0.

    Left out are pieces that touch the end or start within three code points of it (a contraction may go on), and a
    white space run that touches the end.
    """
    if len(starts) < 3:
        return 0
    kind = classes()[cps[-1]]
    run = len(cps)
    while run and classes()[cps[run - 1]] == kind:
        run -= 1
    good = starts[(starts < run) & (starts <= len(cps) - 8)]
    return int(good[-1]) if len(good) else 0


def _byte_marks() -> dict[str, int]:
    """The printable mark that stands for each byte in a JSON vocabulary: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a vocabulary file: ``.json`` of tokenizers or ``.tiktoken`` (that has no specials).

    In both the id of a piece is its merge rank.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        marks = _byte_marks()
        return {bytes(marks[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}, special
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, {}


class PieceEncoder:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        ranks, self.special = read_ranks(ranks_path)
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._fresh()

    def _fresh(self) -> None:
        self._keys = np.zeros(0, dtype=np.uint64)  # sorted
        self._slots = np.zeros(0, dtype=np.int64)  # of each key, a place in _at
        self._flat = np.zeros(0, dtype=np.uint32)
        self._at = np.zeros(1, dtype=np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Add sorted ``keys`` that are not known yet."""
        merge = self._bpe._core_bpe.encode_single_piece
        found = [merge(p.encode("utf-8", "replace")) for p in pieces]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        fresh = np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(counts.sum()))
        slots = np.arange(len(keys)) + len(self._at) - 1
        self._at = np.concatenate((self._at, self._at[-1] + np.cumsum(counts)))
        self._flat = np.concatenate((self._flat, fresh))
        where = np.searchsorted(self._keys, keys)
        self._keys, self._slots = np.insert(self._keys, where, keys), np.insert(self._slots, where, slots)

    def _encode(self, text: str, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many ids stand before each piece (one more entry than pieces)."""
        ends = np.append(starts[1:], len(cps))
        keys, first, which = np.unique(span_hashes(cps, starts, ends), return_index=True, return_inverse=True)
        if len(self._keys) + len(keys) > CACHE:
            self._fresh()
        place = np.searchsorted(self._keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = place < len(self._keys)
        new[inside] = self._keys[place[inside]] != keys[inside]
        if new.any():
            some = first[new]
            self._learn(keys[new], [text[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            place = np.searchsorted(self._keys, keys)
        slots = self._slots[place]
        lo, hi = self._at[slots][which], self._at[slots + 1][which]
        counts = hi - lo
        before = np.concatenate(([0], np.cumsum(counts)))
        index = np.arange(before[-1]) + np.repeat(lo - before[:-1], counts)
        return self._flat[index], before

    def encode_many(self, texts: list[str], split: Splitter = piece_starts) -> list[np.ndarray]:
        """The ids (uint32) of each text. ``split`` finds where pieces start; long texts go through in windows."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        group, size = [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                joined = "".join(texts[i] for i in group)
                cps = codepoints(joined)
                lens = np.array([len(texts[i]) for i in group])
                begins = np.concatenate(([0], np.cumsum(lens)[:-1]))
                starts = split(cps, begins)
                ids, before = self._encode(joined, cps, starts)
                cuts = before[np.searchsorted(starts, np.append(begins, len(cps)))]
                for k, i in enumerate(group):
                    out[i] = ids[cuts[k] : cuts[k + 1]]
            group, size = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > WINDOW:
                out[i] = np.concatenate([ids for _, ids in self.encode_windows(t, split)])
                continue
            if size + len(t) > WINDOW:
                flush()
            group.append(i)
            size += len(t)
        flush()
        return out

    def encode_with_special(self, texts: list[str]) -> list[np.ndarray]:
        """As ``encode_many``, but a special token's text gives its id."""
        if not self.special or not any(mark in t for t in texts for mark in self.special):
            return self.encode_many(texts)
        split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        parts = [split.split(t) for t in texts]
        plain = iter(self.encode_many([x for p in parts for x in p[0::2]]))
        out = []
        for p in parts:
            row = [next(plain) if k % 2 == 0 else np.array([self.special[x]], dtype=np.uint32) for k, x in enumerate(p)]
            out.append(np.concatenate(row))
        return out

    def encode_windows(self, text: str, split: Splitter = piece_starts) -> Iterator[tuple[str, np.ndarray]]:
        """A text of any length, a window and its ids at a time; windows end where a piece must start."""
        at, width = 0, WINDOW
        while at < len(text):
            window = text[at : at + width]
            cps = codepoints(window)
            starts = split(cps, np.array([0]))
            cut = len(cps) if at + width >= len(text) else safe_cut(cps, starts)
            if not cut:
                width *= 2
                continue
            starts = starts[starts < cut]
            yield window[:cut], self._encode(window[:cut], cps[:cut], starts)[0]
            at, width = at + cut, WINDOW

    def encode_plainly(self, text: str) -> np.ndarray:
        """The library's own ids, without the cache."""
        return np.array(self._bpe.encode_ordinary(text), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids joined; they need not be whole UTF-8 before the end."""
        return self._bpe.decode_bytes(ids.tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    """One encoder a worker process."""
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = PieceEncoder(ranks_path, pattern)
    return _ENCODERS[ranks_path]
