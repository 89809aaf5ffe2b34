"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into overlapping chunks, and all chunks of a window of texts are pre-tokenised side by side, each as if
it stood alone. A chunk that begins inside a piece finds the pattern's rhythm after a few marks. The first piece start in
an overlap that both neighbours report, and that text after the left one cannot move, is the stitch: a piece depends only
on what follows its start, so from there on the right chunk's pieces are the text's. Chunks whose overlap holds no stitch
(a run of hundreds of letters) are joined and go again. The pieces between stitches are then encoded. Decoding
concatenates the raw bytes of the ids. A text of any length passes in windows, so memory does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.pieces import PieceEncoder, classes, encoder, piece_starts
from gradewise.llm.texthash import WINDOW, groups_by_size

#: Code points of a chunk, and of the overlap with the next one (at most a chunk).
CHUNK, OVERLAP = 2048, 128
#: The last marks of a chunk whose piece starts the text after it may move: a contraction may go on.
UNSURE = 8


def _pre_tokenise(cps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk and place of every piece start that the chunks ``cps[lo:hi]`` find alone, and each chunk's last sure place."""
    size = hi - lo
    at = np.cumsum(size) - size
    shift = lo - at
    own = cps[np.arange(int(size.sum())) + np.repeat(shift, size)]
    found = piece_starts(own, at)
    chunk = np.searchsorted(at, found, side="right") - 1
    kind = classes()[own]
    edges = np.union1d(np.flatnonzero(kind[1:] != kind[:-1]) + 1, at)
    last_run = edges[np.searchsorted(edges, at + size) - 1]  # it may go on after the chunk
    return chunk, found + shift[chunk], np.minimum(last_run - 1, at + size - UNSURE) + shift


def stitched_starts(cps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start in the texts that begin at ``begins`` (sorted, the first is 0), by overlapping chunks."""
    n = len(cps)
    ends = np.append(begins[1:], n)
    count = np.maximum(1, -(-(ends - begins) // CHUNK))
    text = np.repeat(np.arange(len(begins)), count)
    lo = begins[text] + CHUNK * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    while True:
        follows = np.append(text[1:] == text[:-1], False)
        hi = np.where(follows, np.minimum(np.append(lo[1:], 0) + OVERLAP, ends[text]), ends[text])
        chunk, start, sure = _pre_tokenise(cps, lo, hi)
        sure = np.where(hi == ends[text], n, sure)
        nearest = np.append(lo[1:], n)
        left = follows[chunk] & (start >= nearest[chunk]) & (start <= sure[chunk])
        right = (start < np.append(0, hi[:-1])[chunk]) & np.append(False, follows[:-1])[chunk]
        common = np.intersect1d(chunk[left] * (n + 1) + start[left], (chunk[right] - 1) * (n + 1) + start[right])
        joint, first = np.unique(common // (n + 1), return_index=True)
        stitch = np.full(len(lo), -1, dtype=np.int64)
        stitch[joint] = common[first] % (n + 1)
        lost = np.flatnonzero(follows & (stitch < 0))
        if not len(lost):
            break
        lo, text = np.delete(lo, lost + 1), np.delete(text, lost + 1)
    since = np.where(np.append(False, follows[:-1]), np.append(0, stitch[:-1]), lo)
    upto = np.where(follows, stitch, ends[text])
    return start[(start >= since[chunk]) & (start < upto[chunk])]


def checked(bpe: PieceEncoder, text: str, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The ids and their decoded bytes; ids whose bytes are not the text's are made anew."""
    raw = bpe.decode(ids)
    if raw != text.encode("utf-8", "replace"):
        ids = bpe.encode_plainly(text)
        raw = bpe.decode(ids)
    return ids, raw


def _in_parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(key, text) rows a window of text at a time."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for part in groups_by_size(sizes, WINDOW):
        rows = batch.slice(part.start, part.stop - part.start)
        yield rows.column(0), [t or "" for t in rows.column(1).to_pylist()]


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for keys, texts in _in_parts(batch):
                both = [checked(bpe, t, x) for t, x in zip(texts, bpe.encode_many(texts, stitched_starts), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.astype("<u4").tobytes() for x, _ in both], pa.binary()), pa.array([raw for _, raw in both], pa.binary())], names=["doc_id", "ids", "bytes"])

    return run, "doc_id long, ids binary, bytes binary"


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digester(path: str, pattern: str):
    """Ids, their bytes and both digests in one pass; ids and bytes stay in the worker, a window at a time."""

    def digests(bpe: PieceEncoder, windows) -> tuple[int, str, str]:
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for text, ids in windows:
            ids, raw = checked(bpe, text, ids)
            n += len(ids)
            of_ids.update(ids.astype("<u4").tobytes())
            of_bytes.update(raw)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for keys, texts in _in_parts(batch):
                if len(texts) == 1:  # it may be longer than a window
                    rows = [digests(bpe, bpe.encode_windows(texts[0], stitched_starts))]
                else:
                    rows = [digests(bpe, [x]) for x in zip(texts, bpe.encode_many(texts, stitched_starts), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, bytes``: the ids of each row's whole text as little-endian unsigned 32-bit integers, and their
    decoded bytes. Nulls, repeats and empty tables are treated as by ``round_trip_digests``."""
    run, schema = _encoder(ranks_path, pattern)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``, in no order.

    A null text counts as empty: no ids, digests of no bytes. Texts of every length take the same path and are never
    shuffled. Rows that repeat an id each give their own row, null ids stay null, other columns are not read, an empty
    table gives no rows. ``ranks_path`` must be readable on executors.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_digester(ranks_path, pattern), DIGEST_SCHEMA)
