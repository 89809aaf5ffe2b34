"""Line deduplication over every run of lines that is just long enough.

A line is what a line feed ends, or a sentence (a stop, then white space). From each line on, and back from each line, the
shortest run of ``least_words`` words is a chunk, one line or several; its key is a rolling hash
over the hashes of its lines. What a chunk holds depends on nothing around it, and the chunks inside a passage cover the
passage, so any passage of ``least_words`` words or more that repeats whole lines goes whole. A chunk that occurs earlier
(by document, then place) is removed once its bytes, white space at line ends apart, were compared with that first
occurrence's. A removed line so always stays where it stands first, though what stood around it there may go.

These runs stand in for boundaries chosen by a rolling hash: such boundaries fall too seldom in passages of a few lines to
find each of them, whereas the shortest runs, as independent of shifts, find all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.store import materialize, release
from gradewise.llm.texthash import codepoints, groups_by_size, mix, span_hashes

#: A chunk has so many words at least, unless the caller says otherwise.
LEAST_WORDS = 20
_U = np.uint64
_STOPS = np.array([ord(c) for c in ".!?"], dtype=np.uint32)


def _chunks(texts: list[str], least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Text, first code point, code point after the last, hash: of every chunk."""
    cps = codepoints("\n".join(texts) + "\n")
    sizes = np.array([len(t) + 1 for t in texts])
    ends_text = np.cumsum(sizes)
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
    stop = np.isin(cps, _STOPS)
    cut = cps == 10
    cut[1:] |= blank[1:] & stop[:-1]
    ends = np.flatnonzero(cut) + 1
    # a line's own text is between its first and last mark that is not blank
    inked = np.flatnonzero(~blank)
    if not len(inked):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    starts = np.concatenate(([0], ends[:-1]))
    a, b = np.searchsorted(inked, starts), np.searchsorted(inked, ends)
    full = a < b
    first, last = inked[a[full]], inked[b[full] - 1] + 1
    hashes = span_hashes(cps, first, last)
    word = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))
    words = word[last] - word[first]  # a line starts at a word
    owner = np.searchsorted(ends_text, first, side="right")
    n = len(first)
    total = np.concatenate(([0], np.cumsum(words)))
    begin, close = np.searchsorted(owner, owner), np.searchsorted(owner, owner, side="right")  # the lines of a line's text
    line = np.arange(n)
    stop_at = np.searchsorted(total, total[:-1] + least_words)
    start_at = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    onward, back = stop_at <= close, start_at >= begin
    pairs = np.unique(np.concatenate((line[onward] * (n + 1) + stop_at[onward], start_at[back] * (n + 1) + line[back] + 1)))
    since, upto = pairs // (n + 1), pairs % (n + 1)
    sums = np.concatenate(([_U(0)], np.cumsum(mix(hashes) * _weights(n))))
    key = mix((sums[upto] - sums[since]) * _inverse_weights(n + 1)[since] + (upto - since).astype(_U))
    doc = owner[since]
    base = np.concatenate(([0], ends_text[:-1]))[doc]
    return doc, first[since] - base, last[upto - 1] - base, key


_W = 0xD1342543DE82EF95
_W_INVERSE = pow(_W, -1, 1 << 64)


def _weights(n: int) -> np.ndarray:
    out = np.full(n, _W, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _inverse_weights(n: int) -> np.ndarray:
    out = np.full(n, _W_INVERSE, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _ranked_here(ids: pa.Array, keys: pa.Array, lo: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks of one batch: which to keep (one of each place), a salt (0: its hash's first here), and if that recurs here."""
    unknown, id_ = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    key = keys.to_numpy()
    by_hash = np.argsort(hash_, kind="stable")
    equal = hash_[by_hash][1:] == hash_[by_hash][:-1]
    many = np.zeros(len(by_hash), dtype=bool)
    many[1:] |= equal
    many[:-1] |= equal
    alone, order = by_hash[~many], by_hash[many]
    order = order[np.lexsort((lo[order], key[order], id_[order], unknown[order], hash_[order]))]
    same_hash = np.zeros(len(order), dtype=bool)
    same_hash[1:] = hash_[order][1:] == hash_[order][:-1]
    same_place = same_hash.copy()
    for column in (unknown, id_, key, lo):
        same_place[1:] &= column[order][1:] == column[order][:-1]
    order, same_hash = order[~same_place], same_hash[~same_place]
    again = np.zeros(len(order), dtype=bool)
    again[:-1] = ~same_hash[:-1] & same_hash[1:]
    salt = np.where(same_hash, (mix(key[order].view(_U) + lo[order].astype(_U)) >> _U(33)).astype(np.int64) + 1, 0)
    order, salt, again = np.append(alone, order), np.append(np.zeros(len(alone), dtype=np.int64), salt), np.append(np.zeros(len(alone), dtype=bool), again)
    return order, salt, again


#: Common hashes whose first place a task remembers; beyond it they are dealt as before, with the same result.
KNOWN = 100_000


def _deal_known(known: dict[int, tuple], ids: pa.Array, keys: pa.Array, lo: np.ndarray, hash_: np.ndarray, salt: np.ndarray, again: np.ndarray) -> None:
    """Salt the batch's first of a hash where the task already gave out an earlier place of it that is marked as recurring.

    So a hash that recurs in most batches sends one row a task, not one a batch, to the task that ranks it.
    """
    at = np.flatnonzero(again)
    some = pa.array(at)
    places = zip(ids.take(some).to_pylist(), keys.take(some).to_pylist(), lo[at].tolist(), strict=True)
    for i, h, (id_, key, since) in zip(at.tolist(), hash_[at].tolist(), places, strict=True):
        place = (id_ is None, id_ or 0, key, since)
        earlier = known.get(h)
        if earlier is not None and earlier < place:
            salt[i] = (hash((key, since)) & 0x7FFFFFFF) + 1
        elif earlier is not None or len(known) < KNOWN:
            known[h] = place


def _finder(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), [t or "" for t in batch.column(2).to_pylist()]
            found = [[a + part.start if k == 0 else a for k, a in enumerate(_chunks(texts[part], least_words))] for part in groups_by_size(np.array([len(t) for t in texts]))]
            if not found:
                continue
            at, lo, hi, key = (np.concatenate(c) for c in zip(*found, strict=True))
            keep, salt, again = _ranked_here(ids.take(pa.array(at)), keys.take(pa.array(at)), lo, key)
            place = pa.array(at[keep])
            _deal_known(known, ids.take(place), keys.take(place), lo[keep], key[keep], salt, again)
            yield pa.RecordBatch.from_arrays(
                [ids.take(place), keys.take(place), pa.array(lo[keep], pa.int64()), pa.array(hi[keep], pa.int64()), pa.array(key[keep].view(np.int64)), pa.array(salt), pa.array(again)],
                names=["id", "text_key", "lo", "hi", "hash", "salt", "again"],
            )

    return run


#: Bytes of quotes, or characters of texts, in one batch; bounds memory, not what is quoted.
QUOTED = 1 << 21
_BLANKS = " \t\n\x0b\x0c\r"
_LINE_END = re.compile(r"\n|(?<=[.!?])[ \t\x0b\x0c\r]")


def _lines(text: str) -> tuple[list[bytes], dict[int, int], dict[int, int]]:
    """The bytes of each line without white space around it, and the lines by first code point and by the one after the last."""
    lines, since, upto, at = [], {}, {}, 0
    for m in [*[m.end() for m in _LINE_END.finditer(text)], len(text)]:
        raw = text[at:m]
        line = raw.lstrip(_BLANKS)
        if line:
            since[m - len(line)] = len(lines)
            line = line.rstrip(_BLANKS)
            upto[at + len(raw.rstrip(_BLANKS))] = len(lines) + 1
            lines.append(line.encode("utf-8", "surrogatepass"))
        at = m
    return lines, since, upto


def cover(spots: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The fewest of ``spots`` (from, to, name) that cover what all of them cover."""
    out, end, best = [], -1, None
    for s in sorted(spots, key=lambda s: (s[0], -s[1])):
        if best and s[0] > end:
            out.append(best)
            end, best = best[1], None
        if s[1] > end and (best is None or s[1] > best[1]):
            best = s
    return [*out, best] if best else out


def _quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_key, blob, spots) to one row a spot with the bytes that stand there: all firsts, a cover of the others."""
    for batch in batches:
        ids, keys, blobs, lists = batch.columns
        bounds, spots = lists.offsets.to_pylist(), lists.values
        los, his, firsts = (spots.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "first"))
        rows, at, quotes, size = [], [], [], 0
        for k in range(len(batch)):
            lines, since, upto = _lines(_open(blobs[k].as_py()))
            here = list(zip(los[bounds[k] : bounds[k + 1]].tolist(), his[bounds[k] : bounds[k + 1]].tolist(), range(bounds[k], bounds[k + 1]), strict=True))
            for lo, hi, s in [x for x in here if firsts[x[2]]] + cover([x for x in here if not firsts[x[2]]]):
                rows.append(k)
                at.append(s)
                quotes.append(b"\n".join(lines[since[lo] : upto[hi]]))
                size += len(quotes[-1])
            if quotes and (size > QUOTED or k == len(batch) - 1):
                found, here = pa.array(rows), pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(found), keys.take(found), *(spots.field(c).take(here) for c in ("lo", "hi", "hash", "first")), pa.array(quotes, pa.binary())],
                    names=["id", "text_key", "lo", "hi", "hash", "first", "quote"],
                )
                rows, at, quotes, size = [], [], [], 0


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, compressed: texts move between tasks in that form."""
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        texts = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "blob"])


def _open(blob: bytes | None) -> str | None:
    return None if blob is None else zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``; white space up to the next line goes with each."""
    out, at = [], 0
    for lo, hi in sorted(spans):
        if lo > at:
            out.append(text[at:lo])
        if hi > at:
            while hi < len(text) and text[hi] in " \t\r\x0b\x0c":
                hi += 1
            at = hi + (text[hi : hi + 1] == "\n")
    out.append(text[at:])
    return "".join(out)


def _remove(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, size, since = [], [], 0, 0
            blobs, lists = batch.column(columns), batch.column(columns + 1)
            for k in range(len(batch)):
                text, spans = _open(blobs[k].as_py()), lists[k].as_py()
                short = without(text, [(s["lo"], s["hi"]) for s in spans]) if text is not None and spans else text
                removed.append(len(text) - len(short) if short is not text else 0)
                texts.append(short)
                size += len(short or "")
                if size > QUOTED or k == len(batch) - 1:
                    part = [c.slice(since, len(texts)) for c in batch.columns[:columns]]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=[*batch.schema.names[:columns], "text", "removed"])
                    texts, removed, size, since = [], [], 0, k + 1

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs``, the text without repeated chunks, and ``removed_chars`` (last; 0 where nothing went).

    Every row stays, even where all its text goes. Shorter repeats than ``least_words`` words stay. Of a chunk's occurrences the first by id (null last), hash of the
    text and place stays; rows of one id and one text are alike, so both keep or lose the same. Null texts stay null,
    empty ones empty. Other columns pass through; one named ``removed_chars`` is replaced. An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in (text_col, "removed_chars")]
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), text.alias("text"))
    source = keyed.where("text is not null").select("id", "text_key", "text")
    chunks = source.mapInArrow(_finder(least_words), "id long, text_key long, lo long, hi long, hash long, salt long, again boolean")
    # one shuffle by hash; of a batch only the first of a hash can be the first of all, so the others are dealt anywhere;
    # rows of one id and one text tie, so both are first
    places = W.partitionBy("hash", "salt").orderBy(F.asc_nulls_last("id"), "text_key", "lo")
    ranked = chunks.select("id", "text_key", "lo", "hi", "hash", ((F.rank().over(places) == 1) & (F.col("salt") == 0)).alias("first"), (F.col("again") | F.lead("hash").over(places).isNotNull()).alias("more"))
    repeats = materialize(ranked.where("more or not first"), "repeats")
    spots = repeats.groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "hi", "hash", "first")).alias("spots"))
    squeezed = source.mapInArrow(_squeeze, "id long, text_key long, blob binary")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_key"] == b["text_key"])
    quoted = squeezed.join(spots, same(squeezed, spots)).select(squeezed["id"], squeezed["text_key"], "blob", "spots")
    quotes = materialize(quoted.mapInArrow(_quote, "id long, text_key long, lo long, hi long, hash long, first boolean, quote binary"), "quotes")
    release(repeats)
    kept = quotes.where("first").select("hash", "quote")
    gone = quotes.where("not first").join(kept, ["hash", "quote"], "left_semi").groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(gone, "spans")
    release(quotes)
    schema = T.StructType([keyed.schema["id"], keyed.schema["text_key"], keyed.schema["rest"], T.StructField("blob", T.BinaryType())])
    packed = keyed.select("id", "text_key", "rest", "text").mapInArrow(_squeeze, schema)
    joined = packed.join(spans, same(packed, spans), "left").select("rest", "blob", "spans")
    out_schema = T.StructType([keyed.schema["rest"], T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())])
    done = joined.mapInArrow(_remove(1), out_schema)
    order = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c != "removed_chars"]
    return done.select(*order, F.col("removed").alias("removed_chars"))
