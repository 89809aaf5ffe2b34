"""Packing of token sequences by cutting-stock column generation.

A document's ids are cut into pieces of ``capacity`` and a rest. The rests' lengths, in steps of ``STEP``, make a
histogram of at most ``capacity / STEP`` classes; that bounded table is all that the driver sees. There a linear program
over patterns (how many rests of each class share a sequence) is solved by column generation: a knapsack dynamic
program over the duals prices the next pattern. Patterns are rounded down; what that leaves over, at most a few rests a
pattern, is packed by best fit. Rests are ranked inside their class, and a rank finds its pattern, sequence and slot by
arithmetic, so assignment is a join with the table of rank intervals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gradewise.llm.pieces import encoder
from gradewise.llm.store import materialize

CAPACITY, STEP, EOS = 2048, 8, 1
#: Relative distance from the linear program's lower bound at which column generation ends.
GAP = 1e-3
#: Rows that are ranked in one task.
RANKED = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(path: str, pattern: str, capacity: int, eos: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                    size += len(texts[to])
                    to += 1
                rows = []
                for doc_id, ids in zip(doc_ids[at:to], bpe.encode_with_special(texts[at:to]), strict=True):
                    raw = ids.astype("<u4").tobytes() + eos.to_bytes(4, "little")
                    total = len(ids) + 1
                    rows += [(doc_id, s, min(capacity, total - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), total) for s in range(0, total, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                at = to

    return run


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most value in ``room`` units, and how many of each item give it."""
    worth = np.full(room + 1, -1.0)  # of one item that takes so many units
    worth[sizes] = values
    item = np.zeros(room + 1, dtype=np.int64)
    item[sizes] = np.arange(len(sizes))
    back = worth[::-1].copy()  # back[room - c] is the worth of c units
    best, took = np.zeros(room + 1), np.full(room + 1, -1, dtype=np.int64)
    gains = np.empty(room + 1)
    for w in range(1, room + 1):
        g = np.add(best[:w], back[room - w : room], out=gains[:w])  # a last item of w - v units on top of v
        j = int(g.argmax())
        if g[j] > best[w - 1]:
            best[w], took[w] = g[j], item[w - j]
        else:
            best[w] = best[w - 1]
    counts, w = np.zeros(len(sizes), dtype=np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            counts[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[room]), counts


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. The basis is small, and threaded LAPACK beside a JVM may stall for minutes."""
    m = len(a)
    both = np.hstack((a.astype(np.float64), np.eye(m)))
    for k in range(m):
        p = k + int(np.abs(both[k:, k]).argmax())
        if p != k:
            both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[k]
    return both[:, m:]


def _first_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A first basis: the largest size left and the fullest rest, used until a size runs out; then the next.

    Each pattern is the last with the size that it uses up, so they are independent.
    """
    left, out = demand.astype(np.float64).copy(), []
    while (alive := np.flatnonzero(left > 0)).size:
        pattern = np.zeros(len(sizes))
        big = alive[-1]
        pattern[big] = 1
        rest = room - int(sizes[big])
        fit = alive[sizes[alive] <= rest]
        if len(fit):
            size = sizes[fit]
            pattern[fit] += best_pattern(size * (1 + 1e-6 * size), size, rest)[1]
        times = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        k = int(times.argmin())
        left = left - times[k] * pattern
        left[k] = 0
        left[left < 1e-9] = 0
        out.append((k, pattern))
    done = {k for k, _ in out}
    rows = [p for _, p in out]
    for k in range(len(sizes)):  # sizes that ran out together with another
        if k not in done:
            alone = np.zeros(len(sizes))
            alone[k] = room // sizes[k]
            rows.append(alone)
    return np.array(rows)


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: counts by item) and how often each is used (fractions), to cover ``demand`` in fewest sequences.

    ``sizes`` ascend. A revised simplex over one basis of ``len(sizes)`` patterns; it ends when pricing finds no better
    pattern, the bound is within ``gap`` or half a sequence, or after ``rounds`` patterns.
    """
    patterns = _first_patterns(sizes, demand, room)
    inverse = _inverse(patterns.T.copy())
    use, bound = np.maximum(inverse @ demand, 0), float(sizes @ demand) / room
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        total = use.sum()
        if total - bound <= max(0.5, gap * total):
            break
        value, column = best_pattern(duals, sizes, room)
        bound = max(bound, duals @ demand / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        some = np.flatnonzero(column)
        direction = (inverse[:, some] * column[some]).sum(axis=1)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, use / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        use = np.maximum(use - theta * direction, 0)
        use[out] = theta
        patterns[out] = column
        if step % 200 == 199:
            inverse = _inverse(patterns.T.copy())
            use = np.maximum(inverse @ demand, 0)
        else:
            pivot = inverse[out] / direction[out]
            rows = np.flatnonzero(direction)
            inverse[rows] -= direction[rows, None] * pivot
            inverse[out] = pivot
    return patterns.astype(np.int64), use


def _best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[dict[int, int]]:
    """Sequences for ``left[k]`` items of ``sizes[k]``, largest first, each into the fullest that has room."""
    found: list[dict[int, int]] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    for k in np.argsort(-sizes, kind="stable").tolist():
        for _ in range(int(left[k])):
            free = next((w for w in range(int(sizes[k]), room + 1) if by_room[w]), None)
            if free is None:
                found.append({})
                at, free = len(found) - 1, room
            else:
                at = by_room[free].pop()
            found[at][k] = found[at].get(k, 0) + 1
            by_room[free - int(sizes[k])].append(at)
    return found


def plan(histogram: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rank intervals ``(class, from, to, first sequence, items a sequence, first slot)`` and how many sequences."""
    if not histogram:
        return [], 0
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns, use = column_generation(sizes, demand.astype(np.float64), room)
    times = np.floor(use + 1e-6).astype(np.int64)
    given = times @ patterns
    while (over := given > demand).any():  # a rounding error of the solver may give one too many
        k = int(np.flatnonzero(over)[0])
        p = int(np.flatnonzero((patterns[:, k] > 0) & (times > 0))[0])
        times[p] -= 1
        given = given - patterns[p]
    groups = [({int(k): int(patterns[p, k]) for k in np.flatnonzero(patterns[p])}, int(times[p])) for p in range(len(times)) if times[p]]
    groups += [(g, 1) for g in _best_fit(sizes, demand - given, room)]
    at, sequence, out = np.zeros(len(sizes), dtype=np.int64), 0, []
    for counts, n in groups:
        slot = 0
        for k, a in counts.items():
            out.append((int(sizes[k]), int(at[k]), int(at[k]) + a * n, sequence, a, slot))
            at[k] += a * n
            slot += a
        sequence += n
    return out, sequence


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, step: int = STEP, eos: int = EOS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row a piece.

    A document is its text's ids, special tokens' texts included, then ``eos``. A null text counts as empty and gives
    one piece of length 1. Rows that repeat an id are packed as documents of their own; other columns are not read; an
    empty table gives no rows. ``tokenizer_path`` must be readable on executors.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size_class = F.when(F.col("length") == capacity, F.lit(0)).otherwise(F.ceil(F.col("length") / step)).cast("int")
    pieces = materialize(source.mapInArrow(_cutter(tokenizer_path, pattern, capacity, eos), PIECES).withColumn("class", size_class), "pieces")
    counts = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    intervals, sequences = plan({c: n for c, n in counts.items() if c}, capacity // step)
    if counts.get(0):
        intervals.append((0, 0, counts[0], sequences, 1, 0))

    buckets = spark.createDataFrame([(c, max(1, -(-n // RANKED))) for c, n in counts.items()], "class int, buckets int")
    dealt = pieces.join(F.broadcast(buckets), "class").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "buckets"))
    before = W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("class", "bucket").agg(F.count("*").alias("n")).select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["class", "bucket"]).withColumn("rank", F.col("at") + F.col("ahead"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("c", "lo", "hi", "first", "a", "slot")])
    table = F.broadcast(spark.createDataFrame(intervals, schema))
    since = F.col("rank") - F.col("lo")
    placed = ranked.join(table, (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.floor(since / F.col("a"))).alias("sequence_id"), (F.col("slot") + since % F.col("a")).alias("slot")
    )
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
