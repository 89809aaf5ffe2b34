"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

1. Every document's full shingle set is hashed to 64 bits a shingle. One permutation: the set's hashes fall into
   ``SLOTS`` bins and each bin keeps its least one; an empty bin borrows from bins probed in a random order of its own
   (optimal densification). ``BANDS`` bands of ``ROWS`` bins give the bucket keys. At a similarity of 0.8 a pair shares
   no bucket with a probability of (1 - 0.8**4)**40, below 1e-9.
2. Documents with the same set fall together first; only one of them goes on.
3. In each bucket the document whose id comes first in that bucket's own random order is the hub, and each other member
   gets one edge to it: candidates grow with the members, not with their square.
4. Edges that signatures do not rule out are confirmed on full sets: first each document's likeliest edge, then those
   whose ends still stand in different components. The rest could join nothing.
5. A hub can miss a link between two of its bucket's other members. Documents that candidate edges connect form a
   family that holds every pair that shares a bucket. Where a family still has several components, its documents are
   dealt into blocks; pairs of blocks first ask, on signatures alone, which documents have a likely partner in another
   component, and only the sets of those few are then compared. Only block pairs reach a task, so neither a bucket nor a
   family is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.llm.components import connected_components
from gradewise.llm.store import materialize, release
from gradewise.llm.texthash import constants, groups_by_size, mix, shingle_sets

BANDS, ROWS = 40, 4
SLOTS = BANDS * ROWS
#: Documents, and shingles, in a block of a family; documents where only signatures are compared.
BLOCK, BLOCK_SHINGLES, SIGN_BLOCK = 1024, 1_000_000, 2048
#: Bits of the map of documents that have a candidate edge, and of the pages that Spark builds it from.
MARKS, _PAGE = 1 << 25, 32_768
#: A pair whose signatures agree in fewer slots than a similarity at the threshold gives, less this many standard
#: deviations, is not looked at on full sets. Small sets fill few slots by themselves, so their deviation is larger.
DEVIATIONS = 5.0
_U = np.uint64


def _probes() -> np.ndarray:
    rng = np.random.RandomState(20240229)
    return np.stack([rng.permutation(SLOTS) for _ in range(SLOTS)]).astype(np.int64)


_PROBES, _BAND_FACTORS = _probes(), constants(ROWS, 5)
_BAND_SEEDS = constants(BANDS, 11)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The ``SLOTS`` values (uint64) of a non-empty sorted set of hashes: least hash of each bin, empty bins densified."""
    bins = ((hashes >> _U(32)) * _U(SLOTS) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values = np.zeros(SLOTS, dtype=_U)
    full = np.zeros(SLOTS, dtype=bool)
    values[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _PROBES[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a band; the band is part of the key."""
    rows = mix(values).reshape(BANDS, ROWS)
    return mix((rows * _BAND_FACTORS).sum(axis=1, dtype=_U) + _BAND_SEEDS).view(np.int64)


def _sketcher(width: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in groups_by_size(np.array([len(t) for t in texts])):
                out = []
                for i, s in zip(ids[part], shingle_sets(texts[part], width), strict=True):
                    if len(s):
                        v = signature(s)
                        sums = np.array([s.sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)], dtype=_U).view(np.int64)
                        out.append((i, len(s), int(sums[0]), int(sums[1]), band_keys(v), (v & _U(0xFF)).astype(np.uint8).tobytes()))
                    else:
                        out.append((i, 0, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run, "id long, n_shingles long, set_a long, set_b long, bands array<long>, slots binary"


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``MARKS`` bits in which every id of ``ids`` has set one: 4 MB, however many ids there are."""
    rows = ids.select(_mark().alias("mark")).groupBy(F.floor(F.col("mark") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("mark") % _PAGE).alias("bits"))
    out = np.zeros((MARKS // _PAGE, _PAGE // 8), dtype=np.uint8)
    for r in rows.collect():
        out[r["page"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.reshape(-1)


def _mark() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(MARKS))


def _set_maker(width: int, marks):
    """The sets of documents whose id is marked; one text in ``MARKS`` / ids more, and no text is ever shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for part in groups_by_size(np.array([len(t) for t in texts])):
                sets = [s.tobytes() for s in shingle_sets(texts[part], width)]
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(sets)), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run, "id long, shingles binary"


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    joined = np.concatenate((a, b))
    joined.sort(kind="stable")
    common = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return 100 * common >= percent * (both - common)


def least_agreeing(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Slots that must agree before a pair, whose smaller set has so many shingles, is looked at exactly."""
    p = percent / 100
    return SLOTS * (p - DEVIATIONS * np.sqrt(p * (1 - p) / np.minimum(np.maximum(shingles, 1), SLOTS)))


def _sifter(percent: int):
    """Candidate pairs whose signatures do not rule a link out, and in how many slots they agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS) for k in (2, 3))
            m, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            agree = (a == b).sum(axis=1)
            mask = pa.array((100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (agree >= least_agreeing(np.minimum(m, n), percent)))
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (*batch.columns[:2], pa.array(agree, pa.int32()))], names=["src", "dst", "agree"])

    return run, "src long, dst long, agree int"


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, a, b = (batch.column(k) for k in range(4))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(a[k].as_buffer(), dtype=_U), np.frombuffer(b[k].as_buffer(), dtype=_U)
                keep[k] = similar(x, y, percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([src.filter(mask), dst.filter(mask)], names=["src", "dst"])

    return run, "src long, dst long"


def _likely_partners(left: np.ndarray, right: np.ndarray, i: int, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Slots in which row ``i`` of ``left`` agrees with each row of ``right``; 0 where a link is ruled out."""
    agree = (right == left[i]).sum(axis=1)
    agree[(agree < least_agreeing(np.minimum(sizes, n), percent)) | (100 * np.minimum(sizes, n) < percent * np.maximum(sizes, n))] = 0
    return agree


class _Side:
    """The documents of one block: ids, components, signatures and set sizes."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.ids, self.comps, self.sizes = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        self.slots = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), SLOTS)


def _block_seekers(left: _Side, right: _Side, percent: int) -> list[tuple[int]]:
    """Documents of either block that have a likely partner of another component in the other block."""
    found: set[int] = set()
    for i, own in enumerate(left.comps):
        agree = _likely_partners(left.slots, right.slots, i, left.sizes[i], right.sizes, percent)
        likely = np.flatnonzero((agree > 0) & (right.comps != own))
        if len(likely):
            found.add(int(left.ids[i]))
            found.update(right.ids[likely].tolist())
    return [(x,) for x in found]


def _block_links(left: _Side, right: _Side, percent: int) -> list[tuple[int, int]]:
    """Links between documents of two blocks that stand in different components; enough of them to connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    sets = {r[0]: np.frombuffer(r[4], dtype=_U) for r in (*left.rows, *right.rows)}
    for i, own in enumerate(left.comps):
        agree = _likely_partners(left.slots, right.slots, i, left.sizes[i], right.sizes, percent)
        agree[right.comps == own] = 0
        worth = np.flatnonzero(agree)
        for j in worth[np.argsort(-agree[worth], kind="stable")]:
            a, b = find(int(own)), find(int(right.comps[j]))
            if a != b and similar(sets[left.ids[i]], sets[right.ids[j]], percent):
                root[max(a, b)] = min(a, b)
                links.append((int(left.ids[i]), int(right.ids[j])))
    return links


def _block_pairs(compare, percent: int, names: list[str]):
    """Rows arrive sorted by block pair, so one block pair is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, high = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            found = compare(_Side(low), _Side(high or low), percent) if low and (high or key[1] == key[2]) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    yield from done()
                    key, low, high = r[:3], [], []
                (low if r[3] == r[1] else high).append(r[4:])
        yield from done()

    return run, ", ".join(f"{n} long" for n in names)


def _in_block_pairs(rows: DataFrame, blocks, parts: int) -> DataFrame:
    """``family, low, high, mine, ...``: the rows of each family that has several components, once for each pair of
    blocks that its own is in; ``blocks`` is how many blocks the family has."""
    mixed = rows.groupBy("family").agg(blocks.alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("family", "blocks")
    dealt = (
        rows.join(mixed, "family")
        .withColumn("mine", F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", *[c for c in rows.columns if c != "family"])
    )
    return dealt.repartition(parts, "family", "low", "high").sortWithinPartitions("family", "low", "high")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| of their ``width``-word shingle sets;
    a component is what links connect and ``component_id`` its smallest id. Null, empty and blank texts have no
    shingles and are linked with nothing. A null id gets a row of its own with a null component. Rows that repeat an id
    keep their own rows; the id's component is the smallest of theirs. Other columns are not read. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch, sketch_schema = _sketcher(width)
    sketches = materialize(source.mapInArrow(sketch, sketch_schema), "sketches")
    filled = sketches.where("set_a is not null and id is not null")
    alike = ["set_a", "set_b"]
    first = filled.groupBy(*alike).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = filled.select("id", *alike).join(first.where("copies > 1"), alike).where("id != rep").select("id", *alike, "rep")
    copies = materialize(copies.distinct(), "copies")
    reps = filled.join(copies, ["id", *alike], "left_anti")

    keyed = reps.select("id", F.explode("bands").alias("bucket"))
    # id xor bucket is a random order of the bucket's ids that gives the id back
    order = F.col("id").bitwiseXOR(F.col("bucket"))
    hubs = keyed.groupBy("bucket").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("least").bitwiseXOR(F.col("bucket")).alias("hub"))
    stars = keyed.join(hubs, "bucket").where("id != hub").select(F.least("id", "hub").alias("src"), F.greatest("id", "hub").alias("dst")).distinct()
    stars = materialize(stars, "stars")

    signs = reps.select("id", "slots", "n_shingles")
    sift, sift_schema = _sifter(percent)
    paired = stars.join(signs.toDF("src", "a", "m"), "src").join(signs.toDF("dst", "b", "n"), "dst").select("src", "dst", "a", "b", "m", "n")
    likely = materialize(paired.mapInArrow(sift, sift_schema), "likely")
    marks = spark.sparkContext.broadcast(_marks(stars.select(F.explode(F.array("src", "dst")).alias("id"))))
    maker, set_schema = _set_maker(width, marks)
    sets = materialize(source.where("id is not null").withColumn("mark", _mark()).mapInArrow(maker, set_schema), "sets")
    marks.destroy()
    confirm, link_schema = _confirmer(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        used = sets.join(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
        a, b = used.toDF("src", "a"), used.toDF("dst", "b")
        return materialize(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(confirm, link_schema), "links")

    ends = likely.select("src", "dst", "agree", F.explode(F.array("src", "dst")).alias("id"))
    likeliest = ends.groupBy("id").agg(F.max(F.struct("agree", "src", "dst")).alias("x")).select("x.src", "x.dst").distinct()
    links = confirmed(likeliest)
    standing = connected_components(links)
    apart = likely.join(standing.toDF("src", "c"), "src", "left").join(standing.toDF("dst", "d"), "dst", "left")
    links_apart = confirmed(apart.where(F.coalesce("c", "src") != F.coalesce("d", "dst")).select("src", "dst"))
    joined = materialize(connected_components(links.union(links_apart)), "joined")
    family = materialize(connected_components(stars), "family")

    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = (
        family.select("id", F.col("component").alias("family"))
        .join(joined, "id", "left")
        .join(signs, "id")
        .select("family", "id", F.coalesce("component", "id").alias("component"), "slots", "n_shingles")
    )
    seek, seek_schema = _block_pairs(_block_seekers, percent, ["id"])
    seekers = _in_block_pairs(members, F.ceil(F.count("*") / SIGN_BLOCK), parts).mapInArrow(seek, seek_schema).distinct()
    seekers = materialize(seekers, "seekers")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    compare, _ = _block_pairs(_block_links, percent, ["src", "dst"])
    asked = members.join(seekers, "id", "left_semi").join(sets.join(seekers, "id", "left_semi"), "id").select("family", "id", "component", "slots", "n_shingles", "shingles")
    more = materialize(_in_block_pairs(asked, blocks, parts).mapInArrow(compare, link_schema), "more")
    stars_again = joined.where("id != component").select(F.col("id").alias("src"), F.col("component").alias("dst"))
    of_copies = copies.select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    final = materialize(connected_components(stars_again.union(more).union(of_copies)), "final")
    release(stars, likely, sets, links, links_apart, joined, family, seekers, more, copies)
    rows = sketches.select("id", "n_shingles").join(final, "id", "left")
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
