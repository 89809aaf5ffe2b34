"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words, in DataFrame functions only.

Sections are what stands between blank lines (two line feeds), paragraphs what stands between line feeds, leaves runs of
eight words. A paragraph's hash is SHA-256 of its text, a section's that of its paragraphs' hashes, the root's that of
its sections' hashes; equal roots mean equal texts. Short paragraphs have leaves of two words. The fingerprint writes the
tree out: ``root:section=paragraph.leaf.leaf|paragraph...;section=...`` with 64, 16, 16 and 8 hexadecimal digits. To
locate edits, branches are followed down from the root only where hashes differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAF, SHORT_LEAF = "[^ ]+(?: +[^ ]+){0,7}", "[^ ]+(?: +[^ ]+)?"
#: Paragraphs of fewer code points are short.
SHORT = 120
#: Rows that share a window, as long as there are at most so many windows (which bounds what is broadcast: 24 MB). Beyond
#: that windows grow; they stream from sorted, spilled rows.
ROWS, MOST_BUCKETS = 2000, 1 << 20
#: Quantiles of the ids between which buckets are equally wide, and their accuracy.
STEPS, ACCURACY = 64, 20_000


def _paragraph(p: Column) -> Column:
    runs = F.when(F.length(p) < SHORT, F.regexp_extract_all(p, F.lit(SHORT_LEAF), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)))
    leaves = F.transform(runs, lambda x: F.substring(F.md5(x.cast("binary")), 1, 8))
    return F.struct(F.sha2(p.cast("binary"), 256).alias("hash"), leaves.alias("leaves"))


def _section(s: Column) -> Column:
    return F.transform(F.split(s, "\n"), _paragraph)


def _digest(hashes: Column) -> Column:
    return F.sha2(F.concat_ws(",", hashes).cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text; null counts as empty."""
    tree = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _section)
    sections = F.transform(tree, lambda ps: F.struct(_digest(ps["hash"]).alias("hash"), F.transform(ps, lambda p: F.concat_ws(".", F.array(F.substring(p["hash"], 1, 16)), p["leaves"])).alias("parts")))
    # a list of one lets both uses share one evaluation of the tree
    both = F.transform(F.array(sections), lambda ss: F.concat(_digest(ss["hash"]), F.lit(":"), F.concat_ws(";", F.transform(ss, lambda s: F.concat(F.substring(s["hash"], 1, 16), F.lit("="), F.concat_ws("|", s["parts"]))))))
    return both[0]


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def leaves(print_: Column) -> Column:
    """The distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("[.]([0-9a-f]{8})"), F.lit(1)))


def paragraphs(print_: Column) -> Column:
    """The paragraph hashes of a fingerprint in order."""
    return F.regexp_extract_all(print_, F.lit("[=|]([0-9a-f]{16})"), F.lit(1))


def likeness_of_leaves(same_root: Column, a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    shared = 2.0 * F.size(F.array_intersect(a, b))
    below_one = 1.0 - 1.0 / (total + 1.0)
    return F.when(same_root, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.least(shared / F.greatest(total, F.lit(1)), below_one))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the shared distinct leaves over all distinct leaves of both, and below 1."""
    return likeness_of_leaves(root(a) == root(b), leaves(a), leaves(b))


def sections(print_: Column) -> Column:
    """The sections of a fingerprint in order, each with its paragraphs."""
    return F.split(F.substring_index(print_, ":", -1), ";")


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of the paragraphs of ``a`` that ``b`` has nowhere: where an edit lies.

    Equal roots end the search, and so do sections that ``b`` has too; only the others are searched by paragraph.
    """
    theirs, known = paragraphs(b), F.transform(sections(b), lambda s: F.substring(s, 1, 16))
    mine = lambda s: F.when(F.array_contains(known, F.substring(s, 1, 16)), F.transform(paragraphs(s), lambda h: F.lit(None).cast("string"))).otherwise(paragraphs(s))
    at = F.transform(F.flatten(F.transform(sections(a), mine)), lambda h, i: F.when(h.isNotNull() & ~F.array_contains(theirs, h), i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: i.isNotNull()))


def _bucket(id_: Column, edges: list[float], per_step: int) -> Column:
    """The bucket of an id: the step between two ``edges`` that it falls in, by halves, then evenly inside the step."""

    def step(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            low, width = edges[lo], edges[hi] - edges[lo]
            inside = F.least(F.greatest(F.floor((id_ - F.lit(low)) * F.lit(per_step / width)), F.lit(0)), F.lit(per_step - 1)) if width > 0 else F.lit(0).cast("long")
            return inside + F.lit(lo * per_step)
        middle = (lo + hi) // 2
        return F.when(id_ < F.lit(edges[middle]), step(lo, middle)).otherwise(step(middle, hi))

    return step(0, len(edges) - 1)


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each carried column, of the row with the next smaller id (the last's is the first).

    Rows are dealt into buckets of neighbouring ids, between quantiles of the ids so that gaps and outliers among them
    leave buckets alike; each bucket also gets the first row of the next one as a guest, so no window spans the table.
    Rows with a null id have no next.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    got = ids.agg(F.percentile_approx("id", [k / STEPS for k in range(STEPS + 1)], ACCURACY).alias("q"), F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("n")).first()
    high = got["high"] or 0
    per_step = max(1, min(MOST_BUCKETS, -(-got["n"] // ROWS)) // STEPS)
    edges = sorted({float(x) for x in [got["low"] or 0, *(got["q"] or []), high + 1]})
    bucket = F.when(F.col("id").isNotNull(), _bucket(F.col("id").cast("double"), edges, per_step))
    tops = ids.where("id is not null").groupBy(bucket.alias("home")).agg(F.max("id").alias("top"))
    guests = tops.select(F.coalesce(F.lead("top").over(W.orderBy(F.desc("home"))), F.lit(high)).alias("id"), F.col("home").alias("visits"))
    rows = docs.withColumn("id", F.col(id_col)).withColumn("bucket", bucket).withColumn("guest", F.lit(0))
    invited = docs.withColumn("id", F.col(id_col)).join(F.broadcast(guests), "id").withColumn("bucket", F.col("visits")).withColumn("guest", F.lit(1))
    every = rows.unionByName(invited.select(*rows.columns))
    order = W.partitionBy("bucket").orderBy("guest", F.desc("id"), *[F.xxhash64(c) for c in carried])
    for c in carried:
        every = every.withColumn(f"next_{c}", F.when(F.col("id").isNotNull(), F.lead(c).over(order)))
    return every.where("guest = 0").drop("guest", "bucket", "id")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_at``.

    A null text counts as empty. The edited text is the text with its last floor(n_chars / 3) code points replaced by the
    first as many of the next document's (in descending id, after the last the first). Rows that repeat an id follow one
    another in the order of their texts' hashes; a row with a null id is its own edited text and has a null
    ``near_next``. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), fingerprint(text).alias("fingerprint"))
    rows = with_next(rows, "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    rows = rows.withColumn("edited", F.when(F.col("next_text").isNull() | (cut == 0), F.col("text")).otherwise(edited))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    rows = rows.withColumn("mine", leaves(F.col("fingerprint")))
    same = lambda c: root(F.col("fingerprint")) == root(F.col(c))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness_of_leaves(same("edited_fingerprint"), F.col("mine"), leaves(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness_of_leaves(same("next_fingerprint"), F.col("mine"), leaves(F.col("next_fingerprint"))).alias("near_next"),
        edited_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_at"),
    )
