"""A bounded, repeatable sample of labelled rows; the only rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Parts that a label's rows are limited in before they meet.
PARTS = 64


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: str = "id") -> DataFrame:
    """``key, label`` of up to ``per_label`` rows of each label, in hash order.

    Each label is limited in every task, then in ``PARTS`` parts, then as a whole: no task gets more than ``per_label``
    rows a part, whatever share of the rows a label has.
    """
    order = [F.xxhash64(key), key]
    part = F.pmod(F.xxhash64(key, F.lit(9)), F.lit(PARTS))
    limited = lambda df, *by: df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= per_label).drop("place")
    picked = limited(limited(rows.select(key, label).withColumn("part", part), label, "part"), label)
    return picked.dropDuplicates([key]).select(key, label)
