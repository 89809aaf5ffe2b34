"""A scored book over the star-schema tables: four archetype segments with a repeatable pseudo-random target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The book as SQL that Spark and DuckDB read alike; ``{lineitem}`` and its kind name the tables.
BOOK_SQL = """
select l_orderkey, l_linenumber, score_date, x1, x2, cat, channel, obs, fantomas, case when u < pt then 1 else 0 end as y,
  case when channel = 'miscal' then least(greatest(p0 * 2.4e0, 1e-4), 0.95e0) else p0 end as pd
from (
  select *, 1e0 / (1e0 + exp(-(-2.2e0 + 0.9e0 * z1 + 0.7e0 * z2))) as p0,
    1e0 / (1e0 + exp(-(case when channel = 'inverted' then -2.0e0 - 1.7e0 * z1 else -2.2e0 + 0.9e0 * z1 + 0.7e0 * z2 end))) as pt
  from (
    select l_orderkey, l_linenumber, l_shipdate as score_date, nullif(l_quantity, 1e0) as x1, l_discount as x2, l_returnflag as cat,
      (l_quantity - 25.5e0) / 14.4e0 as z1, (l_discount - 0.05e0) / 0.0316e0 as z2,
      cast((l_orderkey * 48271 + l_partkey * 16807 + l_suppkey * 69621 + l_linenumber * 40692) % 10007 as double) / 10007e0 as u,
      case when (l_orderkey * 7 + l_partkey * 13 + l_linenumber) % 100 < 85 then 1 else 0 end as obs,
      case when (l_orderkey * 3 + l_suppkey * 11) % 100 < 4 then 1 else 0 end as fantomas,
      case when l_partkey % 100 = 0 then 'tiny' when c_mktsegment = 'MACHINERY' then 'inverted'
        when c_mktsegment = 'HOUSEHOLD' then 'miscal' else 'core' end as channel
    from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey) b) m
"""
ORACLE_BOOK = BOOK_SQL.format(lineitem="lineitem", orders="orders", customer="customer")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    return spark.sql(BOOK_SQL, **tables)
