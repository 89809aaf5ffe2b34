"""A synthetic book of four archetype segments, made on executors from a hash of the row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.functions.columns import sigmoid


def _uniform(name: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), F.col("app_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(name: str, seed: int) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(name + "a", seed))) * F.cos(6.283185307179586 * _uniform(name + "b", seed))


def make_synthetic_book(spark: SparkSession, n: int = 12_000, seed: int = 7) -> DataFrame:
    """``app_id, score_date, obs, default, pd, x1, x2, cat, x1_woe, fantomas, channel``; the same rows for a seed."""
    u = _uniform("channel", seed)
    rows = spark.range(n).withColumnRenamed("id", "app_id").withColumns({
        "x1": _normal("x1", seed), "x2": _normal("x2", seed), "u_cat": _uniform("cat", seed),
        "channel": F.when(F.col("app_id") < 80, "tiny").when(u < 0.18, "miscal").when(u < 0.40, "inverted").otherwise("core"),
    })
    cat = F.when(F.col("u_cat") < 0.5, "A").when(F.col("u_cat") < 0.8, "B").otherwise("C")
    effect = F.when(F.col("u_cat") < 0.5, 0.0).when(F.col("u_cat") < 0.8, 0.4).otherwise(-0.3)
    z = -2.2 + 0.9 * F.col("x1") + 0.7 * F.col("x2") + effect
    true = sigmoid(F.when(F.col("channel") == "inverted", -2.0 - 1.7 * F.col("x1")).otherwise(z))
    pd = F.when(F.col("channel") == "miscal", F.least(F.greatest(sigmoid(z) * 2.4, F.lit(1e-4)), F.lit(0.95))).otherwise(sigmoid(z))
    bad = (_uniform("y", seed) < true).cast("int")
    day = F.floor(_uniform("day", seed) * 540).cast("int")
    out = rows.select("app_id", F.date_add(F.lit("2023-01-01").cast("date"), day).cast("timestamp").alias("score_date"), F.greatest((_uniform("obs", seed) < 0.85).cast("int"), bad).alias("obs"), bad.alias("default"), pd.alias("pd"), "x1", "x2", cat.alias("cat"), F.col("x1").alias("x1_woe"), "channel")
    return out.withColumn("fantomas", ((F.col("pd") < 0.03) & (_uniform("f", seed) < 0.04)).cast("int"))


def make_synthetic_db_table(spark: SparkSession, n: int = 12_000, seed: int = 7, portfolio: str = "PortfolioA") -> DataFrame:
    names = {"app_id": "SKP_CREDIT_CASE", "score_date": "DATE_DECISION", "obs": "TargetAObs", "default": "TargetA", "pd": "PD", "channel": "CHANNEL", "fantomas": "FLAG_FANTOMAS"}
    return make_synthetic_book(spark, n, seed).withColumnsRenamed(names).withColumn("PORTFOLIO", F.lit(portfolio))


def make_fake_executor(spark: SparkSession, table: DataFrame | None = None, n: int = 12_000, seed: int = 7, portfolio: str = "PortfolioA", hidden_columns: tuple[str, ...] = (), name: str = "schema.scores"):
    """An executor of SQL that knows one table, ``table`` or a synthetic one, by ``name``."""
    from gradewise.sources.metadata import SqlExecutor

    executor = SqlExecutor(spark, hidden_columns)
    executor.register(name, table if table is not None else make_synthetic_db_table(spark, n, seed, portfolio))
    return executor
