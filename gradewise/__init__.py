"""Credit-score analytics on Spark."""

from pathlib import Path


#: Bytes of rows that Spark hands a Python worker at once. Buffers of that size stand several times over in executors.
ARROW_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark) -> None:
    """Let Python workers import this package where only the driver's path has it, and keep what they are handed at once
    small: a batch of 10,000 rows may hold any amount of text."""
    set_bytes = spark.conf.get(_ARROW_BYTES)
    if not set_bytes.rstrip("b").isdigit() or int(set_bytes.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(_ARROW_BYTES, f"{ARROW_BYTES}b")
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)
