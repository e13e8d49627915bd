"""What the operators share on the side of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.tables import delete, forget, shared_dir, stored

__all__ = ["delete", "forget", "shared_dir", "stored"]

#: The separators of words, as a Java and RE2 regular expression.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a batch that goes to Python, where the session leaves it at Spark's default.
BATCH_BYTES = 4 << 20
DEFAULT_BATCH_BYTES = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task buffers on its way to Python: a batch of 10,000 long texts would be tens of megabytes on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, DEFAULT_BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(df: DataFrame, like: str) -> str:
    """A column name that the table does not have, in upper or lower case."""
    taken, name = {c.lower() for c in df.columns}, f"_{like}"
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def one_spaced(text: str = "text") -> Column:
    """The text with each run of separators replaced by one space."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, others left out before anything is moved."""
    return df.select(*(F.col(f"`{n}`") for n in names))
