"""Text source: one item per landed text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.functions.dates import utc
from contentflow.functions.text import strip
from contentflow.sources.items import make_items


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every landed file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def shape_text(text: Column, max_size: int | None = None, trim_whitespace: bool = True) -> Column:
    """The size limit counts before trimming, as when only so many characters are read."""
    if max_size is not None:
        text = F.substring(text, 1, max_size)
    return strip(text) if trim_whitespace else text


def text_items(
    texts: DataFrame,
    *,
    as_of: datetime | str,
    text: str = "text",
    key: str = "path",
    source: str = "cli",
    content_type: str = "text",
    max_size: int | None = None,
    trim_whitespace: bool = True,
) -> DataFrame:
    """Non-empty texts as items, with their size."""
    shaped = texts.withColumn(text, shape_text(F.col(text), max_size, trim_whitespace)).filter(F.col(text) != "")
    return make_items(
        shaped,
        content=F.col(text),
        source=source,
        natural_key=F.col(key),
        content_type=content_type,
        metadata={"size": F.length(text), "source": F.lit("stdin")},
        timestamp=utc(as_of),
    )
