"""Page source: one item per fetched page, failed fetches included."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.functions.dates import utc
from contentflow.functions.text import page_document, page_text, page_title
from contentflow.sources.items import make_items


def read_pages(pages: DataFrame) -> DataFrame:
    """(url, html, status_code) landing rows to (url, title, text, html, status_code).

    A landing row of a failed fetch has no html: it keeps its status, an empty text and no title.
    """
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    html = F.col("html")
    return pages.select(
        "url",
        page_title(html).alias("title"),
        page_text(html).alias("text"),
        F.coalesce(html, F.lit("")).alias("html"),
        F.coalesce(status, F.lit(0)).alias("status_code"),
    )


def page_items(pages: DataFrame, *, as_of: datetime | str, extract_text: bool = True, source: str = "web") -> DataFrame:
    fetched = read_pages(pages)
    body = F.col("text") if extract_text else F.col("html")
    return make_items(
        fetched,
        content=page_document(F.col("title"), body, F.col("url")),
        source=source,
        natural_key=F.col("url"),
        metadata={"url": F.col("url"), "title": F.col("title"), "status_code": F.col("status_code")},
        timestamp=utc(as_of),
        keep=("url",),
    )
