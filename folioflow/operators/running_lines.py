"""Running headers and footers: short lines at the edges of many pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X


def without_running_lines(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page", list_col: str = "paragraphs", min_pages: int = 3, ratio: float = 0.5, max_len: int = 120, edge: int = 2) -> DataFrame:
    """pages (one row each, with an array of paragraphs) less the paragraphs that run.

    A paragraph runs if it is one of the first or last `edge` of its page, at most max_len characters, and its
    key stands so on a share `ratio` of the document's pages, empty pages counted.  Documents under min_pages
    stay as they are.  A page gives a key once; the counts combine before they are shuffled, and only keys
    that run come back, one array for each document."""
    size = F.size(list_col)
    at_edge = lambda p, i: ((i < edge) | (i >= size - edge)) & (F.char_length(p) <= max_len)
    keys = F.array_distinct(F.transform(F.filter(list_col, at_edge), X.repeat_key))
    counted = pages.groupBy(doc_col).agg(F.count("*").alias("__pages"))
    seen = pages.select(doc_col, F.explode(keys).alias("__key")).groupBy(doc_col, "__key").agg(F.count("*").alias("__n"))
    running = seen.join(counted, doc_col).where((F.col("__pages") >= min_pages) & (F.col("__n") >= ratio * F.col("__pages"))).groupBy(doc_col).agg(F.collect_set("__key").alias("__running"))
    joined = pages.join(running, doc_col, "left")
    stays = lambda p, i: ~(at_edge(p, i) & F.coalesce(F.array_contains(F.col("__running"), X.repeat_key(p)), F.lit(False)))
    return joined.withColumn(list_col, F.filter(list_col, stays)).drop("__running")


def needs_ocr(text, least: int = 30):
    """Pages with almost no text."""
    return F.char_length(F.coalesce(text, F.lit(""))) < least
