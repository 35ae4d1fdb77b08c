"""Line dedup by site-relative frequency: a line on a large share of a host's pages is boilerplate.

A page is one text of a host, so mirrored copies of a page count once; where rows carry a group (``page``), all texts of a group
are one page of the host, so that a body shared by near copies alone is no boilerplate. Lines are compared without blanks around
them; blank lines are kept and never counted.

Defined results: NULL text stays NULL; a text of which every line goes becomes empty; NULL hosts form one host; hosts with few
pages lose nothing (``min_pages``); repeated rows are cleaned alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldcast.llm.shared import free_name, measured, need_columns

RATIO = 0.02
MIN_PAGES = 5
BROADCAST_LINES = 500_000
SALTS = 32


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, page: str | None = None) -> DataFrame:
    """(_host, _line): digests of lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least.

    ``page`` names a column that is alike for the texts of one page; where it is NULL, the text is the page.
    Counts are combined in each task first, and pages holding one line are spread over tasks by the page.
    """
    digest = _digest(F.col(text))
    of_page = F.coalesce(F.col(page).cast("string").cast("binary"), digest) if page else digest
    pages = docs.where(F.col(text).isNotNull()).select(_host(host).alias("_host"), of_page.alias("_page"), F.col(text).alias("_text"))
    totals = pages.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    lines = F.array_distinct(F.transform(F.split("_text", "\n"), lambda x: F.btrim(x)))
    seen = pages.select("_host", "_page", F.explode(F.filter(lines, lambda x: x != "")).alias("_line")).select("_host", "_page", _digest(F.col("_line")).alias("_line"))
    counts = seen.distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_on"))
    often = counts.where(F.col("_on") >= min_pages).join(totals, "_host")
    return often.where(F.col("_on") > ratio * F.col("_pages")).select("_host", "_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counted: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; other columns and the order of lines stay.

    ``counted`` names a column for the number of lines cut. ``pages`` holds the rows of ``docs`` with their page in ``_group``.

    A host's boilerplate has fewer lines than its mean page divided by ``ratio``, so it fits in one row of the host. These rows
    are broadcast when their counted lines are within BROADCAST_LINES; else documents and lists meet by host and salt.
    """
    need_columns(docs, host, text)
    frequent, seen = measured(boilerplate_lines(docs if pages is None else pages, host, text, ratio, min_pages, None if pages is None else "_group"), "boilerplate")
    of_host, drop, salt = (free_name(c, docs.columns) for c in ("_host", "_drop", "_salt"))
    lists = frequent.groupBy(F.col("_host").alias(of_host)).agg(F.collect_set("_line").alias(drop))
    rows, on = docs.withColumn(of_host, _host(host)), [of_host]
    if seen["rows"] <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    else:
        on = [of_host, salt]
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)))
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    kept = F.filter(F.split(text, "\n"), lambda x: (F.btrim(x) == "") | ~F.array_contains(F.col(drop), _digest(F.btrim(x))))
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    cut = F.when(F.col(drop).isNull() | F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n")) - F.size(kept))
    more = [cut.cast("long").alias(counted)] if counted else []
    return rows.join(lists, on, "left").select(*(cleaned.alias(c) if c == text else F.col(c) for c in docs.columns if c != counted), *more)
