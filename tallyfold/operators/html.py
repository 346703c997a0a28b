"""Links and directory listings out of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: an anchor with an address, and the three cells of a listing row.
# Names in any case, quotes of either kind or none, texts over several lines.
ANCHOR = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|(?<=[=\s])[^\s>"']+)[^>]*>(.*?)</a>"""
LINK_CELL = r"""(?is)<td[^>]*?\bclass\s*=\s*["']?link\b[^>]*>\s*""" + ANCHOR
SIZE_CELL = r"""(?is)<td[^>]*?\bclass\s*=\s*["']?size\b[^>]*>([^<]*)</td>"""
DATE_CELL = r"""(?is)<td[^>]*?\bclass\s*=\s*["']?date\b[^>]*>([^<]*)</td>"""
ROW = r"(?i)<tr\b"
TABLE_END = r"(?i)</table"
TAG = r"<[^>]*>"
PARENT = "parent"


def joined_url(base: Column, name: Column) -> Column:
    """``base`` without outer slashes, a slash, and the name."""
    return F.concat(F.btrim(base, F.lit("/")), F.lit("/"), name)


def extract_links(pages: DataFrame, base: str, html: str, listing: bool = False) -> DataFrame:
    """One row per link, in page order: ``pos, href, name, url``; links back to the parent are dropped.

    With ``listing`` only links in a listing's link cell count.
    """
    pattern = LINK_CELL if listing else ANCHOR
    keep = [c for c in pages.columns if c != html]
    anchors = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 0)))
    named = anchors.select(
        *keep,
        "pos",
        F.regexp_extract("col", pattern, 1).alias("href"),
        F.regexp_replace(F.regexp_extract("col", pattern, 2), TAG, "").alias("name"),
    )
    named = named.where(~F.contains(F.lower("name"), F.lit(PARENT)))
    return named.withColumn("url", joined_url(F.col(base), F.col("name")))


def extract_listing(pages: DataFrame, base: str, html: str) -> DataFrame:
    """One row ``name, size, date, url`` per entry of a directory listing.

    Cells belong to the table row that they stand in; one that a row lacks is null.
    """
    keep = [c for c in pages.columns if c != html]
    parts = F.split(F.col(html), ROW)
    rows = pages.select(*keep, F.explode(F.slice(parts, 2, F.size(parts))).alias("_row"))
    rows = rows.withColumn("_row", F.get(F.split("_row", TABLE_END, 2), F.lit(0)))

    def found(pattern: str, group: int) -> Column:
        return F.get(F.regexp_extract_all("_row", F.lit(pattern), group), F.lit(0))

    rows = rows.select(
        *keep, found(LINK_CELL, 2).alias("name"), found(SIZE_CELL, 1).alias("size"), found(DATE_CELL, 1).alias("date")
    )
    rows = rows.withColumn("name", F.regexp_replace("name", TAG, "")).where(
        F.col("name").isNotNull() & ~F.contains(F.lower("name"), F.lit(PARENT))
    )
    return rows.withColumn("url", joined_url(F.col(base), F.col("name")))
