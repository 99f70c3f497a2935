"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a site if it stands on more than max_ratio of the site's pages, and on at least min_pages of them: on all, and on
two, of a site that has fewer. Pages of a site are its distinct texts: a page that is copied often is one page, or its
own lines would seem to be boilerplate. A page adds its distinct lines, so a site has at most (mean distinct lines of a
page) / max_ratio such lines: a site's list is small however many pages it has, and joins to pages by
site without exploding their lines a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, unused

_BLANK = " \t\r\f\x0b"


def line_keys(text):
    """A 64-bit hash of every line, without the white space around it."""
    return F.transform(F.split(text, "\n"), _key)


def _key(line):
    return F.xxhash64(F.btrim(line, F.lit(_BLANK)))


def boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5, copies: bool = False) -> DataFrame:
    """(site, pages, lines array<long>): each site's page total and the hashes of its boilerplate lines.

    The rows of a site that have the same text are one page, in its total and for its lines; with copies, each of them is one.
    """
    pages = df.where(F.col(text_col).isNotNull()).select(F.col(site_col).alias("site"), F.xxhash64(text_col).alias("text"), F.array_distinct(line_keys(F.col(text_col))).alias("lines"))
    if not copies:
        pages = pages.distinct()
    blank = F.xxhash64(F.lit(""))
    # One job for both counts: a page adds one row for itself (null) and one for each of its lines.
    counts = materialise(
        pages.select("site", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.filter("lines", lambda x: x != blank))).alias("line"))
        .groupBy("site", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("line").isNull() | (F.col("n") >= min(2, min_pages)))
    )
    totals = counts.where("line is null").select("site", F.col("n").alias("pages"))
    often = (
        counts.where("line is not null")
        .join(totals.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site")))
        .where((F.col("n") > max_ratio * F.col("pages")) & (F.col("n") >= F.least(F.lit(min_pages), F.greatest(F.lit(2), F.col("pages")))))
        .groupBy("site", "pages")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )
    return materialise(often)


def drop_site_lines(df: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5, copies: bool = False) -> DataFrame:
    """df with boilerplate lines of their site cut from its texts, and n_lines and n_dropped.

    Lines end at line feeds and compare without white space around them; the others stay as they were,
    in order. Blank lines are never boilerplate. A null text stays null with 0 lines; an empty text has one,
    blank line; if all lines go, the text is empty. Pages with a null site are one site. Rows of a site with the same text
    count as one page, or, with copies, each as one. An empty table gives an empty result. Columns n_lines and n_dropped of df are an error.
    """
    fresh(df, "n_lines", "n_dropped")
    site, bad, kept_lines = unused(df, "_site", "_lines", "_kept")
    found = boilerplate(df, site_col, text_col, max_ratio, min_pages, copies).select(F.col("site").alias(site), F.col("lines").alias(bad))
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), _key(x)))
    return (
        df.join(found, F.col(site_col).eqNullSafe(F.col(site)), "left")
        .withColumn(kept_lines, F.when(F.col(bad).isNull(), lines).otherwise(kept))
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)))
        .withColumn("n_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines") - F.size(kept_lines)))
        .withColumn(text_col, F.array_join(kept_lines, "\n"))
        .drop(site, bad, kept_lines)
    )
