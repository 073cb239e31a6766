"""Line de-duplication by site-relative frequency, in DataFrame functions only.

Pages are grouped by host.  A line's frequency on its host is the number of
pages that hold it over the host's pages; lines at or above a boilerplate
ratio go from all pages of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import SPACE, join_groups
from rillet.session import materialize


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading ``www.``; ``""`` if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def lines_of_html(html: Column) -> Column:
    """Lines of the visible text: scripts, styles, comments and tags become line breaks; blanks are trimmed and
    runs of them made one, empty lines go."""
    t = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        t = F.regexp_replace(t, pattern, "\n")
    t = F.regexp_replace(t, r"(?i)</?(?:b|i|em|strong|span|a)(?:\s[^>]*)?>", "")  # inside a line
    t = F.regexp_replace(t, r"<[^>]*>", "\n")
    return lines_of_text(t)


def lines_of_text(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"),
                          lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.filter(trimmed, lambda x: x != "")


def line_dedup(pages: DataFrame, page_id: str, host: Column, lines: Column, max_ratio: float = 0.3,
               min_pages: int = 3) -> DataFrame:
    """One row per input row: ``page_id, host, host_pages, n_lines, n_dropped, text`` (the lines left, joined by
    line feeds).

    A line goes from a host's pages when at least ``min_pages`` of them and more than the share ``max_ratio``
    hold it.  The boilerplate lines of one host are at most its mean number of distinct lines a page over
    ``max_ratio``, so they travel as one array a host; lines are counted by (host, digest), which parts a large
    host over all tasks.

    Null hosts form the host ``""``; null texts have no lines; repeated rows count as pages of their own; an
    empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"),
                        lines.alias("lines"))
    totals = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "host-pages")
    digest = F.transform(F.array_distinct("lines"), lambda x: F.unhex(F.md5(x.cast("binary"))))
    counts = rows.select("host", F.explode(digest).alias("line")).groupBy("host", "line") \
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = join_groups(counts, totals, "host", "host_pages").where(F.col("n") > max_ratio * F.col("host_pages"))
    hosts = totals.join(frequent.groupBy("host").agg(F.collect_list("line").alias("drop")), "host", "left") \
        .select(F.col("host").alias("__host"), "host_pages", F.coalesce("drop", F.array().cast("array<binary>")).alias("drop"))
    # A written table parts the join with the pages from the counts by host, so that a skewed host is split in it.
    both = rows.join(materialize(hosts, "line-hosts"), F.col("host") == F.col("__host"))
    # The host's list is looked through once a page, for the page's own boilerplate lines.
    both = both.withColumn("own", F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary")))))
    both = both.withColumn("hits", F.array_intersect("own", "drop"))
    both = both.withColumn("left", F.filter("lines", lambda x, i: ~F.array_contains("hits", F.col("own")[i])))
    return both.select("page_id", "host", "host_pages", F.size("lines").cast("bigint").alias("n_lines"),
                       (F.size("lines") - F.size("left")).cast("bigint").alias("n_dropped"),
                       F.array_join("left", "\n").alias("text"))
