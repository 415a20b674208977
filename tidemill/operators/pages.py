"""Text of web pages without what a site's pages have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.html import page_blocks
from tidemill.operators.keys import hash_pair, weighted_join
from tidemill.sources.tables import stored


def page_text(pages: DataFrame, least_pages: int = 3, share: float = 0.5) -> DataFrame:
    """page_id, host, n_blocks, n_boilerplate and text for each of pages (page_id, url, html).

    A page's visible text comes in blocks (functions.html). A block that stands on at least least_pages pages of a
    host and on at least `share` of them is boilerplate and goes; the rest, a line each, is the text. The host is the
    URL's, in lower case without port and user, empty where there is none. page_id must be a key; rows without one are left out.

    Pages of a block are counted after distinct pairs of block and page, so a host with a third of all pages is counted by all tasks; its
    boilerplate meets the pages by a join that sends heavy keys to all tasks.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    read = stored(pages.where("page_id IS NOT NULL").select("page_id", host.alias("host"), "html").mapInArrow(page_blocks, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, blocks array<string>"))
    h1, h2 = hash_pair(F.col("host"), F.col("block"))
    rows = read.select("page_id", "host", F.posexplode("blocks").alias("k", "block")).select("page_id", "host", "k", h1.alias("h1"), h2.alias("h2"))
    counts = rows.select("h1", "h2", "host", "page_id").distinct().groupBy("h1", "h2").agg(F.first("host").alias("host"), F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    hosts = read.groupBy("host").agg(F.count("*").alias("of"))
    common = counts.join(hosts, "host").where(F.col("n_pages") >= share * F.col("of")).select("h1", "h2", "n_pages")
    met = weighted_join(rows, common, "n_pages").where("n_pages IS NOT NULL")
    gone = met.groupBy("page_id").agg(F.array_sort(F.collect_list("k")).alias("gone"))
    known = read.join(gone, "page_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    cut = F.concat(F.array(F.lit(-1)), F.col("gone"))
    kept = F.flatten(F.transform(cut, lambda k, i: F.slice("blocks", k + 2, F.coalesce(F.get(F.col("gone"), i), F.size("blocks")) - k - 1)))
    return known.select("page_id", "host", F.size("blocks").cast("long").alias("n_blocks"), F.size("gone").cast("long").alias("n_boilerplate"), F.array_join(kept, "\n").alias("text"))
