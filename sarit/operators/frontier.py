"""URLs and the crawl frontier as tables: every step is a function from tables to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of paths that are no article.
NOT_ARTICLES = ("jpg jpeg png gif webp svg bmp ico avif mp4 webm mov avi mp3 wav ogg m4a pdf doc docx xls xlsx ppt pptx zip gz rar 7z css js json rss").split()


def path_of(url: Column) -> Column:
    """The lower-cased path of a URL, without query and fragment; empty for none, null for null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user and port, empty for none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_article(url: Column) -> Column:
    return F.coalesce(~path_of(url).rlike(r"\.(?:" + "|".join(NOT_ARTICLES) + ")$"), F.lit(False))


def is_wiki(url: Column) -> Column:
    host = host_of(url)
    return host.contains("wikipedia.org") | host.contains("wikisource.org") | host.contains("wikibooks.org")


def priority_of(category: Column, order: list[str]) -> Column:
    """The category's place in the list, the list's length for an unknown or null one."""
    place = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(F.coalesce(place, F.lit(0)) == 0, F.lit(len(order)).cast("bigint")).otherwise(place - 1)


def add_new(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """The frontier with the found URLs that it lacks, once each: that of least priority, then by all columns. A null
    URL is never added."""
    rest = sorted(set(found.columns) - {"url", "priority"})
    one = found.where("url is not null").groupBy("url").agg(F.min(F.struct("priority", *rest)).alias("x")).select("url", "x.*")
    return frontier.unionByName(one.join(frontier.select("url"), "url", "left_anti").select(*frontier.columns))


def requeue(frontier: DataFrame) -> DataFrame:
    """Claimed URLs are pending again, as after a crash."""
    return frontier.withColumn("crawl_state", F.when(F.col("crawl_state") == "claimed", "pending").otherwise(F.col("crawl_state")))


def claimable(frontier: DataFrame, n: int) -> DataFrame:
    """The n pending URLs of least priority, ties by URL."""
    return frontier.where("crawl_state = 'pending'").select("url", "priority").distinct().orderBy("priority", "url").limit(n)


def claim(frontier: DataFrame, n: int) -> DataFrame:
    """The frontier with those n claimed; the batch is n rows."""
    mine = claimable(frontier, n).select("url", F.lit(True).alias("_mine"))
    return frontier.join(F.broadcast(mine), "url", "left").withColumn("crawl_state", F.when(F.col("_mine") & (F.col("crawl_state") == "pending"), "claimed").otherwise(F.col("crawl_state"))).drop("_mine")


def mark(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """The frontier with state and characters of the results (url, new_state, new_chars), which hold a URL once."""
    joined = frontier.join(results, "url", "left")
    return joined.withColumn("crawl_state", F.coalesce("new_state", "crawl_state")).withColumn("n_chars", F.coalesce("new_chars", "n_chars")).drop("new_state", "new_chars")


def counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("crawl_state").agg(F.count("*").alias("n"))


# Most URLs of the second and the third strategy, and how many are enough.
CAPS, ENOUGH = {1: 20_000, 2: 10_000}, 50
#: The strategy of a wiki's own listing.
WIKI = -1


def discovered(strategies: DataFrame, cap: int, enough: int = ENOUGH, caps: dict[int, int] = CAPS) -> DataFrame:
    """site, url, rank of what the strategies (site, strategy, place, url) found.

    A wiki's own listing (strategy WIKI) is all that counts of a wiki that has one. Else strategies from 0 on follow each
    other: a further one counts only while all URLs so far, each once, are fewer than `enough`. Of a strategy the first
    caps[strategy] places count, of a site the first `cap` URLs in order. The caps are the feature; ranks are counted
    within a site."""
    rows = strategies.where("url is not null")
    wikis = rows.where((F.col("strategy") == WIKI) & is_wiki(F.concat(F.lit("http://"), "site", F.lit("/")))).select("site").distinct()
    rows = rows.join(wikis.withColumn("_wiki", F.lit(True)), "site", "left").where(F.when(F.col("_wiki"), F.col("strategy") == WIKI).otherwise(F.col("strategy") >= 0)).drop("_wiki")
    limit = F.least(F.lit(cap), *(F.when(F.col("strategy") == k, n).otherwise(cap) for k, n in caps.items())) if caps else F.lit(cap)
    listed = F.row_number().over(Window.partitionBy("site", "strategy").orderBy("place", "url"))
    rows = rows.groupBy("site", "strategy", "url").agg(F.min("place").alias("place")).withColumn("_at", listed).where(F.col("_at") <= F.greatest(F.lit(0), limit))
    first = rows.groupBy("site", "url").agg(F.min(F.struct("strategy", "place")).alias("x")).select("site", "url", "x.*")
    sizes = first.groupBy("site", "strategy").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("site").orderBy("strategy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = sizes.withColumn("_before", before).where(F.col("_before") < enough).select("site", "strategy")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("strategy", "place", "url"))
    return first.join(used, ["site", "strategy"]).withColumn("rank", rank).where(F.col("rank") <= cap).select("site", "url", "rank")


def wiki_api(url: Column) -> Column:
    """The address of a wiki's programming interface, null for other hosts."""
    return F.when(is_wiki(url), F.concat(F.lit("https://"), host_of(url), F.lit("/w/api.php")))


def sitemap_locations(xml: Column) -> Column:
    """The loc elements of a sitemap by local name, those of image and video namespaces left out."""
    return F.transform(F.filter(F.regexp_extract_all(xml, F.lit(r"<((?:(?!image:|video:)[A-Za-z0-9_]+:)?loc)\b[^>]*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</\1>"), F.lit(2)), lambda x: x != ""), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def is_nested(url: Column) -> Column:
    return path_of(url).rlike(r"\.xml(?:\.gz)?$")


def robots_sitemaps(text: Column) -> Column:
    """The addresses after `Sitemap:`, whatever its case."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.lower(x).startswith("sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.substring(x, 9, 2048), "\r", ""))), lambda x: x != "")
