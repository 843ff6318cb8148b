"""Arithmetic of a focused crawl over a table of pages: relevance, priority, link value, frontier.

Keywords are regular expressions in falling order of importance: keyword k weighs 1000 / 2**k.
Equal scores are told apart by a fraction below 1 from the hash of the key, so runs repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boolean_query import EDGE
from ..functions.text import content_digest
from ..functions.urls import base_of, site_of
from ..scratch import written

# Weights and limits.
RELEVANCE_WEIGHT = 1000.0
BASE_SCORE = 10.0
LEAST_LINK_VALUE = 30.0
LEAST_RELEVANCE = 10.0
LEAST_TEXT = 50


def _any(keywords: list[str]) -> str:
    return "(?i)(" + "|".join(keywords) + ")"


def relevancy(text: Column, keywords: list[str], tie: Column | None = None) -> Column:
    """The sum over all hits of their keyword's weight; 10 without keywords."""
    score = F.lit(BASE_SCORE)
    if keywords:
        hits = F.regexp_extract_all(text, F.lit(_any(keywords)), 1)

        def weight(hit: Column) -> Column:
            out = F.lit(0.0)
            for k, word in enumerate(keywords):  # the last that matches counts
                out = F.when(hit.rlike(f"(?i){word}"), F.lit(RELEVANCE_WEIGHT / 2**k)).otherwise(out)
            return out

        score = F.coalesce(F.aggregate(hits, F.lit(0.0), lambda s, h: s + weight(h)), F.lit(0.0))
    return score if tie is None else score + F.pmod(F.xxhash64(tie), F.lit(10_000)) / 10_000


def priority(links: DataFrame, keywords: list[str], search: str = "breadth", priority_domain: str | None = None) -> DataFrame:
    """Links (url, anchor, level) with ``priority``: base, domain, level, pages of the site, keywords."""
    rows = links.withColumn("site", site_of(F.col("url")))
    pages = rows.groupBy("site").agg(F.count("*").alias("site_pages"))
    score = F.lit(BASE_SCORE)
    if priority_domain:
        score = score + F.when(F.col("site").rlike(f"(?i){priority_domain}"), 100.0).otherwise(0.0)
    if search.lower().startswith("b"):
        score = score + RELEVANCE_WEIGHT / (F.col("level") * 10 + 1)
    elif search.lower().startswith("d"):
        score = score + F.col("level") * 10
    score = score - F.col("site_pages") * 10
    for column in ("url", "anchor"):
        for k, word in enumerate(keywords):
            score = score + F.when(F.col(column).rlike(f"(?i){word}"), RELEVANCE_WEIGHT / 2**k).otherwise(0.0)
    return rows.join(pages, "site").withColumn("priority", score)


def link_value(link: Column, anchor: Column, page: Column, keywords: list[str]) -> Column:
    """What a link is worth following; 0 for media, advertisements and odd links."""
    score = F.lit(BASE_SCORE)
    if keywords:
        for k, word in enumerate(keywords):
            hit = F.coalesce(anchor.rlike(f"(?i){word}"), F.lit(False)) | link.rlike(f"(?i){word}")
            score = score + F.when(hit, RELEVANCE_WEIGHT / 2**k).otherwise(0.0)
    else:
        score = score + RELEVANCE_WEIGHT
    below = F.contains(F.lower(link), F.lower(base_of(page))) | link.startswith("/")
    internal = link.startswith("/") | F.contains(F.lower(site_of(page)), F.lower(site_of(link)))
    score = score + F.when(below, 100.0).otherwise(0.0) + F.when(internal, 10.0).otherwise(30.0)
    odd = ~link.rlike(r"^[\w/]") | link.rlike(r"(?i)\.(jpg|jpeg|gif|pdf|ps|doc|xls|ppt|mpg|mpeg|gz)$") | link.rlike("(?i)doubleclick")
    return F.when(odd, 0.0).otherwise(score)


def abstract(text: Column, keywords: list[str] | None = None) -> Column:
    """The first 255 characters to a word's end; with keywords the first three places of one,
    30 characters around, and the first 155 if that is short. Odd characters become blanks."""
    mark = "..!!!.."
    if not keywords:
        out = F.concat(F.regexp_extract(text, rf"(?s)^(.{{0,255}}{EDGE})", 1), F.lit(mark))
    else:
        each = F.regexp_extract_all(text, F.lit(rf"(?is)({EDGE}.{{0,30}}(?:" + "|".join(k.strip() for k in keywords) + rf").{{0,30}}{EDGE})"), 1)
        out = F.array_join(F.transform(F.slice(each, 1, 3), lambda x: F.concat(x, F.lit(mark))), "")
        out = F.when(F.length(out) < 100, F.concat(out, F.regexp_extract(text, rf"(?s)^(.{{0,155}}{EDGE})", 1), F.lit(mark))).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit(mark), F.lit("\x01")), "[^a-zA-Z0-9.,;:\x01]", " "), " +", " ")
    return F.replace(out, F.lit("\x01"), F.lit("...\n"))


def judged_pages(pages: DataFrame, keywords: list[str], id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """Pages with digest, relevance and status: Duplicate (of a lesser id), Reject (short), Redirect
    (frame or moved), Done (relevant) or Reject."""
    rows = pages.withColumn("digest", content_digest(F.col(text_col))).withColumn("relevancy", relevancy(F.col(text_col), keywords))
    first = rows.groupBy("digest").agg(F.min(id_col).alias("_first"))
    rows = rows.join(first, "digest", "left")
    moved = F.col(text_col).rlike(r"(?i)\b(has|have) moved\b")
    status = (
        F.when(F.coalesce(F.length(F.trim(text_col)), F.lit(0)) < LEAST_TEXT, "Reject")
        .when(F.col(id_col) > F.col("_first"), "Duplicate")
        .when(moved, "Redirect")
        .when(F.col("relevancy") > (LEAST_RELEVANCE if keywords else 0), "Done")
        .otherwise("Reject")
    )
    return rows.withColumn("status", status).drop("_first")


def recomputed(links: DataFrame, pages: DataFrame, keywords: list[str], search: str = "breadth", priority_domain: str | None = None, key: str = "url") -> DataFrame:
    """Crawl links (url, anchor, level, status, priority, relevance) with the priority of those New, if
    above 0, and the relevance of those Done that have a page (url, text) worked out anew. ``key`` is by what
    links know their own page, where one address may have several."""
    scored = priority(links, keywords, search, priority_domain).select("url", F.col("priority").alias("_priority")).dropDuplicates(["url"])
    judged = pages.groupBy(key).agg(F.min("text").alias("_text")).select(key, relevancy(F.col("_text"), keywords).alias("_relevance"))
    rows = links.join(scored, "url", "left").join(judged, key, "left")
    rows = rows.withColumn("priority", F.when((F.col("status") == "New") & (F.col("priority") > 0), F.col("_priority")).otherwise(F.col("priority")))
    done = (F.col("status") == "Done") & F.col("_relevance").isNotNull()
    return rows.withColumn("relevance", F.when(done, F.col("_relevance")).otherwise(F.col("relevance"))).select(links.columns)


def status_log(events: DataFrame) -> DataFrame:
    """(crawl, log): the messages of each crawl (crawl, spider, at, message) in order of time, each as
    ``Sn h:mm:ss => message``, parted by marks."""
    entry = F.concat(F.lit("S"), F.col("spider").cast("string"), F.lit(" "), F.date_format("at", "H:mm:ss"), F.lit(" => "), F.col("message"))
    rows = events.groupBy("crawl").agg(F.array_sort(F.collect_list(F.struct("at", "spider", entry.alias("e")))).alias("rows"))
    return rows.select("crawl", F.array_join(F.transform("rows", lambda r: r["e"]), " ### ").alias("log"))


def within_limits(visits: DataFrame, most_urls: int | None = None, most_hours: float | None = None) -> DataFrame:
    """The visits (crawl, url, at) that a crawl's limits allow: its first ``most_urls`` by time, and none
    later than ``most_hours`` after its first."""
    order = Window.partitionBy("crawl").orderBy("at", "url")
    rows = visits.withColumn("_k", F.row_number().over(order)).withColumn("_first", F.min("at").over(Window.partitionBy("crawl")))
    if most_urls is not None:
        rows = rows.filter(F.col("_k") <= most_urls)
    if most_hours is not None:
        rows = rows.filter(F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("_first").cast("timestamp")) <= most_hours * 3600)
    return rows.drop("_k", "_first")


def restarted(links: DataFrame, blocked: list[str] | None = None, selected: list[str] | None = None) -> DataFrame:
    """Links as a crawl finds them when it starts: those left in Visiting are New, those of blocked or not selected sites go."""
    rows = links.withColumn("status", F.when(F.col("status") == "Visiting", "New").otherwise(F.col("status")))
    if blocked:
        rows = rows.filter(~site_of(F.col("url")).isin(blocked))
    if selected:
        rows = rows.filter(site_of(F.col("url")).isin(selected))
    return rows


def allowed_links(links: DataFrame, seen: DataFrame, site_quota: int | None = None, blocked: list[str] | None = None, selected: list[str] | None = None, most_slashes: int | None = None) -> DataFrame:
    """New links (url, ...): not seen, of allowed sites, not too deep, within the quota of their site (best priority first)."""
    rows = links.withColumn("site", site_of(F.col("url"))).join(seen.select("url").distinct(), "url", "left_anti")
    if blocked:
        rows = rows.filter(~F.col("site").isin(blocked))
    if selected:
        rows = rows.filter(F.col("site").isin(selected))
    if most_slashes is not None:
        rows = rows.filter(F.length(F.regexp_replace("url", "[^/]", "")) <= most_slashes)
    rows = rows.dropDuplicates(["url"])
    if site_quota is not None:
        held = seen.withColumn("site", site_of(F.col("url"))).groupBy("site").agg(F.count("*").alias("_held"))
        order = Window.partitionBy("site").orderBy(F.desc("priority"), "url")
        rows = rows.join(held, "site", "left").withColumn("_k", F.row_number().over(order) + F.coalesce("_held", F.lit(0))).filter(F.col("_k") <= site_quota).drop("_k", "_held")
    return rows


def crawl(start: DataFrame, links: DataFrame, rounds: int, batch: int | None = None, keywords: list[str] | None = None, search: str = "breadth", **limits) -> DataFrame:
    """(url, level, priority): pages reached from ``start`` (url) over ``links`` (page, url, anchor).

    Each round visits the ``batch`` best links (all of them by default) and adds those they lead
    to; rounds are written to the shared folder.
    """
    spark_links = links.select(F.col("page").alias("_page"), "url", "anchor")
    frontier = start.select("url", F.lit("").alias("anchor"), F.lit(0).alias("level")).distinct()
    frontier = written(priority(frontier, keywords or [], search).select("url", "anchor", "level", "priority"), "frontier")
    visited = frontier.limit(0)
    for _ in range(rounds):
        now = frontier if batch is None else frontier.orderBy(F.desc("priority"), "url").limit(batch)
        now = written(now, "visited")
        if now.isEmpty():
            break
        visited = visited.unionByName(now)
        reached = now.select(F.col("url").alias("_page"), "level").join(spark_links, "_page").groupBy("url").agg(F.min(F.col("level") + 1).alias("level"), F.max("anchor").alias("anchor"))
        waiting = frontier.join(now.select("url"), "url", "left_anti")
        scored = priority(reached, keywords or [], search).select("url", "anchor", "level", "priority")
        fresh = allowed_links(scored, visited.select("url").union(waiting.select("url")), **limits).select("url", "anchor", "level", "priority")
        frontier = written(waiting.unionByName(fresh), "frontier")
    return visited.select("url", "level", "priority")
