"""What web pages hold: visible text, links with their words, images, and text by weight of its tags.

Scripts and styles are skipped; descriptions, keywords and values of text inputs count as text.
Broken mark-up is read as far as it goes; a null page gives empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import clean_link

# The factor of X2 by tag and by font size.
TAG_FACTORS = {"bold": 1, "b": 1, "big": 1, "em": 1, "i": 1, "strong": 1, "h4": 1, "title": 2, "h3": 2, "h2": 4, "h1": 8}
FONT_FACTORS = {"4": 1, "5": 2, "6": 4, "7": 8}
_SILENT = ("script", "style")


class _Page(HTMLParser):
    def __init__(self, size: int):
        super().__init__(convert_charrefs=True)
        self.unit = int(2 * (size / 16384 + 1))
        self.open: dict[str, int] = {}
        self.font = "3"
        self.text: list[str] = []
        self.links: dict[str, str] = {}
        self.images: list[str] = []
        self.weighted: dict[int, str] = {}
        self.link: str | None = None
        self.error: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        if tag not in ("meta", "img", "input", "br", "hr", "frame", "link"):
            self.open[tag] = self.open.get(tag, 0) + 1
        target = at.get("href", "") if tag in ("a", "map", "area") else at.get("src", "") if tag == "frame" else ""
        if target and not re.match(r"(?i)mailto:|javascript:", target) and "window.open(" not in target.lower():
            self.links.setdefault(target, "")
            self.link = target
        if tag == "img" and at.get("src"):
            self.images.append(at["src"])
        if tag == "body" and at.get("background"):
            self.images.append(at["background"])
        if tag == "input" and at.get("type", "").lower() == "text" and at.get("value"):
            self.text.append(at["value"])
        if tag == "meta" and re.search("(?i)description|keywords", at.get("name", "")) and at.get("content"):
            self.text.append(at["content"])
            self._weigh(2, at["content"])
        if tag in ("font", "basefont"):
            self.font = at.get("size") or "3"

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.open[tag] -= 1
        if tag == "a":
            self.link = None

    def handle_data(self, data: str) -> None:
        if any(self.open.get(t) for t in _SILENT) or not data.strip():
            return
        self.text.append(data)
        if self.link is not None:
            self.links[self.link] = f"{self.links[self.link]} {data.strip()}".strip()
        factors = {f for t, f in TAG_FACTORS.items() if self.open.get(t)}
        if self.open.get("font") or self.open.get("basefont"):
            factors |= {FONT_FACTORS[self.font]} & set(FONT_FACTORS.values()) if self.font in FONT_FACTORS else set()
        for factor in sorted(factors):
            self._weigh(factor, data)

    def _weigh(self, factor: int, data: str) -> None:
        key = self.unit * factor
        self.weighted[key] = f"{self.weighted.get(key, '')} {' '.join(data.split())}".strip()


def parse_page(html: str | None) -> _Page:
    """The page as far as it can be read: what a marked section that is no mark-up hides stays unread, and ``error`` names it."""
    page = _Page(len(html or ""))
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError, IndexError) as odd:
        page.error = f"{type(odd).__name__}: {odd}"
    return page


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, links map<string,string>, images, weighted map<int,string>, error), links as written;
    ``error`` says where reading ended early."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [parse_page(h) for h in part["html"]]
            yield pd.DataFrame(
                {
                    "page_id": part["page_id"],
                    "url": part["url"],
                    "text": [" ".join(" ".join(p.text).split()) for p in found],
                    "links": [p.links for p in found],
                    "images": [list(dict.fromkeys(p.images)) for p in found],
                    "weighted": [p.weighted for p in found],
                    "error": [p.error for p in found],
                }
            )

    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {id_type}, url string, text string, links map<string,string>, images array<string>, weighted map<int,string>, error string")


def page_links(parsed: DataFrame) -> DataFrame:
    """(page_id, page, url, anchor): each link of a parsed page in full."""
    rows = parsed.select("page_id", F.col("url").alias("page"), F.explode("links").alias("link", "anchor"))
    return rows.select("page_id", "page", clean_link(F.col("link"), F.col("page")).alias("url"), "anchor")


def page_images(parsed: DataFrame) -> DataFrame:
    """(page_id, image): each image of a parsed page in full."""
    rows = parsed.select("page_id", "url", F.explode("images").alias("link"))
    return rows.select("page_id", clean_link(F.col("link"), F.col("url")).alias("image")).distinct()


def local_images(pages: DataFrame, images: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages whose image addresses are those of local copies: ``images`` is (page_id, image, local), as
    written in the page; the longest address is replaced first. Pages without such images stay."""
    swaps = images.groupBy(F.col("page_id").alias("_page")).agg(F.array_sort(F.collect_set(F.struct((-F.length("image")).alias("n"), "image", "local"))).alias("_swaps"))
    rows = pages.join(swaps, F.col(id_col) == F.col("_page"), "left")
    put = F.aggregate(F.coalesce("_swaps", F.expr("array()")), F.col(html_col), lambda h, s: F.replace(h, F.concat(F.lit('"'), s["image"], F.lit('"')), F.concat(F.lit('"'), s["local"], F.lit('"'))))
    return rows.withColumn(html_col, F.when(F.col("_swaps").isNull(), F.col(html_col)).otherwise(put)).drop("_page", "_swaps")


def link_targets(html: Column) -> Column:
    """Targets of all anchors, by pattern alone: the part of link reading that SQL can state."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href="([^"]*)\""""), 1)


def story_links(links: DataFrame, site: str, pattern: str) -> DataFrame:
    """Links of a site whose address matches the source's pattern."""
    return links.filter(F.col("url").startswith(site) & F.col("url").rlike(pattern)).dropDuplicates(["url"])


def body_between(html: Column, start: str, end: str) -> Column:
    """What lies between two comment tags; the whole page where they are missing."""
    body = F.regexp_extract(html, f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1)
    return F.when(body == "", html).otherwise(body)
