"""Links of listing pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, position (from 0), href of every anchor whose href is in double quotes, by a pattern."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r'<a href="([^"]*)"'), 1)
    return pages.select(F.col(id_col).alias("page_id"), F.posexplode(found).alias("position", "href"))


class _Listing(HTMLParser):
    """In each row of a table within a division whose id has the prefix, the hrefs of anchors of the class."""

    def __init__(self, prefix: str, css: str):
        super().__init__()
        self.prefix, self.css = prefix, css
        self.divs: list[bool] = []
        self.rows: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "div":
            self.divs.append((named.get("id") or "").startswith(self.prefix))
        elif tag == "tr" and any(self.divs):
            self.rows.append([])
        elif tag == "a" and self.rows and any(self.divs) and self.css in (named.get("class") or "").split() and named.get("href"):
            self.rows[-1].append(named["href"])

    def handle_endtag(self, tag):
        if tag == "div" and self.divs:
            self.divs.pop()


def listing_links(page: str | None, base: str, prefix: str = "comp_", css: str = "contest-link", nth: int = 2) -> list[str]:
    """The nth such anchor of each row, as an absolute url."""
    parser = _Listing(prefix, css)
    parser.feed(page or "")
    parser.close()
    return [urljoin(base, r[nth - 1]) for r in parser.rows if len(r) >= nth]


def listing(pages: DataFrame, prefix: str = "comp_", css: str = "contest-link", nth: int = 2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, link, file_name (a link's last part)."""
    three = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            ids, links = [], []
            for k, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = listing_links(page, url or "", prefix, css, nth)
                ids += [k] * len(found)
                links += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(links, pa.string())], names=["page_id", "link"])

    made = three.mapInArrow(run, f"page_id {three.schema['page_id'].dataType.simpleString()}, link string")
    return made.withColumn("file_name", F.element_at(F.split("link", "/"), -1))
