"""HTML pages: title, description, text without chrome, tables, images, links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose text is noise, and attributes that may hold an image's address, best first
NOISE = ("script", "style", "footer", "nav", "aside", "iframe", "button")
SOURCES = ("data-src", "data-original", "data-lazy-src", "src")
_VOID = {"br", "img", "hr", "meta", "link", "input"}

SCHEMA = "struct<title:string,description:string,text:string,tables:array<string>,images:array<string>,links:array<string>>"


class _Page(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.description = base, "", None
        self.noise = self.in_title = self.in_table = 0
        self.text: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.images: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v for k, v in attrs if v}
        if tag in NOISE:
            self.noise += 1
        elif tag == "title":
            self.in_title += 1
        elif tag == "meta" and a.get("content") and (a.get("name") == "description" or a.get("property") == "og:description"):
            if self.description is None or a.get("name") == "description":
                self.description = a["content"]
        elif tag == "table":
            self.in_table += 1
            self.tables.append([])
        elif tag == "tr" and self.in_table:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.in_table and self.tables[-1]:
            self.tables[-1][-1].append("")
        elif tag == "img" and not self.noise:
            src = next((a[s] for s in SOURCES if a.get(s)), None)
            if src is None and a.get("srcset"):
                src = a["srcset"].split(",")[-1].split()[0]
            if src and not re.search(r"\.svg($|\?)", src, re.I):
                self.images.append(urljoin(self.base, src))
        elif tag == "a" and a.get("href"):
            self.links.append(urljoin(self.base, a["href"]))

    def handle_endtag(self, tag: str) -> None:
        if tag in NOISE:
            self.noise = max(0, self.noise - 1)
        elif tag == "title":
            self.in_title = max(0, self.in_title - 1)
        elif tag == "table" and self.in_table:
            self.in_table -= 1
            rows = [" | ".join(c.strip() for c in r) for r in self.tables[-1] if r]
            self.text.append("\n".join(rows))

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.noise:
            return
        elif self.in_table:
            if self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] += data
        elif data.strip():
            self.text.append(re.sub(r"\s+", " ", data.strip()))


def read_page(html: str | None, url: str | None) -> dict:
    """Fields of one page; a null or broken page gives what could be read."""
    p = _Page(url or "")
    p.feed(html or "")
    p.close()
    tables = ["\n".join(" | ".join(c.strip() for c in r) for r in t if r) for t in p.tables]
    return {
        "title": re.sub(r"\s+", " ", p.title).strip(), "description": p.description, "text": "\n".join(x for x in p.text if x),
        "tables": tables, "images": list(dict.fromkeys(p.images)), "links": list(dict.fromkeys(p.links)),
    }


def parse_html(html: Column, url: Column) -> Column:
    """The fields of read_page as a struct."""

    @F.pandas_udf(SCHEMA)
    def parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(h, u) for h, u in zip(html, url, strict=True)], columns=["title", "description", "text", "tables", "images", "links"])

    return parse(html, url)


def title(html: Column) -> Column:
    """The title without a parser: native, for scans that want nothing else."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def hrefs(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"href=\"([^\"]+)\"")))


def parse_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", parse_html(F.col("html"), F.col("url")).alias("p")).select("page_id", "url", "p.*")
