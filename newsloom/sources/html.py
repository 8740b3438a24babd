"""Main text of web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Page furniture and content containers (fixed values).
FURNITURE_TAGS = {"nav", "header", "footer", "aside"}
FURNITURE_CLASS = re.compile(r"menu|nav|header|footer|sidebar")
CONTENT_CLASS = re.compile(r"article-content|post-content|entry-content|main-content")
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MIN_TEXT = 200


class _Page(HTMLParser):
    """Collects text below content containers and paragraphs, skipping furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str | None]] = []
        self.skipped = 0
        self.areas: dict[str, list[str]] = {}
        self.closed: set[str] = set()
        self.paragraphs: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        classes = (dict(attrs).get("class") or "").split()
        skip = tag in FURNITURE_TAGS or tag in ("script", "style", "template") or any(map(FURNITURE_CLASS.search, classes))
        area = None
        if not skip and not self.skipped:
            name = "div" if tag == "div" and any(map(CONTENT_CLASS.search, classes)) else tag
            if name in ("article", "main") or (name == "div" and any(map(CONTENT_CLASS.search, classes))):
                if name not in self.areas:
                    self.areas[name] = []
                    area = name
            if tag == "p":
                self.paragraphs.append([])
                area = area or "p"
        self.skipped += skip
        self.open.append((tag, skip, area))

    def handle_endtag(self, tag):
        if all(t != tag for t, _, _ in self.open):
            return
        while self.open:
            name, skip, area = self.open.pop()
            self.skipped -= skip
            if area and area != "p":
                self.closed.add(area)
            if name == tag:
                return

    def handle_data(self, data):
        text = data.strip()
        if not text or self.skipped:
            return
        for name, parts in self.areas.items():
            if name not in self.closed:
                parts.append(text)
        if any(a == "p" or t == "p" for t, _, a in self.open):
            self.paragraphs[-1].append(text)


def main_text(html: str | None) -> str | None:
    page = _Page()
    page.feed(html or "")
    page.close()
    choices = ["\n".join(page.areas[a]) for a in ("div", "article", "main") if a in page.areas]
    choices.append("\n".join("".join(p) for p in page.paragraphs))
    for text in choices:
        if len(text) > MIN_TEXT:
            return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()
    return None


def extract_main_text(pages: DataFrame, key: str, html: str, output: str = "content") -> DataFrame:
    """(key, content) per page; NULL where no container holds more than 200 characters."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], output: batch[html].map(main_text)})

    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, {output} string")
