"""Article text of raw pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = frozenset(("script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form"))
_BLOCK = frozenset(("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "blockquote"))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.in_title, self.title = 0, False, []
        self.article, self.all, self.in_article = [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipped += tag in _SKIP
        self.in_title |= tag == "title"
        self.in_article += tag in ("article", "main")
        if tag in _BLOCK:
            self._put("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skipped -= tag in _SKIP and self.skipped > 0
        if tag in _BLOCK:
            self._put("\n")
        if tag == "title":
            self.in_title = False
        self.in_article -= tag in ("article", "main") and self.in_article > 0

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self._put(data)

    def _put(self, data: str) -> None:
        self.all.append(data)
        if self.in_article:
            self.article.append(data)


def _clean(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def _read(html: str | None, least: int) -> tuple[str | None, str | None, str | None]:
    if not html:
        return None, None, None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    title = " ".join("".join(reader.title).split()) or None
    for mode, parts in (("article", reader.article), ("fallback", reader.all)):
        text = _clean(parts)
        if len(text) >= least:
            return title, text, mode
    return title, None, None


def extract(html: Column, least: int = 100) -> Column:
    """Struct (title, text, mode): the article's text, else all text, if that has ``least`` characters; else null."""

    @F.pandas_udf("title string, text string, mode string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(x, least) for x in pages], columns=["title", "text", "mode"])

    return run(html)
