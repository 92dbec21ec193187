"""HTML pages: links, cards and Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Targets of a page's anchors with their ordinal."""
    found = F.regexp_extract_all(html, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("ord", "href"))


def cards(docs: DataFrame, key: str, html: str) -> DataFrame:
    """Embedded cards with ordinal, name and payload, self-closing or not."""
    found = F.regexp_extract_all(html, F.lit(r"<card\s+([^>]*?)/?>"), F.lit(1))
    rows = docs.select(key, F.posexplode(found).alias("ord", "attrs"))
    attr = lambda n: F.regexp_extract("attrs", rf"""{n}=["']([^"']*)["']""", 1)
    return rows.select(key, "ord", attr("name").alias("name"), attr("value").alias("value"))


class _Markdown(HTMLParser):
    """Collects Markdown from a stream of tags; unknown tags add only their text."""

    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.hidden, self.href, self.rows, self.cell = 0, "", None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "footer", "nav"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "pre":
            self.out.append("\n\n```\n")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag in ("ul", "ol"):
            self.out.append("" if self.lists else "\n")
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = "-" if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
            self.out.append("\n" + "  " * (len(self.lists) - 1) + mark + " ")
        elif tag == "a":
            self.href = a.get("href") or ""
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})" if a.get("src") else "")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = len(self.out)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag == "a":
            self.out.append(f"]({self.href})")
        elif tag == "pre":
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th") and self.cell is not None:
            text = "".join(self.out[self.cell :]).strip().replace("|", "\\|").replace("\n", "<br>")
            del self.out[self.cell :]
            self.rows[-1].append(text)
            self.cell = None
        elif tag == "table" and self.rows is not None:
            width = max(map(len, self.rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in self.rows]
            text = ["| " + " | ".join(r) + " |" for r in rows]
            if text:
                text.insert(1, "|" + " --- |" * width)
            self.out.append("\n\n" + "\n".join(text) + "\n\n")
            self.rows = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [x.rstrip() for x in "".join(parser.out).split("\n")]
    kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    return "\n".join(kept).strip()


@F.pandas_udf(T.StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    """Markdown of a page; null and empty pages give an empty text."""
    return html.map(markdown)
