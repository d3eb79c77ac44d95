"""Tables of HTML pages, with row and column spans expanded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Cells(HTMLParser):
    """Headings and cells in the page's order."""

    def __init__(self) -> None:
        super().__init__()
        self.heading, self.tables, self._open, self._text = "", [], None, []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.tables.append((self.heading, []))
        elif tag == "tr" and self.tables:
            self.tables[-1][1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1][1]:
            span = lambda k: max(1, min(1000, int(v))) if (v := attrs.get(k) or "1").isdigit() else 1
            self._open, self._text = (span("rowspan"), span("colspan")), []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._open, self._text = tag, []
        elif tag in ("br", "p", "div", "li") and isinstance(self._open, tuple):
            self._text.append(" ")

    def handle_data(self, data):
        if self._open:
            self._text.append(data)

    def handle_endtag(self, tag):
        text = " ".join("".join(self._text).split())
        if tag in ("td", "th") and isinstance(self._open, tuple):
            self.tables[-1][1][-1].append((*self._open, text))
            self._open = None
        elif tag == self._open:
            self.heading, self._open = text, None


#: A tag as pages mostly write them, and the elements whose content isn't read as tags.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z-]+(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^ \t\n\r\f"'<>=`/&]+))?)*)[ \t\n\r\f]*>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:=("[^"]*"|'[^']*'|[^ \t\n\r\f]+))?""")
_RAW = {"script", "style", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "title", "textarea"}


def parse(page: str) -> list[tuple[str, list]]:
    """(heading, rows of cells) of each table; a page with any other markup than plain tags is left to the parser whole."""
    parser, parts = _Cells(), _TAG.split(page)
    plain = not any("<" in text for text in parts[::4]) and _RAW.isdisjoint(map(str.lower, parts[2::4])) and not any(attrs for slash, attrs in zip(parts[1::4], parts[3::4]) if slash)
    if not plain:
        parser.feed(page)
        return parser.tables
    for k in range(1, len(parts), 4):
        slash, tag, attrs, text = parts[k : k + 4]
        if slash:
            parser.handle_endtag(tag.lower())
        else:
            parser.handle_starttag(tag.lower(), [(n.lower(), v[1:-1] if v[:1] in ('"', "'") else v) for n, v in _ATTRIBUTE.findall(attrs)] if attrs else [])
        if text:
            parser.handle_data(unescape(text) if "&" in text else text)
    return parser.tables


def grid(rows: list[list[tuple[int, int, str]]]) -> list[list[str]]:
    """Cells by row and column after every span is filled with its text."""
    out: list[dict[int, str]] = [{} for _ in rows]
    for i, row in enumerate(rows):
        col = 0
        for down, right, text in row:
            while col in out[i]:
                col += 1
            for r in range(i, min(i + down, len(rows))):
                for c in range(col, col + right):
                    out[r][c] = text
            col += right
    return [[row.get(c, "") for c in range(max(row, default=-1) + 1)] for row in out]


def read_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, heading, row_no, cells) of every table row of every page; pages without one give nothing."""
    kind = pages.schema[key].dataType.simpleString()
    context = pages.sparkSession.sparkContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, page in zip(frame[key], frame[html]):
                for t, (heading, rows) in enumerate(parse(page or ""), 1):
                    out += [(k, t, heading, r, cells) for r, cells in enumerate(grid(rows), 1)]
            yield pd.DataFrame(out, columns=[key, "table_no", "heading", "row_no", "cells"])

    # A file of one row group is one task, and rows as short as a page's sources are few bytes: pages are dealt anew.
    parts = max(context.defaultParallelism, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pages.select(key, html).repartition(parts, key).mapInPandas(run, f"`{key}` {kind}, table_no int, heading string, row_no int, cells array<string>")
