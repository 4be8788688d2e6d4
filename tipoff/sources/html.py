"""HTML rosters and box scores of two templates, links and season checks.

Parsing runs in ``mapInPandas`` over (url, html); everything that a pattern can do
is a native expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """All tables of a page: rows of (text, link) cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, str]]]] = []
        self.open: list[list[list[tuple[str, str]]]] = []
        self.text: list[str] | None = None
        self.link = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            self.text, self.link = [], ""
        elif tag == "a" and self.text is not None:
            self.link = dict(attrs).get("href") or self.link

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def _close(self) -> None:
        if self.text is not None and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append((" ".join("".join(self.text).split()), self.link))
        self.text = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.open:
            self._close()
            self.open.pop()


#: Pages of nothing but such tags and plain text are read by one pattern.
_TOKEN = re.compile(r"<(/?)(table|tr|td|th|thead|tbody|html|body)>|([^<&]+)")


def _plain_tables(page: str) -> list[list[list[tuple[str, str]]]] | None:
    """What ``_Tables`` finds in a page of plain tags; None if it has any other."""
    if "&" in page:
        return None
    found = _TOKEN.findall(page)
    if sum(2 + len(end) + len(tag) if tag else len(text) for end, tag, text in found) != len(page):
        return None
    parser = _Tables()
    start, stop, data = parser.handle_starttag, parser.handle_endtag, parser.handle_data
    for end, tag, text in found:
        if text:
            data(text)
        elif end:
            stop(tag)
        else:
            start(tag, [])
    return parser.tables


def tables(page: str) -> list[list[list[tuple[str, str]]]]:
    plain = _plain_tables(page or "")
    if plain is not None:
        return plain
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return parser.tables


NAMES, POSITIONS, HEIGHTS, CLASSES = ("name", "full name", "player"), ("pos", "pos.", "position"), ("ht", "ht.", "height"), ("yr", "yr.", "class", "cl.", "academic year", "year")
ROSTER = "url string, name string, position string, height string, class_year string, link string"
BOX = "url string, side int, name string, started int, minutes int, points int, fg string, fg3 string, ft string"


def _find(header: list[str], wanted: tuple[str, ...]) -> int:
    return next((i for i, h in enumerate(header) if h.lower() in wanted), -1)


def roster_rows(url: str, page: str) -> list[tuple]:
    """The first table with names, positions and heights or classes.

    A name is one column, a first and a last one, or several name columns joined;
    trailing digits go.
    """
    for table in tables(page):
        if not table:
            continue
        header = [c[0] for c in table[0]]
        name, pos, high, year = (_find(header, w) for w in (NAMES, POSITIONS, HEIGHTS, CLASSES))
        first, last = _find(header, ("first", "first name")), _find(header, ("last", "last name"))
        several = [i for i, h in enumerate(header) if h.lower() in NAMES]
        if pos < 0 or (name < 0 and (first < 0 or last < 0)) or (high < 0 and year < 0):
            continue
        out = []
        for row in table[1:]:
            cell = lambda i, row=row: row[i][0] if 0 <= i < len(row) else ""
            full = " ".join(filter(None, (cell(i) for i in several))) if several else f"{cell(first)} {cell(last)}"
            full = re.sub(r"\s*\d+$", "", full).strip()
            if full:
                out.append((url, full, cell(pos) or None, cell(high) or None, cell(year) or None, next((c[1] for c in row if c[1]), None)))
        return out
    return []


def labelled_rows(url: str, page: str) -> list[tuple]:
    """Cells of the second template say ``label: value``."""
    out = []
    for table in tables(page):
        for row in table:
            got = {}
            for text, link in row:
                label, colon, value = text.partition(":")
                if colon:
                    got[label.strip().lower()] = value.strip()
                elif link and "name" not in got:
                    got["name"], got["link"] = text, link
            if got.get("name") and any(k in got for k in POSITIONS + CLASSES):
                pick = lambda keys, got=got: next((got[k] for k in keys if got.get(k)), None)
                out.append((url, got["name"], pick(POSITIONS), pick(HEIGHTS), pick(CLASSES), got.get("link")))
    return out


def box_rows(url: str, page: str) -> list[tuple]:
    """Exactly the first two tables with minutes, goals and points.

    Starters come from a GS column or from STARTERS and RESERVES rows; totals and
    jersey numbers go.
    """
    found = []
    for table in tables(page):
        header = [c[0].upper() for c in table[0]] if table else []
        if {"MIN", "FG", "3PT", "FT", "PTS"} <= set(header):
            found.append((header, table[1:]))
    if len(found) < 2:
        return []
    out = []
    for side, (header, rows) in enumerate(found[:2]):
        at = {h: i for i, h in enumerate(header)}
        block = 0
        for row in rows:
            cell = lambda h, row=row: row[at[h]][0] if h in at and at[h] < len(row) else ""
            label = row[0][0] if row else ""
            if label.upper().startswith(("STARTERS", "RESERVES", "BENCH")):
                block = int(label.upper().startswith("STARTERS"))
                continue
            name = re.sub(r"^#?\d+\s+", "", cell("PLAYER") or label).strip()
            if not name or name.upper().startswith(("TOTAL", "TEAM")):
                continue
            number = lambda h: int(cell(h)) if re.fullmatch(r"\d+", cell(h)) else 0
            out.append((url, side, name, int(cell("GS") in ("*", "1")) if "GS" in at else block, number("MIN"), number("PTS"), cell("FG"), cell("3PT"), cell("FT")))
    return out


def parse(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows of every (url, html) page; broken or null pages give none."""
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for url, page in zip(frame.url, frame.html, strict=True) for r in rows_of(url, page)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, schema)


def rosters(pages: DataFrame) -> DataFrame:
    return parse(pages, roster_rows, ROSTER)


def labelled_rosters(pages: DataFrame) -> DataFrame:
    return parse(pages, labelled_rows, ROSTER)


def box_scores(pages: DataFrame) -> DataFrame:
    return parse(pages, box_rows, BOX)


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """Links that match, each once a page, in order."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))
    return pages.select("url", F.posexplode(found).alias("place", "link"))


class NoLinks(ValueError):
    """Pages that should have links had none: the site has probably turned us away."""


def game_links(pages: DataFrame, pattern: str) -> DataFrame:
    """The links of game-log pages; an error if any page has none.

    The check is one count; without it a throttled run would look like a season
    without games.
    """
    found = links(pages, pattern)
    empty = pages.select("url").join(found.select("url").distinct(), "url", "left_anti").count()
    if empty:
        raise NoLinks(f"{empty} pages without a link")
    return found


def season_of(html: Column, url: Column) -> Column:
    """From the title, else from the address."""
    found = lambda x: F.nullif(F.regexp_extract(x, "(\\d{4}-\\d{2,4})", 1), F.lit(""))
    return F.coalesce(found(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)), found(url))
