"""Main content of web pages as text and Markdown: one pass, with a stack of open blocks."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript template svg nav header footer aside form button select textarea iframe object title".split())
BLOCKS = frozenset("p div section article main body figure figcaption dl dd dt details summary address center hgroup table thead tbody tfoot tr caption ul ol li blockquote pre h1 h2 h3 h4 h5 h6".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
SPACE = re.compile(r"\s+")
#: A start tag ends an open element of these, if none of those was opened since.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
#: Attributes of meta elements that name a page's title, author and day.
META = {"og:title": "title", "author": "author", "article:author": "author", "article:published_time": "day", "date": "day"}

CONTENT = "extracted_text string, extracted_markdown string, extracted_text_len long, meta_title string, meta_author string, meta_date string"


class Page(HTMLParser):
    """Blocks of a page, in order: (in the article, lead of the first line, lead of the others, Markdown, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str, str, str, str]] = []
        self.open: list[tuple[str, str]] = []  # open elements: tag, what closes its inline mark
        self.skipped = self.article = self.pre = 0
        self.lists: list[int | None] = []  # of open lists the number of the next item, None: bullets
        self.quotes = 0
        self.lead = ""
        self.marked: list[str] = []
        self.plain: list[str] = []
        self.cells: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self.count: Counter[str] = Counter()  # open elements of each tag

    def implied(self, tag: str) -> None:
        """Closes what a start tag ends without saying so."""
        if tag in ENDS:
            ended, stop = ENDS[tag]
        elif tag in BLOCKS and self.count["p"]:
            ended, stop = {"p"}, BLOCKS - {"p"}
        else:
            return
        if not any(self.count[t] for t in ended):
            return
        for last, _ in reversed(self.open):
            if last in ended:
                self.handle_endtag(last)
                return
            if last in stop:
                return

    def flush(self) -> None:
        """Ends the block that is open, if it has any text."""
        marked, plain = "".join(self.marked), "".join(self.plain)
        if not self.pre:
            marked, plain = SPACE.sub(" ", marked.replace("\0", "  \n")).strip() if "\0" not in marked else "  \n".join(SPACE.sub(" ", x).strip() for x in marked.split("\0")).strip(), SPACE.sub(" ", plain).strip()
        if plain.strip() or "![" in marked:
            indent = "> " * self.quotes + "  " * max(0, len(self.lists) - 1)
            follow = indent + ("  " if self.lists else "")
            self.blocks.append((self.article > 0, indent + self.lead if self.lead else follow, follow, marked, plain))
            self.lead = ""
        self.marked, self.plain = [], []

    def put(self, text: str, plain: bool = True) -> None:
        if not self.skipped:
            self.marked.append(text)
            if plain:
                self.plain.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "meta" and (kind := META.get((own.get("property") or own.get("name") or "").lower())):
            self.meta.setdefault(kind, own.get("content", "").strip())
        if tag == "title" and self.title is None:
            self.title = []
        if tag in VOID:
            if tag == "br":
                self.put("\0" if not self.pre else "\n", False)
                self.plain.append(" ")
            elif tag == "hr" and not self.skipped:
                self.flush()
                self.blocks.append((self.article > 0, "", "", "---", ""))
            elif tag == "img" and own.get("src"):
                self.put(f"![{SPACE.sub(' ', own.get('alt', '')).strip()}]({own['src']})", False)
            return
        self.implied(tag)
        if tag in BLOCKS:
            self.flush()
        closing = ""
        if tag in SKIPPED:
            self.skipped += 1
        elif tag in ("article", "main"):
            self.article += 1
        elif tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lead = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            else:
                self.lead = "- "
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.lead = "#" * int(tag[1]) + " "
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cell()
        elif tag in MARKS and not self.pre:
            closing = MARKS[tag]
            self.put(closing, False)
        elif tag == "a" and own.get("href"):
            closing = f"]({own['href']})"
            self.put("[", False)
        self.open.append((tag, closing))
        self.count[tag] += 1

    def cell(self) -> None:
        """Ends a table's cell."""
        if self.cells is not None and (text := SPACE.sub(" ", "".join(self.marked).replace("\0", " ")).strip()):
            self.cells.append(text)
            self.marked, self.plain = [], []

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        while self.open:
            last, closing = self.open.pop()
            self.close_one(last, closing)
            if last == tag:
                return

    def close_one(self, tag: str, closing: str) -> None:
        self.count[tag] -= 1
        if closing:
            self.put(closing, False)
        if tag in ("td", "th"):
            self.cell()
        if tag == "tr" and self.cells is not None:
            self.cell()
            if self.cells and not self.skipped:
                self.blocks.append((self.article > 0, "", "", "| " + " | ".join(self.cells) + " |", " ".join(self.cells)))
            self.cells, self.marked, self.plain = None, [], []
        elif tag in BLOCKS:
            self.flush()
        if tag in SKIPPED:
            self.skipped -= 1
        elif tag in ("article", "main"):
            self.article -= 1
        elif tag in ("ul", "ol"):
            self.lists.pop()
        elif tag == "blockquote":
            self.quotes -= 1
        elif tag == "pre":
            self.pre -= 1
        if tag in ("li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.lead = ""

    def handle_data(self, data: str) -> None:
        if self.title is not None and self.open and self.open[-1][0] == "title":
            self.title.append(data)
        self.put(data)


def complete(html: str) -> str:
    """A page without a tag at its end that is cut off: no parser has to look for where it might end."""
    end = html.rfind(">") + 1
    cut = html.find("<", end)
    return html if cut < 0 else html[:cut]


def parsed(html: str | None) -> tuple:
    """(text, Markdown, length, title, author, day) of a page; of its article, where it marks one."""
    if not html:
        return "", "", 0, None, None, None
    page = Page()
    page.feed(complete(html))
    page.close()
    while page.open:
        page.close_one(*page.open.pop())
    page.flush()
    own = [b for b in page.blocks if b[0]] or page.blocks
    out, last = [], ""
    for _, lead, follow, marked, _ in own:
        kind = "item" if re.match(r"\s*(?:> )*\s*(?:- |\d+\. )", lead) else "row" if marked.startswith("| ") else ""
        text = f"```\n{marked.strip(chr(10))}\n```" if "\n" in marked and "  \n" not in marked else marked
        lines = text.split("\n")
        body = "\n".join([lead + lines[0], *(follow + x for x in lines[1:])])
        out.append(("\n" if kind and kind == last else "\n\n") + body)
        last = kind
    text = "\n".join(b[4] for b in own if b[4])
    title = page.meta.get("title") or (SPACE.sub(" ", "".join(page.title)).strip() if page.title else "")
    return text, "".join(out).strip("\n"), len(text), title or None, page.meta.get("author") or None, page.meta.get("day") or None


def parsed_all(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(x) for x in html], columns=[c.split()[0] for c in CONTENT.split(", ")])


def content(html: Column) -> Column:
    """The fields of CONTENT; a null or empty page has empty texts."""
    return F.pandas_udf(parsed_all, CONTENT)(html)
