"""Web pages read tag by tag with a stack of open elements: links, the area that holds a page's content, and tables of announcements."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

#: Elements without an end tag, and those whose text is none of the page's.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
UNSEEN = frozenset({"script", "style"})
#: Attribute and value of the elements that hold a page's content, the first that is there counts.
AREAS = (("class", "mpgdetail"), ("id", "pageptlist"))


class Link:
    def __init__(self, url: str | None, areas: frozenset[int]):
        self.url, self.areas, self.pieces = url, areas, []

    def title(self, between: str = "") -> str:
        return " ".join(between.join(self.pieces).split())


class Cell:
    def __init__(self) -> None:
        self.link, self.pieces = None, []

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Outline(HTMLParser):
    """links: every link of a page; areas: which kinds of content area it has; rows: the cells of the first table of a class.

    A cell or row ends where the next one of its table begins, a link where another begins; an end tag closes what is open
    within its element, and one that has none is passed over. A page that is cut off ends its elements there.
    """

    def __init__(self, table_class: str = "table"):
        super().__init__(convert_charrefs=True)
        self.links: list[Link] = []
        self.areas: set[int] = set()
        self.rows: list[list[Cell]] | None = None
        self._class, self._open, self._count = table_class, [], Counter()
        self._tables: list[bool] = []  # of the open tables, whether it is the one whose rows are kept
        self._within: set[int] = set()
        self._link: Link | None = None
        self._cell: Cell | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self._close({"a"}, frozenset())
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        if tag in VOID:
            return
        own = {k: v or "" for k, v in reversed(attrs)}
        marks = [i for i, (k, v) in enumerate(AREAS) if tag == "div" and i not in self.areas and v in own.get(k, "").split()]
        self.areas.update(marks)
        self._within.update(marks)
        self._open.append((tag, marks))
        self._count[tag] += 1
        if tag == "table":
            first = self.rows is None and self._class in own.get("class", "").split()
            self._tables.append(first)
            self.rows = [] if first else self.rows
        elif tag == "tr" and self._kept():
            self.rows.append([])
        elif tag == "td" and self._kept():
            self._cell = Cell()
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self._cell)
        elif tag == "a":
            self._link = Link(own.get("href"), frozenset(self._within))
            self.links.append(self._link)
            if self._cell is not None and self._cell.link is None:
                self._cell.link = self._link

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, {"table"} if tag in ("td", "th", "tr") else frozenset())

    def handle_data(self, data: str) -> None:
        if not (self._open and self._open[-1][0] in UNSEEN):
            for holder in (self._link, self._cell):
                if holder is not None:
                    holder.pieces.append(data)

    def _kept(self) -> bool:
        return bool(self._tables) and self._tables[-1]

    def _close(self, tags: set, edge: frozenset | set) -> None:
        """Close the innermost element of some tags with all in it, unless it lies beyond an edge."""
        if not any(self._count[t] for t in tags):
            return
        for at in range(len(self._open) - 1, -1, -1):
            tag = self._open[at][0]
            if tag in tags:
                break
            if tag in edge:
                return
        for tag, marks in self._open[at:]:
            self._count[tag] -= 1
            self._within.difference_update(marks)
            if tag == "a":
                self._link = None
            elif tag == "table":
                self._tables.pop()
                self._cell = None if not any(self._tables) else self._cell
            elif tag == "td" and (self._kept() or not self._tables):
                self._cell = None
        del self._open[at:]


def read(html: str | None) -> Outline:
    page = Outline()
    page.feed((html or "").replace("<![", "<! ["))  # sections of other markup languages are comments here
    page.close()
    return page


def links(html: str | None) -> list[dict]:
    """url and title of each link that has an address; pieces of the title are set apart by spaces."""
    return [{"url": x.url, "title": x.title(" ")} for x in read(html).links if x.url is not None]


def announcements(html: str | None, navigation: tuple[str, ...], most: int, least: int = 8) -> list[dict]:
    """title, url, unit, date of a page's announcements, in order.

    A page with a table of class ``table``: of its first ``most`` rows those with two cells or more and a titled link in the second cell,
    else the first. Any other page: the first ``most`` links of its content area, or of all of it, with titles of
    ``least`` characters or more that name no navigation, each title once.
    """
    page = read(html)
    found: dict = {}
    if page.rows is not None:
        for n, cells in enumerate(page.rows[:most]):
            link = (cells[1].link or cells[0].link) if len(cells) > 1 else None
            if link and link.title():
                unit, date = (cells[2].text(), cells[0].text()) if len(cells) > 2 else ("", "")
                found[n] = {"title": link.title(), "url": link.url or "", "unit": unit, "date": date}
        return list(found.values())
    area = min(page.areas, default=None)
    for link in page.links:
        title, url = link.title(), link.url or ""
        if (area is None or area in link.areas) and url and not url.startswith(("javascript:", "#")) and len(title) >= least and not any(w in title for w in navigation):
            found.setdefault(title, {"title": title, "url": url, "unit": "", "date": ""})
            if len(found) == most:
                break
    return list(found.values())
