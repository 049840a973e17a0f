"""Wiki links in the list items of an HTML page."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import unquote


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.link: tuple[str, int] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "li":
            self.open.append({"text": "", "links": []})
        elif tag == "a" and self.open:
            href = dict(attrs).get("href") or ""
            if href.startswith("/wiki/"):
                self.link = (unquote(href[len("/wiki/") :]), len(self.open[-1]["text"]))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.link and self.open:
            title, start = self.link
            surface = self.open[-1]["text"][start:]
            if surface:
                self.open[-1]["links"].append((start, len(surface), title, surface))
            self.link = None
        elif tag == "li" and self.open:
            self.done.append(self.open.pop())

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1]["text"] += data


def item_links(page: str) -> list[tuple[int, str, int, int, str, str]]:
    """(item, its text, start, length, title, surface) of every link."""
    p = _Items()
    p.feed(page)
    p.close()
    items = p.done + p.open[::-1]
    return [(k, i["text"], *link) for k, i in enumerate(items) for link in i["links"]]
