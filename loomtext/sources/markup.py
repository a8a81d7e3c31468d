"""The standard library's HTML parser, so that it reads any text to its end as browsers do, in time that grows with the text."""

from __future__ import annotations

from html.parser import HTMLParser

DEPTH = 512  # elements within elements; deeper ones are read as if they stood at that depth


class Events(HTMLParser):
    """Declarations, sections and comments of any kind are left out, unclosed ones to the end of the text, and so is a tag that the text ends in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.ending = False
        self.beyond: dict[str, int] = {}  # open elements that are too deep to be kept

    def read(self, html: str) -> None:
        self.feed(html)
        self.ending = True
        self.close()

    def _end(self, found: int) -> int:
        return len(self.rawdata) if found < 0 and self.ending else found

    def _after(self, mark: str, at: int) -> int:
        found = self.rawdata.find(mark, at)
        return self._end(found if found < 0 else found + len(mark))

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self._after(">", i + 2)

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i + 4) + 1
        return self._after("-->", i + 4)

    def parse_pi(self, i: int) -> int:
        return self._after(">", i + 2)

    def parse_bogus_comment(self, i: int, report: bool = True) -> int:
        return self._after(">", i + 2)

    def parse_starttag(self, i: int) -> int:
        return self._end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._end(super().parse_endtag(i))

    def too_deep(self, tag: str, depth: int) -> bool:
        """Whether an element that begins at a depth is not to be kept; its end is then met by ended_beyond."""
        if depth < DEPTH:
            return False
        self.beyond[tag] = self.beyond.get(tag, 0) + 1
        return True

    def ended_beyond(self, tag: str) -> bool:
        if not self.beyond.get(tag):
            return False
        self.beyond[tag] -= 1
        return True
