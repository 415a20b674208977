"""Blocks of visible text out of HTML, however broken."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa

# Elements that begin a new block of text, and those whose content isn't text to be read.
BLOCKS = frozenset(b"address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
UNREAD = frozenset(b"script style title template noscript iframe noframes noembed svg math object".split())
#: Of those, the elements whose content has no markup: it ends at the first end tag of their own name.
RAW = frozenset(b"script style title iframe noframes noembed".split())

_NAME = re.compile(rb"[A-Za-z][^\t\n\f\r />]*")
_STOP = re.compile(rb"[>=]")
_VALUE = re.compile(rb"[\t\n\f\r ]*([\"'])")
_SPACES = re.compile(r"[ \t\n\r\f\v\xa0]+")


class Page:
    """A page's bytes and a place in them; each method is a state, which reads on from the place and leaves it behind what it has read."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.lacking: set[bytes] = set()

    def find(self, what: bytes) -> int:
        """The next place of what, the page's end if there is none; what is missing once isn't looked for again."""
        if what in self.lacking:
            return len(self.data)
        k = self.data.find(what, self.at)
        if k < 0:
            self.lacking.add(what)
            return len(self.data)
        return k

    def text(self) -> bytes:
        begin, self.at = self.at, self.find(b"<")
        return self.data[begin : self.at]

    def comment(self) -> None:
        self.at = self.find(b"-->") + 3

    def declaration(self) -> None:
        self.at = self.find(b">") + 1

    def tag(self, name_at: int) -> bytes:
        """Read a tag's name and all up to its end; a > within a quoted value doesn't end it. Returns the name in lower case."""
        m = _NAME.match(self.data, name_at)
        self.at = m.end()
        while stop := _STOP.search(self.data, self.at):
            self.at = stop.end()
            if stop[0] == b">":
                return m[0].lower()
            if quote := _VALUE.match(self.data, self.at):
                self.at = quote.end()
                end = self.find(quote[1])
                self.at = end + 1 if end < len(self.data) else self.at
        self.at = len(self.data)
        return b""

    def raw(self, name: bytes) -> None:
        """All up to the end tag of the element."""
        end = re.compile(rb"</" + name + rb"(?=[\t\n\f\r />])", re.IGNORECASE).search(self.data, self.at) if b"</" + name not in self.lacking else None
        if end:
            self.at = end.start()
        else:
            self.lacking.add(b"</" + name)
            self.at = len(self.data)


def blocks(data: bytes) -> list[str]:
    """The page's blocks of visible text in order, white space run together, empty ones left out.

    A < that begins no tag, comment or declaration is text. What a tag, comment or unread element that never ends holds is lost, as in browsers;
    elements may be closed in any order or not at all. Character references are replaced; bytes that aren't UTF-8 become U+FFFD.
    """
    page, out, now, unread = Page(data), [], [], []
    while page.at < len(data):
        if piece := page.text():
            if not unread:
                now.append(piece)
            continue
        head = data[page.at : page.at + 4]
        if head == b"<!--":
            page.at += 4
            page.comment()
        elif head[1:2] in (b"!", b"?"):
            page.declaration()
        elif head[1:2].isalpha() and head[1] < 128:
            name = page.tag(page.at + 1)
            if name in BLOCKS and now:
                out.append(b"".join(now))
                now = []
            if name in UNREAD:
                page.raw(name) if name in RAW else unread.append(name)
        elif head[1:2] == b"/" and head[2:3].isalpha() and head[2] < 128:
            name = page.tag(page.at + 2)
            if name in BLOCKS and now:
                out.append(b"".join(now))
                now = []
            if name in unread:
                unread.remove(name)
        elif head[1:2] == b"/" and len(head) > 2:
            page.declaration()
        else:
            if not unread:
                now.append(b"<")
            page.at += 1
    if now:
        out.append(b"".join(now))
    plain = (_SPACES.sub(" ", html.unescape(b.decode("utf-8", "replace"))).strip(" ") for b in out)
    return [b for b in plain if b]


def page_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id, a host and HTML to the id, the host and the page's blocks; null HTML has none."""
    for batch in batches:
        found = [blocks(x.as_buffer().to_pybytes()) if x.is_valid else [] for x in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["page_id", "host", "blocks"])
