"""Tolerant HTML reading for one document, used inside an Arrow UDF.

The tag stream of ``html.parser`` is kept as one flat list of events; an element
is a slice of it. Nothing is repaired: an end tag closes the innermost open
element of that name, an end tag without one is ignored, and an element that
is never closed runs to the end of whatever contains it.
"""

from __future__ import annotations

from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

# Elements without content, elements whose text never shows,
# elements dropped before projection, elements that are projected.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
SILENT = frozenset("script style template rt rp".split())
DROPPED = frozenset("script style noscript template".split())
PROJECTED = frozenset("h1 h2 h3 p li".split())

OPEN, CLOSE, TEXT, HIDDEN = range(4)


class _Events(HTMLParser):
    """Flat event list plus, for each opening event, where its element ends."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=False)
        self.events: list[tuple] = []
        self.end: dict[int, int] = {}
        self._stack: list[int] = []
        self._open_names: dict[str, int] = {}
        self._silent = 0
        self._text: list[str] = []
        self._closed_void: Counter[str] = Counter()
        self.feed(markup)
        self.close()
        self._flush()
        while self._stack:
            self._pop()

    def _flush(self, kind: int = TEXT) -> None:
        if self._text:
            text = "".join(self._text)
            self._text.clear()
            self.events.append((HIDDEN if self._silent else kind, text))

    def _pop(self) -> None:
        start = self._stack.pop()
        name = self.events[start][1]
        self._open_names[name] -= 1
        self._silent -= name in SILENT
        self.events.append((CLOSE, name))
        self.end[start] = len(self.events)

    def _push(self, name: str, attrs) -> None:
        self._flush()
        values = {k: tuple(v.split()) if k == "class" and v else v or "" for k, v in attrs}
        self._stack.append(len(self.events))
        self.events.append((OPEN, name, values))
        self._open_names[name] = self._open_names.get(name, 0) + 1
        self._silent += name in SILENT

    def _pop_to(self, name: str) -> None:
        self._flush()
        if not self._open_names.get(name):
            return
        while self.events[self._stack[-1]][1] != name:
            self._pop()
        self._pop()

    def handle_starttag(self, tag, attrs):
        self._push(tag, attrs)
        if tag in VOID:
            self._pop_to(tag)
            self._closed_void[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._push(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # <br></br>: the start tag already closed it.
        if self._closed_void[tag]:
            self._closed_void[tag] -= 1
        else:
            self._pop_to(tag)

    def handle_data(self, data):
        self._text.append(data)

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        char = "\ufffd" if code > 0x10FFFF else chr(code)
        if 128 <= code < 160:
            # Numbers in this range mean windows-1252, where it defines them.
            char = bytes([code]).decode("windows-1252", "ignore") or char
        self._text.append(char)

    def handle_entityref(self, name):
        self._text.append(html5.get(name + ";", "&" + name))

    def _markup(self, data: str, kind: int) -> None:
        self._flush()
        self._text.append(data)
        self._flush(kind)

    def handle_comment(self, data):
        self._markup(data, HIDDEN)

    def handle_decl(self, decl):
        self._markup(decl, HIDDEN)

    def handle_pi(self, data):
        self._markup(data, HIDDEN)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._markup(data[6:], TEXT)
        else:
            self._markup(data, HIDDEN)


def _find(doc: _Events, start: int, name: str) -> list[int]:
    """Opening positions of ``name`` inside the element at ``start``."""
    ev = doc.events
    return [i for i in range(start + 1, doc.end[start]) if ev[i][0] == OPEN and ev[i][1] == name]


def _text(doc: _Events, start: int) -> str:
    part = doc.events[start : doc.end[start]]
    return "".join(e[1].strip() for e in part if e[0] == TEXT)


def _table_text(doc: _Events, table: int) -> str:
    """One line per data row, labelled with the cells of the first row."""
    rows = _find(doc, table, "tr")
    if not rows:
        return ""
    first = rows[0]
    has_th = bool(_find(doc, table, "th"))
    header = [_text(doc, c) for c in _find(doc, first, "th") or _find(doc, first, "td")]
    header_events = doc.events[first : doc.end[first]]
    lines = []
    for row in rows:
        if _find(doc, row, "th"):
            continue
        if not has_th and doc.events[row : doc.end[row]] == header_events:
            continue
        cells = [_text(doc, c) for c in _find(doc, row, "td")]
        if len(header) == 2 and len(cells) >= 2:
            lines.append(f"{cells[0]}: {cells[1]}")
        elif cells:
            named = [f"{h}: {c}" for h, c in zip(header, cells)]
            lines.append(", ".join(named + cells[len(header) :]))
    return "\n".join(lines)


def html_blocks(markup: str) -> list[tuple[str, str]]:
    """(tag, text) of every heading, paragraph and list item, in document order.

    Tables become plain text first. The text nodes of an element are stripped
    and joined with nothing in between; an element inside another one counts
    for both.
    """
    doc = _Events(markup)
    found: list[tuple[str, list[str]]] = []
    within: list[tuple[list[str], int]] = []
    i = 0
    while i < len(doc.events):
        while within and within[-1][1] <= i:
            within.pop()
        kind, value = doc.events[i][:2]
        text = ""
        after = i + 1
        if kind == TEXT:
            text = value.strip()
        elif kind == OPEN and value == "table":
            text, after = _table_text(doc, i).strip(), doc.end[i]
        elif kind == OPEN and value in DROPPED:
            after = doc.end[i]
        elif kind == OPEN and value in PROJECTED:
            found.append((value, []))
            within.append((found[-1][1], doc.end[i]))
        if text:
            for parts, _ in within:
                parts.append(text)
        i = after
    return [(tag, "".join(parts)) for tag, parts in found]
