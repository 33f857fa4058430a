"""Markdown to HTML for one document, used inside an Arrow UDF.

Only headings, paragraphs and list items survive the projection that follows,
so this covers the block structure (headings, paragraphs, lists, quotes, code,
rules, raw HTML) and the inline marks that separate text nodes. It is not a
general renderer.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)(.*?)(?:(?:^|[ \t]+)#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?=[ \t]|$)( {0,4}(?=[^ ])|)")
_QUOTE = re.compile(r" {0,3}> ?")
_RAW_VERBATIM = re.compile(r" {0,3}<(?:(script|pre|style|textarea)(?=[\s>]|$)|(!--)|(\?)|(![A-Za-z]))", re.I)
_RAW_END = {1: r"</(?:script|pre|style|textarea)>", 2: "-->", 3: r"\?>", 4: ">"}
# Element names that open a raw block.
_RAW_BLOCK = re.compile(
    r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|"
    r"dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
    r"h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|"
    r"optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|"
    r"track|ul)(?=[\s/>]|$)",
    re.I,
)
_TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
_RAW_INLINE_LINE = re.compile(rf" {{0,3}}(?:{_TAG})[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*(?:\n|$)")

_SPAN = re.compile(
    r"\\([!-/:-@\[-`{-~])"  # 1 escaped punctuation
    r"|(?<!`)(`+)(?!`)(.+?)(?<!`)\2(?!`)"  # 2, 3 code span
    r"|<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>"  # 4 autolink
    rf"|({_TAG}|<!--.*?-->|<\?.*?\?>|<![A-Z].*?>)"  # 5 raw HTML
    r"|(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"  # 6 entity
    r"|( {2,}|\\)?\n *"  # 7 line break
    r"|(\*+|_+)"  # 8 emphasis mark
    r"|(!?\[)|(\])",  # 9, 10 link text
    re.S,
)
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _flanking(text: str, start: int, end: int) -> tuple[bool, bool]:
    """May the mark at ``text[start:end]`` open / close emphasis?"""

    def punctuation(ch: str) -> bool:
        return not (ch.isalnum() or ch.isspace())

    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    left = not after.isspace() and (
        not punctuation(after) or before.isspace() or punctuation(before)
    )
    right = not before.isspace() and (
        not punctuation(before) or after.isspace() or punctuation(after)
    )
    if text[start] == "_":
        return left and (not right or punctuation(before)), right and (not left or punctuation(after))
    return left, right


def _pair_emphasis(out: list[str], marks: list[list]) -> None:
    """Match opening and closing marks; leftovers stay literal."""
    openers: dict[str, list[tuple[int, list]]] = {"*": [], "_": []}
    # Per kind of closing mark, where the last one found nothing before it.
    searched: dict[tuple, int] = {}
    for order, mark in enumerate(marks):
        char, can_open, can_close, total = mark[1:5]
        stack, kind = openers[char], (char, can_open, total % 3)

        def fits(o: list) -> bool:
            both = o[3] or can_open
            return not (both and (o[4] + total) % 3 == 0 and (o[4] % 3 or total % 3))

        while can_close and mark[5]:
            at = len(stack) - 1
            since = searched.get(kind, 0)
            while at >= 0 and stack[at][0] >= since and not fits(stack[at][1]):
                at -= 1
            if at < 0 or stack[at][0] < since:
                searched[kind] = order
                break
            opened, opener = stack[at]
            for other in openers.values():
                while other and other[-1][0] > opened:
                    other.pop()
            used = 2 if opener[5] >= 2 and mark[5] >= 2 else 1
            opener[5] -= used
            mark[5] -= used
            name = "strong" if used == 2 else "em"
            opener[6].insert(0, f"<{name}>")
            mark[7].append(f"</{name}>")
            if not opener[5]:
                stack.pop()
        if can_open and mark[5]:
            stack.append((order, mark))
    for where, char, *_, left, opened, closed in marks:
        out[where] = "".join(closed) + char * left + "".join(opened)


def _inline(text: str, defined: set[str]) -> str:
    out: list[str] = []
    marks: list[list] = []
    brackets: list[tuple[int, int, int, bool]] = []  # output slot, text start, first mark, image
    at = 0
    while at < len(text):
        m = _SPAN.search(text, at)
        if not m:
            break
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        which = m.lastindex
        if m[1]:
            out.append(html.escape(m[1], quote=False))
        elif m[2]:
            code = m[3].replace("\n", " ")
            if code.strip(" ") and code[0] == code[-1] == " ":
                code = code[1:-1]
            out.append(f"<code>{html.escape(code, quote=False)}</code>")
        elif m[4]:
            out.append(f"<a>{html.escape(m[4], quote=False)}</a>")
        elif m[5]:
            out.append(m[5])
        elif m[6]:
            known = m[6][1] == "#" or m[6][1:] in html5
            out.append(m[6] if known else html.escape(m[6]))
        elif m[8]:
            can_open, can_close = _flanking(text, m.start(), m.end())
            marks.append([len(out), m[8][0], can_open, can_close, len(m[8]), len(m[8]), [], []])
            out.append(m[8])
        elif m[9]:
            brackets.append((len(out), m.end(), len(marks), m[9] == "!["))
            out.append(m[9])
        elif m[10]:
            out.append("]")
            if not brackets:
                continue
            slot, start, first, image = brackets.pop()
            inner = text[start : m.start()]
            target = _TARGET.match(text, at)
            label = _LABEL.match(text, at)
            if target:
                at = target.end()
            elif defined and label and _label(label[1] or inner) in defined:
                at = label.end()
            elif not defined or _label(inner) not in defined:
                continue
            _pair_emphasis(out, marks[first:])
            del marks[first:]
            if image:
                del out[slot:]
                out.append("<img>")
            else:
                out[slot], out[-1] = "<a>", "</a>"
                brackets = [b for b in brackets if b[3]]
        else:
            out.append("<br />\n" if which == 7 else "\n")
    out.append(html.escape(text[at:], quote=False))
    _pair_emphasis(out, marks)
    return "".join(out)


class _Blocks:
    """Line-by-line block structure; inline text is rendered at the end, when
    every link definition is known."""

    def __init__(self) -> None:
        self.parts: list[str | tuple[str, str]] = []
        self.defined: set[str] = set()

    def paragraph(self, lines: list[str], tight: bool, tag: str = "p") -> None:
        text = "\n".join(line.lstrip(" \t") for line in lines).rstrip(" \t")
        while m := _DEFINITION.match(text):
            self.defined.add(_label(m[1]))
            text = text[m.end() :]
        if text:
            bare = tight and tag == "p"
            self.parts += [("", text), "\n"] if bare else [f"<{tag}>", ("", text), f"</{tag}>\n"]
        lines.clear()

    def parse(self, lines: list[str]) -> None:
        """Read blocks of any depth: what a block holds waits on a stack of its own."""
        open_blocks = [self._read(lines, False)]
        while open_blocks:
            inner = next(open_blocks[-1], None)
            if inner is None:
                open_blocks.pop()
            else:
                open_blocks.append(self._read(*inner))

    def _read(self, lines: list[str], tight: bool):
        """Read the blocks of ``lines``; yields the lines inside each block, to be read next."""
        para: list[str] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            i += 1
            if not line.strip():
                self.paragraph(para, tight)
                continue
            if not para and line.startswith("    "):
                code = [line]
                while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                    code.append(lines[i])
                    i += 1
                self._code(x[4:] for x in code)
                continue
            if para and (m := _UNDERLINE.match(line)):
                self.paragraph(para, tight, "h1" if m[1][0] == "=" else "h2")
                continue
            if not self._interrupts(line, bool(para)):
                para.append(line)
                continue
            self.paragraph(para, tight)
            if m := _FENCE.match(line):
                close = re.compile(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}[ \t]*$")
                stop = next((k for k in range(i, len(lines)) if close.match(lines[k])), len(lines))
                self._code(lines[i:stop])
                i = stop + 1
            elif m := _HEADING.match(line):
                level = len(m[1])
                self.parts += [f"<h{level}>", ("", m[2].strip(" \t")), f"</h{level}>\n"]
            elif _RULE.match(line):
                self.parts.append("<hr />\n")
            elif _QUOTE.match(line):
                i = yield from self._quote(lines, i - 1)
            elif _ITEM.match(line):
                i = yield from self._list(lines, i - 1)
            else:
                i = self._raw(lines, i - 1)
        self.paragraph(para, tight)

    @staticmethod
    def _interrupts(line: str, in_paragraph: bool) -> bool:
        """Does ``line`` start a block other than a paragraph?"""
        if item := _ITEM.match(line):
            # Inside a paragraph only a non-empty item, numbered 1, counts.
            plain = line[item.end() :].strip() and item[3] in (None, "1")
            return not in_paragraph or bool(plain) or bool(_RULE.match(line))
        starts = (_FENCE, _HEADING, _RULE, _QUOTE, _RAW_VERBATIM, _RAW_BLOCK)
        if any(p.match(line) for p in starts):
            return True
        return not in_paragraph and bool(_RAW_INLINE_LINE.match(line))

    def _code(self, lines) -> None:
        body = html.escape("\n".join(lines), quote=False)
        self.parts.append(f"<pre><code>{body}\n</code></pre>\n")

    def _raw(self, lines: list[str], i: int) -> int:
        start = i
        m = _RAW_VERBATIM.match(lines[i])
        if m:
            end = re.compile(_RAW_END[m.lastindex], re.I)
            while i < len(lines) and not end.search(lines[i]):
                i += 1
            i += 1
        else:
            while i < len(lines) and lines[i].strip():
                i += 1
        self.parts.append("\n".join(lines[start:i]) + "\n")
        return i

    def _quote(self, lines: list[str], i: int):
        inner: list[str] = []
        while i < len(lines) and lines[i].strip():
            m = _QUOTE.match(lines[i])
            lazy = inner and inner[-1].strip() and not self._interrupts(lines[i], True)
            if not m and not lazy:
                break
            inner.append(lines[i][m.end() :] if m else lines[i])
            i += 1
        self.parts.append("<blockquote>\n")
        yield inner, False
        self.parts.append("</blockquote>\n")
        return i

    def _list(self, lines: list[str], i: int):
        kind = _ITEM.match(lines[i])[2][-1]
        items: list[list[str]] = []
        loose = gap = False
        while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind:
            if _RULE.match(lines[i]):
                break
            loose |= gap
            gap = False
            pad = len(m[4]) if 1 <= len(m[4]) <= 4 else 1
            indent = len(m[1]) + len(m[2]) + pad
            item = [lines[i][indent:]]
            i += 1
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    if not any(x.strip() for x in item):
                        break
                    item.append("")
                elif line.startswith(" " * indent):
                    item.append(line[indent:])
                elif item[-1].strip() and not self._interrupts(line, True) and not _ITEM.match(line):
                    item.append(line.lstrip(" "))
                else:
                    break
                i += 1
            while item and not item[-1].strip():
                item.pop()
                gap = True
            loose |= self._has_gap(item)
            items.append(item)
            while i < len(lines) and not lines[i].strip():
                i += 1
                gap = True
        name = "ol" if kind in ".)" else "ul"
        self.parts.append(f"<{name}>\n")
        for item in items:
            self.parts.append("<li>")
            yield item, not loose
            self.parts.append("</li>\n")
        self.parts.append(f"</{name}>\n")
        return i

    @staticmethod
    def _has_gap(item: list[str]) -> bool:
        """Is there a blank line between two direct children of the item?"""
        fence = None
        nested = 0
        for before, line in zip([""] + item, item):
            if m := _FENCE.match(line):
                fence = m[1][0] if fence is None else (None if m[1][0] == fence else fence)
            elif m := _ITEM.match(line):
                nested = m.end()
            elif line.strip() and not line.startswith(" "):
                nested = 0
            if fence is None and not before.strip() and line.strip() and line is not item[0]:
                if not (nested and line.startswith(" " * nested)):
                    return True
        return False


def markdown_to_html(text: str) -> str:
    blocks = _Blocks()
    blocks.parse([line.expandtabs(4) if "\t" in line else line for line in text.split("\n")])
    return "".join(p if isinstance(p, str) else _inline(p[1], blocks.defined) for p in blocks.parts)
