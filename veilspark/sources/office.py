"""Word and Excel files as places: one walk gives the texts to look in and, later, puts tags where they were found.

A place is a paragraph, a cell, a literal in a formula, a comment, a part of a link, a section of a printed header, a tab's
title or a property. Its text is that of its leaves in order; only some leaves can be changed (a tab or a break can't). Parts
without a change are written back byte for byte.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from xml.dom.minidom import Document, Element, parseString

#: Story parts of a Word file, text properties of both formats, characters of leaves, limits of tab titles.
STORY = r"word/(document|glossary/document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"
PROPERTIES = ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category")
LEAF_CHARS = {"tab": "\t", "ptab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
PRINT_BLOCKS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")
LINK_PARTS = ("location", "display", "tooltip")
TITLE_MAX = 31

LITERAL = re.compile(r'("(?:[^"]|"")*")')
PRINT_CODE = re.compile(r'(&(?:"[^"]*"|\d+|K[0-9A-Fa-f]{6}|[^LCR]))')
Mark = tuple[int, int, str]


@dataclass
class Leaf:
    text: str
    put: Callable[[str], None] | None = None


@dataclass
class Place:
    surface: str
    row: int
    col: int
    hint: str
    leaves: list[Leaf]

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves)


def put_marks(leaves: Iterable[Leaf], marks: list[Mark]) -> None:
    """Put each tag in the leaf where its stretch starts and delete the stretch from the leaves that it covers. A tag that
    starts in a leaf that can't change goes to the next one that can, or to the end of the last."""
    at, carried, last = 0, "", None
    for leaf in leaves:
        end = at + len(leaf.text)
        if leaf.put is None:
            carried += "".join(tag for start, _, tag in marks if at <= start < end)
        else:
            out, here, carried = carried, at, ""
            for start, stop, tag in marks:
                if start < end and stop > at:
                    out += leaf.text[here - at : max(start, at) - at] + (tag if start >= at else "")
                    here = min(stop, end)
            out += leaf.text[here - at :]
            if out != leaf.text:
                leaf.put(out)
            last = leaf, out
        at = end
    if carried and last:
        last[0].put(last[1] + carried)


def _all(node: Document | Element, name: str) -> list[Element]:
    return node.getElementsByTagNameNS("*", name)


def _children(node: Element, *names: str) -> list[Element]:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE and (not names or c.localName in names)]


def _inner(node: Element) -> str:
    return "".join(c.data for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _attribute(node: Element, local: str) -> str:
    return next((a.value for a in node.attributes.values() if a.localName == local), "")


def _fill(node: Element, text: str) -> None:
    while node.firstChild:
        node.removeChild(node.firstChild)
    node.appendChild(node.ownerDocument.createTextNode(text))
    if text != text.strip() and node.localName == "t":
        node.setAttribute("xml:space", "preserve")


class Package:
    """A zip of XML parts, parsed when asked for."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        self.parsed: dict[str, Document] = {}
        self.changed: set[str] = set()
        self.titles: list[tuple[Element, str]] = []

    def xml(self, part: str) -> Document:
        if part not in self.parsed:
            self.parsed[part] = parseString(self.zip.read(part))
        return self.parsed[part]

    def links(self, part: str) -> dict[str, tuple[Element, str, str]]:
        """id: (element, kind, part) of a part's relationships."""
        where = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
        found = _all(self.xml(where), "Relationship") if where in self.names else []
        full = lambda t: posixpath.normpath(posixpath.join("/" + posixpath.dirname(part), t)).lstrip("/")
        return {r.getAttribute("Id"): (r, r.getAttribute("Type").rsplit("/", 1)[-1], full(r.getAttribute("Target"))) for r in found}

    def leaf(self, part: str, node: Element) -> Leaf:
        return Leaf(_inner(node), partial(self._put, part, node))

    def _put(self, part: str, node: Element, text: str) -> None:
        self.changed.add(part)
        _fill(node, text)

    def attribute(self, part: str, node: Element, name: str) -> Leaf:
        def put(text: str) -> None:
            self.changed.add(part)
            node.setAttribute(name, text)

        return Leaf(node.getAttribute(name), put)

    def saved(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.zip.infolist():
                z.writestr(info, self.xml(info.filename).toxml(encoding="UTF-8", standalone=True) if info.filename in self.changed else self.zip.read(info.filename))
        return out.getvalue()


def _properties(p: Package) -> Iterator[Place]:
    if "docProps/core.xml" in p.names:
        for name in PROPERTIES:
            for k, node in enumerate(_all(p.xml("docProps/core.xml"), name)):
                yield Place("property", PROPERTIES.index(name), k, "", [p.leaf("docProps/core.xml", node)])


def word_places(p: Package) -> Iterator[Place]:
    """Paragraphs at any depth of every story part, and the properties."""
    for part in sorted(n for n in p.names if re.fullmatch(STORY, n)):
        for row, paragraph in enumerate(_all(p.xml(part), "p")):
            if not (paragraph.namespaceURI or "").rstrip("/").endswith(("wordprocessingml/2006/main", "wordprocessingml/main")):
                continue
            runs = [r for x in _children(paragraph, "r", "hyperlink") for r in ([x] if x.localName == "r" else _children(x, "r"))]
            leaves = [p.leaf(part, n) if n.localName == "t" else Leaf(LEAF_CHARS[n.localName]) for r in runs for n in _children(r, "t", *LEAF_CHARS)]
            yield Place(part, row, 0, "", leaves)
    yield from _properties(p)


def _position(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as B2."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref.split(":")[0]).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - ord("A") + 1
    return int(digits) - 1, col - 1


def _plain(item: Element) -> str:
    """Text of a shared or inline string; phonetic hints don't count."""
    return "".join(_inner(t) for t in _all(item, "t") if t.parentNode.localName != "rPh")


def _in_cell(p: Package, part: str, cell: Element, text: str) -> None:
    """A cell's text written in the cell itself, so that other cells with the same shared string keep theirs."""
    p.changed.add(part)
    for c in _children(cell, "v", "is"):
        cell.removeChild(c)
    make = lambda name: cell.ownerDocument.createElementNS(cell.namespaceURI, f"{cell.prefix}:{name}" if cell.prefix else name)
    holder, t = make("is"), make("t")
    holder.appendChild(t)
    _fill(t, text)
    cell.appendChild(holder)
    cell.setAttribute("t", "inlineStr")


def _pieces(p: Package, part: str, node: Element, pieces: list[str], k: int, around: str = "") -> Leaf:
    """The k-th piece of an element's text as a leaf."""
    def put(text: str) -> None:
        pieces[k] = around + text + around
        p._put(part, node, "".join(pieces))

    return Leaf(pieces[k][len(around) : len(pieces[k]) - len(around)], put)


def _sheet(p: Package, part: str, shared: list[str]) -> Iterator[Place]:
    sheet, links = p.xml(part), p.links(part)
    headers: dict[int, str] = {}
    first = None
    for r, row in enumerate(_all(sheet, "row")):
        for c, cell in enumerate(_children(row, "c")):
            y, x = _position(cell.getAttribute("r")) if cell.getAttribute("r") else (r, c)
            first = y if first is None else first
            kind, value = cell.getAttribute("t"), "".join(map(_inner, _children(cell, "v")))
            text = shared[int(value)] if kind == "s" and value else "".join(map(_plain, _children(cell, "is"))) if kind == "inlineStr" else value
            if y == first:
                headers[x] = text
            hint = "" if y == first else headers.get(x, "")
            formulas = _children(cell, "f")
            for f in formulas:
                pieces = LITERAL.split(_inner(f))
                for k in range(1, len(pieces), 2):
                    yield Place(f"{part}:formula", y, x, hint, [_pieces(p, part, f, pieces, k, '"')])
            if not formulas and kind in ("s", "inlineStr", "str") and text:
                yield Place(f"{part}:cell", y, x, hint, [Leaf(text, partial(_in_cell, p, part, cell))])

    def hint_at(ref: str) -> tuple[int, int, str]:
        y, x = _position(ref)
        return y, x, "" if y == first else headers.get(x, "")

    for link in _all(sheet, "hyperlink"):
        y, x, hint = hint_at(link.getAttribute("ref"))
        for name in LINK_PARTS:
            if link.getAttribute(name):
                yield Place(f"{part}:link", y, x, hint, [p.attribute(part, link, name)])
        if rel := links.get(_attribute(link, "id")):
            yield Place(f"{part}:link", y, x, hint, [p.attribute(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"), rel[0], "Target")])
    for _, kind, other in links.values():
        if kind in ("comments", "threadedComment") and other in p.names:
            for comment in _all(p.xml(other), "comment") + _all(p.xml(other), "threadedComment"):
                y, x, hint = hint_at(comment.getAttribute("ref"))
                texts = [t for holder in _children(comment, "text") for t in (_all(holder, "t") or [holder])]
                yield Place(f"{other}:comment", y, x, hint, [p.leaf(other, t) for t in texts])
    for block in PRINT_BLOCKS:
        for node in _all(sheet, block):
            sides = re.split(r"(&[LCR])", _inner(node))
            pieces = [x for s in sides for x in ([s] if re.fullmatch("&[LCR]", s) else PRINT_CODE.split(s))]
            leaves: list[list[Leaf]] = [[]]
            for k, piece in enumerate(pieces):
                if re.fullmatch("&[LCR]", piece):
                    leaves.append([])
                elif piece and not PRINT_CODE.fullmatch(piece):
                    leaves[-1].append(_pieces(p, part, node, pieces, k))
            for k, side in enumerate(leaves):
                if side:
                    yield Place(f"{part}:print", PRINT_BLOCKS.index(block), k, "", side)


def excel_places(p: Package) -> Iterator[Place]:
    """Cells with text, literals in formulas, comments, links, printed headers, drawings, tab titles and properties. A cell's
    hint is the text above it in the sheet's first row."""
    book, links = p.xml("xl/workbook.xml"), p.links("xl/workbook.xml")
    strings = next((part for _, kind, part in links.values() if kind == "sharedStrings" and part in p.names), None)
    shared = [_plain(si) for si in _all(p.xml(strings), "si")] if strings else []
    sheets = _all(book, "sheet")
    for sheet in sheets:
        rel = links.get(_attribute(sheet, "id"))
        if rel and rel[1] == "worksheet":
            yield from _sheet(p, rel[2], shared)
    for part in sorted(n for n in p.names if re.fullmatch(r"xl/(charts|drawings)/[^/]+\.xml", n)):
        drawn = [n for c in _all(p.xml(part), "strCache") for n in _all(c, "v")] + _all(p.xml(part), "t")
        for k, node in enumerate(drawn):
            yield Place(f"{part}:drawing", k, 0, "", [p.leaf(part, node)])
    for k, sheet in enumerate(sheets):
        yield Place("title", k, 0, "", [Leaf(sheet.getAttribute("name"), lambda text, s=sheet: p.titles.append((s, text)))])
    yield from _properties(p)


def repointed(formula: str, renames: dict[str, str]) -> str:
    """A formula with references to renamed sheets, quoted or bare, following them; its literals stay."""
    pieces = LITERAL.split(formula)
    quoted = {"'" + old.replace("'", "''") + "'!": "'" + new.replace("'", "''") + "'!" for old, new in renames.items()}
    bare = {old + "!": quoted["'" + old.replace("'", "''") + "'!"] for old in renames}
    names = "|".join([*map(re.escape, quoted), *(rf"(?<![\w.'])(?:{re.escape(b)})" for b in bare)])
    for k in range(0, len(pieces), 2):
        pieces[k] = re.sub(names, lambda m: quoted.get(m[0]) or bare[m[0]], pieces[k])
    return "".join(pieces)


def _finish_excel(p: Package) -> None:
    """Titles cut and made different, references to them, cached results and shared strings that no cell uses any more."""
    if p.titles:
        taken = {s.getAttribute("name").casefold() for s in _all(p.xml("xl/workbook.xml"), "sheet")}
        renames = {}
        for sheet, text in p.titles:
            new, n = text[:TITLE_MAX], 2
            while new.casefold() in taken:
                new, n = f"{text[: TITLE_MAX - len(str(n)) - 1]} {n}", n + 1
            taken.add(new.casefold())
            renames[sheet.getAttribute("name")] = new
            sheet.setAttribute("name", new)
        p.changed.add("xl/workbook.xml")
        for part in [n for n in p.names if re.fullmatch(r"xl/(workbook|(worksheets|charts)/[^/]+)\.xml", n)]:
            for name in ("f", "formula", "formula1", "formula2", "definedName"):
                for node in _all(p.xml(part), name):
                    if (new := repointed(_inner(node), renames)) != _inner(node):
                        p._put(part, node, new)
    if not p.changed:
        return
    used = set()
    for part in [n for n in p.names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]:
        for cell in _all(p.xml(part), "c"):
            if _children(cell, "f"):
                for v in _children(cell, "v"):
                    cell.removeChild(v)
                    p.changed.add(part)
            elif cell.getAttribute("t") == "s":
                used |= {int(_inner(v)) for v in _children(cell, "v")}
    if "xl/sharedStrings.xml" in p.names:
        for k, si in enumerate(_all(p.xml("xl/sharedStrings.xml"), "si")):
            if k not in used and _plain(si):
                for t in _all(si, "t"):
                    p._put("xl/sharedStrings.xml", t, "")


PLACES = {".docx": word_places, ".xlsx": excel_places}


def office_units(suffix: str, name: str, content: bytes) -> Iterator[tuple]:
    for n, x in enumerate(PLACES[suffix](Package(content))):
        yield name, x.surface, x.row, x.col, x.hint, x.text, n


def office_rewritten(suffix: str, content: bytes, marks: dict[int, list[Mark]]) -> bytes:
    """The file with marks (start, end, tag) put in places, by their number; without marks, the same bytes."""
    if not marks:
        return content
    p = Package(content)
    for n, place in enumerate(list(PLACES[suffix](p))):
        if n in marks:
            put_marks(place.leaves, marks[n])
    if suffix == ".xlsx":
        _finish_excel(p)
    return p.saved()
