"""The element tree that a browser makes of a page, however much its author left out or misplaced.

A small tree builder over the standard tokenizer: html, head and body are implied, what may end without an end tag ends
where a browser ends it, stray content of a table goes before it, formatting that is closed in the wrong order is split,
the text of some elements is never markup, and SVG and MathML follow their own rules. Where a table, row or cell stands
open is read off the stack of open elements, so there is no mode to keep. Frames and templates' own rules are left out.
"""

from __future__ import annotations

import html
from html.parser import HTMLParser

#: Tags without content, tags whose text is not markup (entities count in the last two), tags a head may hold.
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr")
PLAIN = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea", "title")
OF_HEAD = ("base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title")
#: Start tags that end an open paragraph, and end tags that end what is open inside.
BLOCKS = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "header", "hgroup", "listing", "main", "menu", "nav", "ol", "pre", "search", "section", "summary", "ul")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
#: End tags that are implied where something around them ends.
IMPLIED = ("dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc")
#: What an end tag can't reach through, in general, for paragraphs, list items and parts of tables.
SCOPE = frozenset(("applet", "caption", "html", "table", "td", "th", "marquee", "object", "template", "foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"))
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset(("html", "table", "template"))
#: Elements that a stray end tag or a new list item doesn't reach through.
SPECIAL = frozenset((*BLOCKS, *HEADINGS, *VOID, "applet", "body", "button", "caption", "colgroup", "dd", "dt", "form", "frameset", "head", "html", "iframe", "li", "marquee", "noembed", "noframes", "noscript", "object", "p", "plaintext", "script", "select", "style", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr", "xmp"))
SECTIONS, CELLS = ("tbody", "thead", "tfoot"), ("td", "th")
OF_TABLE = ("caption", "col", "colgroup", *SECTIONS, *CELLS, "tr")
_PLACES = frozenset(("select", "table", "colgroup", "caption", "tr", *SECTIONS, *CELLS))
#: HTML tags that end SVG and MathML, and foreign elements that hold HTML again.
BREAKS_OUT = ("b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", *HEADINGS, "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var")
#: Fixed value: elements that stand open at once at most; further ones stand beside one another.
DEEPEST = 512
HOLDS_HTML = ("foreignobject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml")


class Node:
    """An element: its tag, attributes, parent, and children, which are elements and texts."""

    __slots__ = ("attrs", "foreign", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False) -> None:
        self.tag, self.attrs, self.foreign, self.parent, self.kids = tag, attrs, foreign, None, []

    def put(self, child: Node | str, before: Node | None = None) -> None:
        at = len(self.kids) if before is None else next(k for k, x in enumerate(self.kids) if x is before)
        if isinstance(child, Node):
            child.leave()
            at = len(self.kids) if before is None else next(k for k, x in enumerate(self.kids) if x is before)
            child.parent = self
        self.kids.insert(at, child)

    def leave(self) -> None:
        if self.parent is not None:
            self.parent.kids = [x for x in self.parent.kids if x is not self]
            self.parent = None


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open, self.formats = [self.root], []  # a None among the latter is a marker: cells and objects start afresh
        self.head = self.body = self.form = None
        self.fostering = self.skip_line = self.standard = False

    @classmethod
    def tree(cls, page: str) -> Node:
        builder = cls()
        builder.feed(page)
        builder.close()
        if builder.cdata_elem and builder.rawdata:  # an element of plain text that never ends
            builder.handle_data(builder.rawdata)
        builder._in_body()
        return builder.root

    # the stack of open elements

    def _has(self, tags: tuple[str, ...], scope: frozenset[str] = SCOPE) -> bool:
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in scope:
                return False
        return False

    def _pop_to(self, tags: tuple[str, ...]) -> None:
        """Ends the innermost open element of these tags, and all in it."""
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def _clear_to(self, tags: tuple[str, ...]) -> None:
        while self.open[-1].tag not in (*tags, "html", "template"):
            self.open.pop()

    def _imply_ends(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self.open.pop()

    def _end_paragraph(self) -> None:
        if self._has(("p",), BUTTON_SCOPE):
            self._imply_ends("p")
            self._pop_to(("p",))

    def _clear_formats(self) -> None:
        while self.formats and self.formats.pop() is not None:
            pass

    def _place(self) -> str:
        """The part of a table or the select that is innermost, or the body."""
        for n in reversed(self.open):
            if n.tag in _PLACES and not n.foreign:
                return n.tag
            if n.tag == "template":
                break
        return "body"

    def _in_body(self) -> None:
        """From here on the page has a body."""
        if self.head is None:
            self.head = Node("head", {})
            self.root.put(self.head)
        if self.body is None:
            self.body = Node("body", {})
            self.root.put(self.body)
            self.open = [self.root, self.body]

    # insertion

    def _put(self, child: Node | str) -> None:
        under = self.open[-1]
        if self.fostering and under.tag in ("table", "tr", *SECTIONS):
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.put(child, table)
                return
        under.put(child)

    def _insert(self, tag: str, attrs: dict[str, str], foreign: bool = False, empty: bool = False) -> Node:
        del self.open[DEEPEST:]
        node = Node(tag, attrs, foreign)
        self._put(node)
        if not empty:
            self.open.append(node)
        return node

    def _reopen(self) -> None:
        """Formatting that is still meant but was closed with something around it starts again."""
        k = len(self.formats)
        while k and self.formats[k - 1] is not None and self.formats[k - 1] not in self.open:
            k -= 1
        for at in range(k, len(self.formats)):
            self.formats[at] = self._insert(self.formats[at].tag, self.formats[at].attrs)

    def _format(self, node: Node) -> None:
        alike = 0
        for at in range(len(self.formats) - 1, -1, -1):
            other = self.formats[at]
            if other is None:
                break
            alike += other.tag == node.tag and other.attrs == node.attrs
            if alike == 3:
                del self.formats[at]
                break
        self.formats.append(node)

    def _end_format(self, tag: str) -> None:
        """Ends a formatting element; blocks that stand open in it keep its formatting."""
        if self.open[-1].tag == tag and self.open[-1] not in self.formats:
            self.open.pop()
            return
        for _ in range(8):
            own = next((n for n in reversed(self.formats[self._after_marker() :]) if n.tag == tag), None)
            if own is None:
                self._end_other(tag)
                return
            if own not in self.open:
                self.formats.remove(own)
                return
            at = self.open.index(own)
            if not self._has((tag,)):
                return
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.formats.remove(own)
                return
            around, bookmark = self.open[at - 1], self.formats.index(own)
            last, k, inner = block, self.open.index(block), 0
            while (k := k - 1) > at:
                node, inner = self.open[k], inner + 1
                if inner > 3 and node in self.formats:
                    self.formats.remove(node)
                if node not in self.formats:
                    self.open.remove(node)
                    continue
                copy = Node(node.tag, node.attrs)
                self.formats[self.formats.index(node)] = self.open[k] = copy
                if last is block:
                    bookmark = self.formats.index(copy) + 1
                copy.put(last)
                last = copy
            last.leave()
            if around.tag in ("table", "tr", *SECTIONS):
                table = next(n for n in reversed(self.open) if n.tag == "table")
                (table.parent or around).put(last, table if table.parent else None)
            else:
                around.put(last)
            copy = Node(own.tag, own.attrs)
            for child in block.kids[:]:
                if isinstance(child, Node):
                    child.parent = copy
                copy.kids.append(child)
            block.kids = []
            block.put(copy)
            bookmark -= self.formats.index(own) < bookmark
            self.formats.remove(own)
            self.formats.insert(bookmark, copy)
            self.open.remove(own)
            self.open.insert(self.open.index(block) + 1, copy)

    def _after_marker(self) -> int:
        return next((k + 1 for k in range(len(self.formats) - 1, -1, -1) if self.formats[k] is None), 0)

    # tokens

    def set_cdata_mode(self, elem: str) -> None:
        if not self.open[-1].foreign:  # plain text is a matter of HTML alone
            super().set_cdata_mode(elem)

    def handle_decl(self, decl: str) -> None:
        self.standard |= decl.lower().split()[:2] == ["doctype", "html"]

    def unknown_decl(self, data: str) -> None:
        if self.open[-1].foreign and data.startswith("CDATA["):
            self._put(data[6:])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, False)

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool) -> None:
        self.skip_line = False
        had = {k: v or "" for k, v in reversed(attrs)}
        now = self.open[-1]
        if now.foreign and not (now.tag in HOLDS_HTML and tag not in ("mglyph", "malignmark")):
            if tag not in BREAKS_OUT and not (tag == "font" and {"color", "face", "size"} & {*had}):
                self._insert(tag, had, foreign=True, empty=closed)
                return
            while self.open[-1].foreign and self.open[-1].tag not in HOLDS_HTML:
                self.open.pop()
        if tag in ("html", "body"):
            if tag == "body":
                self._in_body()
            node = self.body if tag == "body" else self.root
            node.attrs.update({k: v for k, v in had.items() if k not in node.attrs})
            return
        if self.body is None:
            if tag == "head":
                if self.head is None:
                    self.head = Node("head", had)
                    self.root.put(self.head)
                return
            if tag in OF_HEAD:
                if self.head is None:
                    self.head = Node("head", {})
                    self.root.put(self.head)
                self.open = [self.root, self.head]
                self._insert(tag, had, empty=tag in VOID)
                if tag in PLAIN:
                    self.set_cdata_mode(tag)
                return
            if self.open[-1].tag != "template" and not any(n.tag == "template" for n in self.open):
                self._in_body()
        if tag in ("head", "frame", "frameset"):
            return
        self._start_in(self._place(), tag, had, closed)

    def _start_in(self, place: str, tag: str, had: dict[str, str], closed: bool) -> None:
        if place == "select":
            if tag in ("option", "optgroup", "hr"):
                if self.open[-1].tag == "option":
                    self.open.pop()
                if tag != "option" and self.open[-1].tag == "optgroup":
                    self.open.pop()
                self._insert(tag, had, empty=tag == "hr")
            elif tag in ("script", "template"):
                self._start_in("body", tag, had, closed)
            elif tag in ("select", "input", "keygen", "textarea") or tag in (*OF_TABLE, "table") and any(n.tag == "table" for n in self.open):
                self._pop_to(("select",))
                if tag != "select":
                    self._start_in(self._place(), tag, had, closed)
            return
        if place in (*CELLS, "caption") and tag in OF_TABLE:
            self._end_part((place,))
            self._start_in(self._place(), tag, had, closed)
            return
        if place == "colgroup":
            if tag == "col":
                self._insert(tag, had, empty=True)
                return
            self._pop_to(("colgroup",))
            self._start_in(self._place(), tag, had, closed)
            return
        if place in ("table", "tr", *SECTIONS) and self._start_in_table(place, tag, had, closed):
            return
        self.fostering = place in ("table", "tr", *SECTIONS)
        self._start_in_body(tag, had, closed)
        self.fostering = False

    def _start_in_table(self, place: str, tag: str, had: dict[str, str], closed: bool) -> bool:
        if tag in OF_TABLE:
            if tag in CELLS:
                if place == "table":
                    self._clear_to(("table",))
                    self._insert("tbody", {})
                if place != "tr":
                    self._clear_to(SECTIONS)
                    self._insert("tr", {})
                self._clear_to(("tr",))
                self.formats.append(None)
            elif tag == "tr":
                if place == "table":
                    self._clear_to(("table",))
                    self._insert("tbody", {})
                self._clear_to(SECTIONS)
            else:
                self._clear_to(("table",))
                if tag == "col":
                    self._insert("colgroup", {})
                elif tag == "caption":
                    self.formats.append(None)
            self._insert(tag, had, empty=tag == "col")
            return True
        if tag == "table":
            self._pop_to(("table",))
            self._start_in(self._place(), tag, had, closed)
        elif tag in ("script", "style", "template"):
            self._start_in_body(tag, had, closed)
        elif tag == "input" and had.get("type", "").lower() == "hidden":
            self._insert(tag, had, empty=True)
        elif tag == "form":
            if self.form is None:
                self.form = self._insert(tag, had, empty=True)
        else:
            return False
        return True

    def _start_in_body(self, tag: str, had: dict[str, str], closed: bool) -> None:
        if tag in OF_TABLE:
            return
        if tag in BLOCKS or tag in HEADINGS or tag in ("p", "form", "hr", "li", "dd", "dt", "xmp", "plaintext") or tag == "table" and self.standard:
            if tag == "form" and self.form is not None:
                return
            if tag in ("li", "dd", "dt"):
                alike = ("li",) if tag == "li" else ("dd", "dt")
                for n in reversed(self.open):
                    if n.tag in alike:
                        self._imply_ends(n.tag)
                        self._pop_to((n.tag,))
                        break
                    if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                        break
            self._end_paragraph()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
            node = self._insert(tag, had, empty=tag == "hr")
            if tag == "form":
                self.form = node
            self.skip_line = tag in ("pre", "listing")
        elif tag in FORMATTING:
            if tag == "a" and any(n.tag == "a" for n in self.formats[self._after_marker() :]) or tag == "nobr" and self._has(("nobr",)):
                old = next((n for n in reversed(self.formats) if n is not None and n.tag == tag), None)
                self._end_format(tag)
                self.formats = [n for n in self.formats if n is not old]
                self.open = [n for n in self.open if n is not old]
            self._reopen()
            self._format(self._insert(tag, had))
        elif tag in ("script", "style", "template", "noscript", "noframes", "title", "link", "meta", "base", "param", "source", "track"):
            self._insert(tag, had, empty=tag in VOID)
        elif tag in ("svg", "math"):
            self._reopen()
            self._insert(tag, had, foreign=True, empty=closed)
        else:
            if tag == "button" and self._has(("button",)):
                self._imply_ends()
                self._pop_to(("button",))
            if tag in ("optgroup", "option") and self.open[-1].tag == "option":
                self.open.pop()
            if tag in ("rb", "rtc", "rp", "rt") and self._has(("ruby",)):
                self._imply_ends("" if tag in ("rb", "rtc") else "rtc")
            if tag not in ("textarea", "iframe", "noembed"):
                self._reopen()
            self._insert("img" if tag == "image" else tag, had, empty=tag in VOID or tag == "image")
            if tag in ("applet", "marquee", "object"):
                self.formats.append(None)
            self.skip_line = tag == "textarea"
        if tag in PLAIN:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        self.skip_line = False
        if self.open[-1].foreign:
            if tag not in ("br", "p"):
                for k in range(len(self.open) - 1, 0, -1):
                    if not self.open[k].foreign:
                        break
                    if self.open[k].tag == tag:
                        del self.open[k:]
                        return
            else:
                while self.open[-1].foreign:
                    self.open.pop()
        if self.body is None:
            if tag in PLAIN or tag == "template":
                if any(n.tag == tag for n in self.open):
                    self._pop_to((tag,))
                return
            if tag not in ("body", "html", "br", "p"):
                return
            self._in_body()
        if tag in ("body", "html"):
            return
        self._end_in(self._place(), tag)

    def _end_in(self, place: str, tag: str) -> None:
        if place == "select":
            if tag == "optgroup" and self.open[-1].tag == "option" and self.open[-2].tag == "optgroup":
                self.open.pop()
            if tag == self.open[-1].tag and tag in ("option", "optgroup") or tag in ("script", "template") and self.open[-1].tag == tag:
                self.open.pop()
            elif tag == "select":
                self._pop_to(("select",))
            elif tag in (*OF_TABLE, "table") and self._has((tag,), TABLE_SCOPE):
                self._pop_to(("select",))
                self._end_in(self._place(), tag)
        elif tag in (*OF_TABLE, "table"):
            if tag == "table" and self._has(("table",), TABLE_SCOPE) or tag not in ("table", "col") and self._has((tag,), TABLE_SCOPE):
                self._end_part((tag,))
        else:
            self.fostering = place in ("table", "tr", *SECTIONS)
            self._end_in_body(tag)
            self.fostering = False

    def _end_part(self, tags: tuple[str, ...]) -> None:
        """Ends a part of a table; what is open in it ends, and cells on the way take their formatting along."""
        while len(self.open) > 1:
            tag = self.open.pop().tag
            if tag in (*CELLS, "caption"):
                self._clear_formats()
            if tag in tags:
                return

    def _end_in_body(self, tag: str) -> None:
        if tag == "p":
            if not self._has(("p",), BUTTON_SCOPE):
                self._insert("p", {})
            self._end_paragraph()
        elif tag == "br":
            self._start_in_body("br", {}, False)
        elif tag == "form":
            form, self.form = self.form, None
            if form in self.open:
                self._imply_ends()
                self.open.remove(form)
        elif tag in HEADINGS:
            if self._has(HEADINGS):
                self._imply_ends()
                self._pop_to(HEADINGS)
        elif tag in BLOCKS or tag in ("button", "li", "dd", "dt", "applet", "marquee", "object"):
            if self._has((tag,), LIST_SCOPE if tag == "li" else SCOPE):
                self._imply_ends(tag if tag in ("li", "dd", "dt") else "")
                self._pop_to((tag,))
                if tag in ("applet", "marquee", "object"):
                    self._clear_formats()
        elif tag in FORMATTING:
            self._end_format(tag)
        else:
            self._end_other(tag)

    def _end_other(self, tag: str) -> None:
        for n in reversed(self.open):
            if n.tag == tag:
                self._imply_ends(tag)
                self._pop_to((tag,))
                return
            if n.tag in SPECIAL:
                return

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in ("textarea", "title"):
            data = html.unescape(data)
        if self.skip_line:
            data, self.skip_line = data.removeprefix("\n"), False
        plain = self.open[-1].tag in PLAIN or self.open[-1].foreign or any(n.tag == "template" for n in self.open)
        if self.body is None and not plain:
            if not (data := data.lstrip("\t\n\f\r ")):
                return
            self._in_body()
        if not data:
            return
        place = "body" if plain else self._place()
        if place == "colgroup" and data.strip("\t\n\f\r "):
            self._pop_to(("colgroup",))
            place = "table"
        self.fostering = place in ("table", "tr", *SECTIONS) and bool(data.strip("\t\n\f\r "))
        if not plain and place not in ("select", "colgroup") and (self.fostering or place not in ("table", "tr", *SECTIONS)):
            self._reopen()
        self._put(data)
        self.fostering = False
