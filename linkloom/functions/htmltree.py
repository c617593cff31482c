"""Per-page HTML scan used inside ``mapInPandas`` (the only per-row Python).

Tree rules follow the lenient html.parser-based builder the original tool
used: void elements close at once, an end tag closes the nearest open
element of that name (and everything opened after it), stray end tags are
ignored, ``<script>``/``<style>`` bodies are raw text, comments and
declarations carry no text.  Text of an element = its stripped text nodes
concatenated without separator (``get_text(strip=True)``).
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr "
                 "basefont bgsound command frame image isindex nextid spacer menuitem".split())

# fixed values: tags and classes of the extraction rules
# elements whose subtree never reaches visible text (H1) / main content (H2)
DROP_VISIBLE = frozenset(["script", "style", "noscript", "nav", "footer", "header"])
DROP_MAIN = DROP_VISIBLE | frozenset(["aside", "form", "iframe", "button"])
INTEREST = frozenset(["title", "meta", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div", "section",
                      "span", "code", "pre", "article", "main"])
BLOCKY = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "li"])
CONTAINER_CLASSES = frozenset(["article", "post", "content", "main-content"])


class _Node:
    __slots__ = ("tag", "attrs", "seq", "parent", "children", "dropped_vis", "dropped_main")

    def __init__(self, tag, attrs, seq, parent):
        self.tag, self.attrs, self.seq, self.parent = tag, attrs, seq, parent
        self.children = []
        pv = parent.dropped_vis if parent is not None else False
        pm = parent.dropped_main if parent is not None else False
        self.dropped_vis = pv or tag in DROP_VISIBLE
        self.dropped_main = pm or tag in DROP_MAIN


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[document]", {}, 0, None)
        self.stack = [self.root]
        self.seq = 0

    def handle_starttag(self, tag, attrs):
        self.seq += 1
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.seq, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.seq += 1
        self.stack[-1].children.append(data)


def parse(html: str) -> _Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # noqa: BLE001 - malformed markup keeps what was parsed
        pass
    return b.root


def _strings(node, drop_attr):
    """Stripped non-empty text nodes under ``node`` skipping dropped subtrees."""
    out = []
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            s = n.strip()
            if s:
                out.append(s)
            continue
        if drop_attr is not None and getattr(n, drop_attr) and n is not node:
            continue
        stack.extend(reversed(n.children))
    return out


def visible_strings(root):
    """H1 scan: stripped strings outside script/style/noscript/nav/footer/header."""
    out = []
    stack = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            s = n.strip()
            if s:
                out.append(s)
            continue
        if n.dropped_vis:
            continue
        stack.extend(reversed(n.children))
    return out


def _has_blocky_descendant(node):
    stack = list(node.children)
    while stack:
        n = stack.pop()
        if isinstance(n, str) or n.dropped_main:
            continue
        if n.tag in BLOCKY:
            return True
        stack.extend(n.children)
    return False


def _is_container(node):
    if node.tag in ("article", "main"):
        return True
    if node.attrs.get("id") == "main-content":
        return True
    classes = set(node.attrs.get("class", "").split())
    return bool(classes & CONTAINER_CLASSES)


def _joined_text(node):
    """Whitespace-normalised text with one space between text nodes (the
    ``text()`` of DOM libraries), used by the page summary (H4)."""
    parts = []
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n.tag == "br":
            parts.append(" ")
        stack.extend(reversed(n.children))
    return " ".join(" ".join(parts).split())


def main_elements(root, keep_all: bool = False):
    """Element scan: one record per element of interest: (seq, tag, text,
    container ancestors, is_container, blocky, meta name, meta content, meta
    property, joined text).  H2 skips the dropped subtrees; ``keep_all``
    (H4) keeps every element."""
    out = []
    first_title = True
    # an explicit stack: pages may nest deeper than Python calls do
    stack = [(c, ()) for c in reversed(root.children)]
    while stack:
        c, containers = stack.pop()
        if isinstance(c, str) or (c.dropped_main and not keep_all):
            continue
        is_c = _is_container(c)
        if c.tag in INTEREST or is_c:
            tag, meta = c.tag, c.tag == "meta"
            if tag == "title":
                tag, first_title = ("title" if first_title else "title2"), False
            out.append((c.seq, tag, "" if meta else "".join(_strings(c, "dropped_main")), list(containers), is_c,
                        _has_blocky_descendant(c) if c.tag in ("div", "section", "span") else False,
                        c.attrs.get("name") if meta else None, c.attrs.get("content") if meta else None,
                        c.attrs.get("property") if meta else None,
                        _joined_text(c) if keep_all and c.tag in ("title", "p") else None))
        inner = (*containers, c.seq) if is_c else containers
        stack.extend((k, inner) for k in reversed(c.children))
    return out


def main_pieces(root):
    """H2 pieces of one page, heaviest first, each ending in sentence punctuation."""
    els = main_elements(root)
    boxes = [e for e in els if e[4]]
    box = max(boxes, key=lambda e: (len(e[2]), -e[0]))[0] if boxes else None
    picked, seen_meta = [], False
    for seq, tag, text, containers, _, blocky, name, content, _, _ in els:
        inside = box is None or (box in containers and seq != box)
        words = len(text.split())
        if tag == "title":
            w, group = 3.0, 0
        elif tag == "meta":
            if name != "description" or seen_meta:
                continue
            seen_meta, text, w, group = True, content or "", 2.5, 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and inside:
            w, group = 2.5 - (int(tag[1]) - 1) * 0.3, 1 + int(tag[1])
        elif tag in ("p", "li") and inside and words >= 3:
            w, group = 1.0, 8
        elif tag in ("div", "section", "span") and inside and not blocky and words >= 5:
            w, group = 0.7, 9
        elif tag in ("code", "pre") and inside and len(text) > 15:
            w, group = 1.2, 10
        else:
            continue
        if text:
            picked.append((-w, group, seq, text if text[-1] in ".!?:;" else text + "."))
    return [p[3] for p in sorted(picked)]


# --- bookmark exports ---------------------------------------------------------
_CREATED_RE = None


def _classes(n):
    return set(n.attrs.get("class", "").split())


def _descendants(n):
    stack = list(reversed(n.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            continue
        yield c
        stack.extend(reversed(c.children))


def _text(n):
    return "".join(_strings(n, None))


def onetab_links(root):
    """Tab-group export: [(group_idx, href, title, created_text)] in file order.

    Groups are ``div.tabGroup`` children of ``div#tabGroupsDiv``; the date is
    the first descendant div whose stripped text is a 'Created ...' line;
    links are ``a.tabLink`` inside ``div.tab`` inside ``div.tabList``.
    """
    import re
    created = re.compile(r"^Created \d{1,2}/\d{1,2}/\d{4}, \d{1,2}:\d{2}:\d{2} [AP]M$")
    out = []
    holders = [n for n in _descendants(root) if n.tag == "div" and n.attrs.get("id") == "tabGroupsDiv"]
    groups = []
    for h in holders:
        groups.extend(c for c in h.children if not isinstance(c, str) and c.tag == "div" and "tabGroup" in _classes(c))
    for idx, g in enumerate(groups):
        date_text = None
        for d in _descendants(g):
            if d.tag == "div" and created.match(_text(d)):
                date_text = _text(d)
                break
        seen = set()
        for lst in _descendants(g):
            if not (lst.tag == "div" and "tabList" in _classes(lst)):
                continue
            for tab in _descendants(lst):
                if not (tab.tag == "div" and "tab" in _classes(tab)):
                    continue
                for a in _descendants(tab):
                    if a.tag == "a" and "tabLink" in _classes(a) and a.seq not in seen:
                        seen.add(a.seq)
                        out.append((idx, a.seq, a.attrs.get("href", ""), _text(a), date_text))
    out.sort(key=lambda r: (r[0], r[1]))
    return [(g, href, title, dt) for g, _, href, title, dt in out]


class _NetscapeScan(HTMLParser):
    """Event scan of a browser bookmark export: ``<h3>`` names the folder
    whose contents are the next ``<dl>``; ``<a>`` is a bookmark.  Emits
    bookmarks and folders in document order with a per-folder ordinal."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.folders = []            # stack of (path, ordinal)
        self.pending = None
        self.in_h3 = self.in_a = False
        self.buf = []
        self.a_attrs = {}
        self.n_dl = 0
        self.saw_root = False
        self.links = []              # (ordinal, folder, href, title, add_date, last_modified)
        self.folder_rows = []        # (ordinal, path)

    def handle_starttag(self, tag, attrs):
        attrs = {k: (v if v is not None else "") for k, v in attrs}
        if tag == "h3":
            self.in_h3, self.buf = True, []
        elif tag == "a":
            self.in_a, self.buf, self.a_attrs = True, [], attrs
        elif tag == "dl":
            if not self.saw_root:
                self.saw_root = True
                self.folders.append(("", self.n_dl))
                self.n_dl += 1
            elif self.pending is not None:
                parent = self.folders[-1][0] if self.folders else ""
                path = f"{parent}/{self.pending}" if parent else self.pending
                self.folders.append((path, self.n_dl))
                self.folder_rows.append((self.n_dl, path))
                self.n_dl += 1
                self.pending = None
            else:
                # a list without a folder heading keeps the enclosing folder
                self.folders.append(self.folders[-1] if self.folders else ("", 0))
        elif tag == "dt":
            self.pending = None

    def handle_endtag(self, tag):
        if tag == "h3" and self.in_h3:
            self.in_h3 = False
            self.pending = "".join(self.buf).strip()
        elif tag == "a" and self.in_a:
            self.in_a = False
            if self.folders:
                path, ordinal = self.folders[-1]
                self.links.append((ordinal, path, self.a_attrs.get("href", ""), "".join(self.buf).strip(),
                                   self.a_attrs.get("add_date"), self.a_attrs.get("last_modified")))
        elif tag == "dl" and self.folders:
            self.folders.pop()

    def handle_data(self, data):
        if self.in_h3 or self.in_a:
            self.buf.append(data)


def netscape_scan(text: str):
    """-> (has_root_dl, links, folders)."""
    s = _NetscapeScan()
    try:
        s.feed(text or "")
        s.close()
    except Exception:  # noqa: BLE001
        pass
    return s.saw_root, s.links, s.folder_rows
