"""The HTML allowlist, in one pass over the text, with handlers that see elements, comments and text."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from dataclasses import dataclass

from docloom.functions.lexer import VOID, WS

# Fixed values.
ALLOWED = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table thead tbody tfoot tr th td caption colgroup col figure figcaption img blockquote pre code strong em b i u s sub sup small mark span br hr a abbr".split())
DROPPED = frozenset("script style iframe object embed noscript template svg math link meta base form input button textarea select option".split())
RAW = frozenset("script style iframe noscript textarea title xmp".split())
EVERYWHERE = ("data-page", "data-bbox")
ATTRIBUTES = {"img": ("src", "alt", "width", "height"), "a": ("href", "title"), "th": ("scope", "colspan", "rowspan", "headers"), "td": ("colspan", "rowspan", "headers"), "col": ("span",), "colgroup": ("span",)}
SAFE = ("https://", "http://", "mailto:", "#")
REL = "noopener noreferrer nofollow"

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def is_safe_url(url: str) -> bool:
    return entities.unescape(url).strip(WS).lower().startswith(SAFE)


@dataclass
class Element:
    """What a handler may read and change of a start tag."""

    name: str
    attributes: dict[str, str]
    removed: bool = False
    unwrapped: bool = False
    changed: bool = False

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    def set(self, name: str, value: str) -> None:
        self.attributes[name] = value.replace('"', "&quot;")
        self.changed = True

    def drop(self, name: str) -> None:
        self.changed |= self.attributes.pop(name, None) is not None

    def remove(self) -> None:
        self.removed = True

    def unwrap(self) -> None:
        self.unwrapped = True


@dataclass
class Handler:
    """Callbacks for elements that a selector (a tag name or *) matches; ``open`` makes them anew for each text."""

    selector: str
    open: Callable[[], dict]


def handler(selector: str, open: Callable[[], dict]) -> Handler:  # noqa: A002
    """``open()`` returns any of ``element``, ``comment`` and ``text`` callbacks, whose state is one text's."""
    return Handler(selector.lower(), open)


def text_handler(selector: str, fn: Callable[[str], str]) -> Handler:
    """``fn`` gets each whole text node inside the selector's elements and returns plain text, which is escaped."""
    return Handler(selector.lower(), lambda: {"text": fn})


def allow(e: Element) -> None:
    """The policy, as the handler that runs first."""
    if e.name in DROPPED:
        e.remove()
        return
    if e.name not in ALLOWED:
        e.unwrap()
        return
    for key in list(e.attributes):
        ok = key in EVERYWHERE or key in ATTRIBUTES.get(e.name, ())
        if not ok or key in ("src", "href") and not is_safe_url(e.attributes[key]):
            e.drop(key)
    if e.name == "a" and "href" in e.attributes:
        e.set("rel", REL)


def sanitize(page: str, handlers: tuple[Handler, ...] = ()) -> str:
    """The text with allowed elements and attributes alone.

    Untouched tags and text stay as they are written. Dropped elements go with their content, which
    handlers still see. Comments go. Unknown elements are unwrapped. An end tag without its start
    goes. An unfinished tag at the end is dropped.
    """
    sets = [(h.selector, h.open()) for h in handlers]
    out: list[str] = []
    stack: list[tuple[str, bool | None]] = []  # open elements, and whether they are written (None: dropped)
    hidden = 0

    def text(raw: str) -> None:
        shown, plain, touched = raw, None, False
        for selector, calls in sets:
            if "text" in calls and (selector == "*" or any(n == selector for n, _ in stack)):
                before = entities.unescape(raw) if plain is None else plain
                plain = calls["text"](before)
                touched |= plain != before
        if touched:
            shown = plain.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        if not hidden:
            out.append(shown)

    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
            text(rest[: cut.start()] if cut else rest)
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<!--"):
                for _, calls in sets:
                    if "comment" in calls:
                        calls["comment"](found[0][4:].removesuffix("-->"))
            continue
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    hidden -= sum(written is None for _, written in stack[k + 1 :])
                    hidden -= 1 if stack[k][1] is None else 0
                    if stack[k][1] and not hidden:
                        out.append(found[0])
                    del stack[k:]
                    break
            continue
        e = Element(name, {})
        for key, a, b, c in ATTR.findall(found[3] or ""):
            e.attributes.setdefault(key.lower(), a or b or c)
        allow(e)
        for selector, calls in sets:
            if "element" in calls and selector in ("*", name):
                calls["element"](e)
        raw_end = None
        if name in RAW:
            raw_end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
        alone = name in VOID or found[0].endswith("/>") and name not in ALLOWED
        if e.removed:
            if alone:
                continue
            if name in RAW:
                hidden += 1
                text(page[at : raw_end.start() if raw_end else n])
                hidden -= 1
                at = raw_end.end() if raw_end else n
                continue
            hidden += 1
            stack.append((name, None))
            continue
        written = not e.unwrapped
        if written and not hidden:
            out.append("<" + found[2] + "".join(f' {k}="{v}"' for k, v in e.attributes.items()) + ">" if e.changed else found[0])
        if name in RAW:
            text(page[at : raw_end.start() if raw_end else n])
            at = raw_end.end() if raw_end else n
            if written and raw_end and not hidden:
                out.append(raw_end[0])
        elif not alone:
            stack.append((name, written))
    return "".join(out)
