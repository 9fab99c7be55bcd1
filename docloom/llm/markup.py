"""Text lines of web pages, each with the path of the elements around it."""

from __future__ import annotations

import html
import re

# Element names of HTML by role.
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template iframe object embed svg math canvas audio video head title select option textarea button input label fieldset datalist form dialog map".split())
#: Elements whose content up to the end tag is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand beside the main text.
ASIDE = frozenset("nav header footer aside menu".split())
#: Elements that hold the main text.
MAIN = frozenset("article main".split())
#: Elements inside a line of text; all others end the line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements that end an open paragraph, and those that a start tag of the same group ends.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
GROUPS = ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}, {"thead", "tbody", "tfoot"})
#: Words in a class, id or role that name what stands beside the main text.
BESIDE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail aside footer foot masthead header topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search form comment comments disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager tags widget copyright legal disclaimer skip hidden".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v\u00a0]+")
DIGITS = re.compile("[0-9]+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def beside(name: str, attributes: str) -> bool:
    """Whether an element stands beside the main text by its name, class, id, role or visibility."""
    if name in ASIDE:
        return True
    if not attributes or name in MAIN or name in ("html", "body"):
        return False
    for key, a, b, c in ATTR.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role") and not BESIDE.isdisjoint(x.lower() for x in NAME.findall(value)):
            return True
    return False


def mark(attributes: str) -> str:
    """Class and id of an element without digits, which tell one page's elements apart."""
    if not attributes or "=" not in attributes:
        return ""
    return "".join(f".{DIGITS.sub('', a or b or c)}" for key, a, b, c in ATTR.findall(attributes) if key.lower() in ("class", "id"))


def lines_of(page: str) -> list[tuple[str, str, int]]:
    """(text, path, place) of each line in page order.

    A line is the text between two block borders, with character references decoded, white space (br and
    no-break spaces too) turned into single spaces, and trimmed; empty lines are left out. The path names the block
    elements around it, with their classes. place is 0 beside the main text, 2 inside an article or main element, else 1.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, int, int]] = []  # name, and how many elements beside and main ones are open
    blocks: list[str] = []
    words: list[str] = []
    side = main = 0
    silent: list[str] = []

    def flush():
        if words:
            text = SPACE.sub(" ", html.unescape("".join(words))).strip(" ")
            words.clear()
            if text:
                out.append((text, "/".join(blocks), 0 if side else 2 if main else 1))

    def close(to: int):
        nonlocal side, main
        flush()
        while len(stack) > to:
            name, s, m = stack.pop()
            side, main = side - s, main - m
            if name not in INLINE:
                blocks.pop()

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if not found:
            if not silent:
                words.append(page[at:])
            break
        if found.start() > at and not silent:
            words.append(page[at : found.start()])
        at = max(found.end(), at + 1)
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if silent:
                if name in silent:
                    del silent[len(silent) - 1 - silent[::-1].index(name) :]
                continue
            if name in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        side, main = side - stack[k][1], main - stack[k][2]
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                flush()
            continue
        if silent:
            if name in SILENT and name not in VOID:
                silent.append(name)
            continue
        if name in VOID:
            if name == "br":
                words.append(" ")
            elif name not in INLINE:
                flush()
            continue
        if name in SILENT:
            flush() if name not in ("script", "style", "noscript", "template") else None
            if found[0].endswith("/>"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            else:
                silent.append(name)
            continue
        if name not in INLINE:
            flush()
            if name in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            for group in GROUPS:
                if name in group:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in group:
                            close(k)
                            break
                        if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "article"):
                            break
            blocks.append(name + mark(found[3]))
        s = int(beside(name, found[3] or ""))
        m = int(name in MAIN or "role" in found[3] and any(k.lower() == "role" and (a or b or c).lower() == "main" for k, a, b, c in ATTR.findall(found[3])))
        side, main = side + s, main + m
        stack.append((name, s, m))
    flush()
    return out
