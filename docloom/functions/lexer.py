"""Pure Python on HTML and markdown text: cutting, balance, provisional closing. Used inside Arrow UDFs.

One scan position moves over the text, so a text is read once however it was cut into chunks.
"""

from __future__ import annotations

import re

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPENABLE = frozenset("table thead tbody tfoot ul ol dl".split())
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9-]*)", re.ASCII)
ID = re.compile(r"[A-Za-z][A-Za-z0-9_-]*\Z", re.ASCII)
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


TAG_REST = re.compile(r"""(?>[^"'>]+|"[^"]*"|'[^']*')*+>""")


def tag_end(html: str, start: int) -> int:
    """Just after the > that ends the tag at ``start``, past quoted values; -1 if it isn't there yet."""
    found = TAG_REST.match(html, start + 1)
    return found.end() if found else -1


def tags(html: str, start: int = 0):
    """(name, closing, self-closing, begin, end) of each tag; comments as name ''. Stops at an unfinished one."""
    at = html.find("<", start)
    while at != -1:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if end == -1:
                return
            yield "", False, False, at, end + 3
            at = html.find("<", end + 3)
            continue
        name = NAME.match(html, at + 1)
        if not name:
            at = html.find("<", at + 1)
            continue
        end = tag_end(html, at)
        if end == -1:
            return
        yield name[1].lower(), html[at + 1] == "/", html[end - 2] == "/", at, end
        at = html.find("<", end)


def element_end(html: str, start: int = 0) -> int:
    """End of the element at ``start`` by depth alone, whatever the end tags are called; -1 if it is open."""
    depth = 0
    for name, closing, alone, _, end in tags(html, start):
        if not name:
            continue
        if closing:
            depth -= 1
        elif not alone and name not in VOID:
            depth += 1
        if depth <= 0:
            return end
    return -1


def cut_blocks(buffer: str) -> tuple[list[str], str]:
    """Complete top-level elements and the rest. Loose text before a tag becomes a paragraph."""
    out, at, n = [], 0, len(buffer)
    while at < n:
        while at < n and buffer[at] in WS:
            at += 1
        if at >= n:
            break
        if buffer[at] == "<":
            if buffer.startswith("</", at):  # a stray end tag closes nothing
                end = tag_end(buffer, at)
                if end == -1:
                    break
                at = end
                continue
            if not NAME.match(buffer, at + 1) and not buffer.startswith("<!--", at):
                break
            end = element_end(buffer, at)
            if end == -1:
                break
            out.append(buffer[at:end])
            at = end
            continue
        tag = buffer.find("<", at)
        if tag == -1:
            break
        out.append(f"<p>{buffer[at:tag].strip(WS)}</p>")
        at = tag
    return out, buffer[at:]


class Scanner:
    """``cut_blocks`` over a text that comes in pieces: what was read of an open element is not read again.

    ``held`` is the read part of the open element, ``tail`` what is still to be read, ``names`` the open
    elements from the outside in and ``done`` how many finished children each has.
    """

    def __init__(self, held: str = "", tail: str = "", names: list[str] | None = None, done: list[int] | None = None):
        self.held, self.tail, self.names, self.done = [held] if held else [], tail, names or [], done or []
        self.size = len(held)

    def state(self) -> list:
        return ["".join(self.held), self.tail, self.names, self.done]

    def rest(self) -> str:
        return "".join([*self.held, self.tail])

    def finished(self) -> int:
        """Finished children of the open lists and tables, from the outside in as far as they are such."""
        n = 0
        for name, k in zip(self.names, self.done):
            if name not in OPENABLE:
                break
            n += k
        return n

    def feed(self, text: str) -> list[str]:
        """The elements that ``text`` finishes, and loose text before an element as a paragraph."""
        self.tail += text
        out: list[str] = []
        while self.held or self.begin(out):
            at, ended = 0, False
            for name, closing, alone, _, end in tags(self.tail):
                at = end
                if not name:
                    continue
                if not closing and not alone and name not in VOID:
                    self.names.append(name)
                    self.done.append(0)
                    continue
                if closing and self.names:
                    self.names.pop()
                    self.done.pop()
                if not self.names:
                    ended = True
                    break
                self.done[-1] += 1
            if at:
                self.held.append(self.tail[:at])
                self.tail = self.tail[at:]
                self.size += at
            if not ended:
                break
            out.append("".join(self.held))
            self.held, self.size = [], 0
        return out

    def begin(self, out: list[str]) -> bool:
        """Whether an element begins the tail, once loose text and stray end tags are off."""
        while True:
            self.tail = self.tail.lstrip(WS)
            if not self.tail:
                return False
            if self.tail.startswith("</"):
                end = tag_end(self.tail, 0)
                if end == -1:
                    return False
                self.tail = self.tail[end:]
            elif self.tail[0] == "<":
                return bool(NAME.match(self.tail, 1)) or self.tail.startswith("<!--")
            else:
                tag = self.tail.find("<")
                if tag == -1:
                    return False
                out.append(f"<p>{self.tail[:tag].strip(WS)}</p>")
                self.tail = self.tail[tag:]


def balanced_end(html: str) -> int:
    """End of the first element with end tags matched by name; -1 for anything else."""
    if not html.startswith("<") or html.startswith("<!"):
        return -1
    stack: list[str] = []
    for name, closing, _, _, end in tags(html):
        if not name:
            continue
        if closing:
            if not stack or stack.pop() != name:
                return -1
        elif name not in VOID:
            stack.append(name)
        if not stack:
            return end
    return -1


def is_complete(html: str) -> bool:
    return bool(html) and balanced_end(html) == len(html)


def root_id(html: str) -> str | None:
    end = tag_end(html, 0) if html.startswith("<") else -1
    name = NAME.match(html, 1) if end != -1 else None
    for key, a, b, c in ATTR.findall(html[name.end() : end - 1]) if name else ():
        if key.lower() == "id":
            return a or b or c or None
    return None


def is_single_block(html: str, ident: str) -> bool:
    return bool(ID.match(ident or "")) and is_complete(html) and root_id(html) == ident


def text_paragraph(html: str) -> str:
    text = re.sub(f"[{WS}]+", " ", re.sub("<[^>]*>", " ", html)).strip(WS)
    return "<p>" + text.replace("<", "&lt;").replace(">", "&gt;") + "</p>" if text else ""


def normalize(html: str) -> list[str]:
    """Complete balanced elements; what isn't degrades to its text."""
    out, rest = cut_blocks(html)
    out = [x if is_complete(x) else text_paragraph(x) for x in out]
    return [x for x in [*out, text_paragraph(rest) if rest.strip(WS) else ""] if x]


def provisional(rest: str) -> tuple[str, int] | None:
    """An open list or table closed around its finished children, and their number; None without any."""
    html = rest.lstrip(WS)
    name = NAME.match(html, 1) if html.startswith("<") else None
    end = tag_end(html, 0) if name else -1
    if end == -1 or name[1].lower() not in OPENABLE or element_end(html) != -1:
        return None
    inner, left = cut_blocks(html[end:])
    inner = [x for x in inner if not x.startswith("<p>") or x in html]
    deeper = provisional(left)
    n = len(inner) + (deeper[1] if deeper else 0)
    if not n:
        return None
    return f"{html[:end]}{''.join(inner)}{deeper[0] if deeper else ''}</{name[1].lower()}>", n


def strip_fence(text: str, start: bool = True, end: bool = True) -> str:
    if start:
        text = re.sub(rf"\A[{WS}]*```(?:html)?[{WS}]*", "", text, flags=re.I)
    return re.sub(rf"[{WS}]*```[{WS}]*\Z", "", text) if end else text


def cut_markdown(buffer: str) -> tuple[list[str], str]:
    """Markdown blocks and the rest. A blank line ends a block, but not inside a fence; either fence closes one."""
    out: list[str] = []
    own: list[str] = []
    fenced = False
    *lines, last = buffer.split("\n")
    for line in lines:
        mark = line.lstrip(WS).startswith(("```", "~~~"))
        blank = not fenced and not line.strip(WS)
        if not blank:
            own.append(line)
        if own and (blank or mark and fenced):
            out.append("\n".join(own))
            own = []
        fenced ^= mark
    return [x for x in out if x.strip(WS)], "\n".join([*own, last]) if own else last


def should_paint(size: int, painted: int, quiet_ms: float, growth: float = 1.25, least_ms: float = 120, most_ms: float = 1200) -> bool:
    """Whether a growing part is shown again: at once the first time, then by growth or by quiet, never too soon."""
    if painted == 0:
        return True
    return quiet_ms >= least_ms and (size >= painted * growth or quiet_ms >= most_ms)
