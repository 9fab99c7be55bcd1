"""Inline marks of a line of text, found by scanning for their delimiters. Pure Python, used inside Arrow UDFs.

A mark is found from left to right with ``str.find``; a line without any delimiter costs one look.
Marks of one kind are set before those of the next, so a later kind also acts inside an earlier one.
"""

from __future__ import annotations

import re

from docloom.functions.lexer import WS

# Fixed values.
ENTITY = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#")
#: Delimiter, element, and whether it must stand at a word's start, in the order in which marks are set.
PAIRS = (("`", "code", False), ("**", "strong", False), ("*", "em", True), ("_", "em", True))
WEB = ("http://", "https://")
#: A line without any of these stays as it is.
SPECIAL = re.compile(r"[&<>`*_\[]")


def escape_text(text: str) -> str:
    """Escapes angle brackets, and ampersands that begin no entity."""
    if "&" in text:
        first, *others = text.split("&")
        out = [first]
        for piece in others:
            name, end, _ = piece.partition(";")
            out.append(("&" if end and name and ENTITY.issuperset(name) else "&amp;") + piece)
        text = "".join(out)
    return text.replace("<", "&lt;").replace(">", "&gt;")


def paired(text: str, mark: str, name: str, at_start: bool) -> str:
    """Text between two marks becomes an element. It has no mark's character in it and isn't empty; with
    ``at_start`` the first mark follows the beginning, white space or ( and a visible character follows it."""
    out, done, at = [], 0, text.find(mark)
    while at != -1:
        begin = at + len(mark)
        stop = text.find(mark[0], begin)
        if stop == -1:
            break
        fits = stop > begin and text.startswith(mark, stop)
        if fits and at_start:
            fits = (at == 0 or text[at - 1] in WS or text[at - 1] == "(") and text[begin] not in WS
        if fits:
            out += (text[done:at], f"<{name}>", text[begin:stop], f"</{name}>")
            done = stop + len(mark)
        at = text.find(mark, done if fits else at + 1)
    return "".join([*out, text[done:]]) if out else text


def linked(text: str) -> str:
    """``[words](address)`` becomes a link if the address is one of the web without white space."""
    out, done, at = [], 0, text.find("[")
    while at != -1:
        middle = text.find("]", at)
        if middle == -1:
            break
        stop = text.find(")", middle) if text.startswith("](", middle) and middle > at + 1 else -1
        address = text[middle + 2 : stop] if stop != -1 else ""
        scheme = next((s for s in WEB if address.startswith(s)), "")
        fits = scheme and len(address) > len(scheme) and not any(c in WS for c in address)
        if fits:
            out += (text[done:at], f'<a href="{address}">', text[at + 1 : middle], "</a>")
            done = stop + 1
        at = text.find("[", done if fits else at + 1)
    return "".join([*out, text[done:]]) if out else text


def inline(text: str) -> str:
    """A line as HTML: trimmed, escaped, then code, strong, emphasis by stars and by underscores, links."""
    text = text.strip(WS)
    if not SPECIAL.search(text):
        return text
    text = escape_text(text)
    for mark, name, at_start in PAIRS:
        if mark in text:
            text = paired(text, mark, name, at_start)
    return linked(text) if "[" in text else text


def marker(line: str) -> int:
    """Characters of the list marker at the start of a line: a sign, or a number with . or ); 0 without one."""
    if line[:1] in ("-", "*", "+"):
        return 1
    digits = len(line) - len(line.lstrip("0123456789"))
    return digits + 1 if digits and line[digits : digits + 1] in (".", ")") else 0


def item_text(line: str) -> str | None:
    """A list item without its marker; None for a line that is none."""
    bare = line.lstrip(WS)
    n = marker(bare)
    return bare[n:].lstrip(WS) if n and bare[n : n + 1] and bare[n] in WS else None


def heading(line: str) -> tuple[int, str]:
    """How many # a line begins with (6 count), and what follows them."""
    bare = line.lstrip(WS)
    n = min(6, len(bare) - len(bare.lstrip("#")))
    return n, bare[n:] if n else line
