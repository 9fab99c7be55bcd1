"""Model answers as they come in: bytes to events to text to HTML, each piece as soon as it is whole. Pure Python."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

from docloom.functions import layout, lexer, markdown
from docloom.functions.lexer import WS


def payloads(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The JSON of data lines, from bytes cut anywhere; other lines and what is no JSON are left out."""
    decode, line = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
    for piece in ended(pieces):
        *lines, line = (line + decode(piece)).split("\n")
        for x in lines:
            if x.startswith("data:") and x[5:].strip() not in ("", "[DONE]"):
                try:
                    yield json.loads(x[5:])
                except ValueError:
                    continue


def ended(pieces: Iterable[bytes]) -> Iterator[bytes]:
    yield from pieces
    yield b"\n"


def text_of(answer: dict, kind: str) -> str:
    """The text of the first candidate's parts that are no thoughts, or of the first choice."""
    first = next(iter(answer.get(kind) or []), {})
    if kind == "candidates":
        return "".join(p.get("text") or "" for p in (first.get("content") or {}).get("parts") or [] if not p.get("thought"))
    said = (first.get("delta") or {}).get("content")
    return (first.get("message") or {}).get("content") or "" if said is None else said


def deltas(pieces: Iterable[bytes], kind: str) -> Iterator[str]:
    """The text deltas of a model's answer, without empty ones."""
    for answer in payloads(pieces):
        if isinstance(answer, dict) and (text := text_of(answer, kind)):
            yield text


def layout_html(texts: Iterable[str], furniture: bool = False) -> Iterator[str]:
    """Layout divs as HTML; list items that follow each other become one list."""
    rest, items = "", []
    for text in closed(texts):
        found, rest = lexer.cut_blocks(rest + text) if text is not None else ([rest] if rest.strip(WS) else [], "")
        for label, box, page, content in map(layout.decode, found):
            html = layout.element_html(label, layout.attributes(page, box), content, furniture)
            if html and label == "List-item":
                items.append(html)
            elif html:
                yield from run_of(items)
                yield html
    yield from run_of(items)


def closed(texts: Iterable[str]) -> Iterator[str | None]:
    yield from texts
    yield None


def run_of(items: list[str]) -> Iterator[str]:
    if items:
        yield f"<ul>{''.join(items)}</ul>"
        items.clear()


def markdown_html(texts: Iterable[str], attributes: str = "") -> Iterator[str]:
    """Markdown as HTML, a block as soon as it has ended."""
    rest = ""
    for text in texts:
        found, rest = lexer.cut_markdown(rest + text)
        yield from filter(None, (markdown.block(x, attributes) for x in found))
    if last := markdown.block(rest, attributes):
        yield last
