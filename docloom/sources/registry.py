"""Plugins: parsers (sources to HTML chunks), splitters (sources to parts), credentials."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources import streams
from docloom.sources.pdf import Pdf
from docloom.sources.scans import paragraphs

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SPLITTERS: dict[str, Callable[[bytes], tuple[str, list[bytes]]]] = {}


def register_parser(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """``fn(sources) -> chunks``: doc_id, part_index, chunk_seq, delta, is_last."""
    PARSERS[name] = fn


def parser_named(name: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The parser of this name, or the one that the environment's PARSER names."""
    name = name or os.environ.get("PARSER", "plain_text")
    if name not in PARSERS:
        raise LookupError(f"No parser is called {name}; there are {', '.join(sorted(PARSERS))}.")
    return PARSERS[name]


def register_splitter(media_type: str, fn: Callable[[bytes], tuple[str, list[bytes]]]) -> None:
    """``fn(content) -> (unit, parts)``."""
    SPLITTERS[media_type] = fn


def credential(own: str | None, option: str | None = None, variable: str = "PARSER_API_KEY") -> str | None:
    """The conversion's own key, else the plugin's, else the environment's. Kept on the driver and in closures, never in a column."""
    return next((k.strip() for k in (own, option, os.environ.get(variable)) if k and k.strip()), None)


class Part(int):
    """The number of a part, from 1, with what the parts are called and how many there are."""

    unit: str
    total: int | None

    def __new__(cls, index: int, unit: str | None = None, total: int | None = None):
        self = super().__new__(cls, index)
        self.unit, self.total = unit or "part", total
        return self


CHUNKS = "doc_id string, part_index int, chunk_seq long, delta string, error string, is_last boolean"
PART_COLUMNS = {"part_index": "int", "unit": "string", "total": "int"}


def function_parser(fn: Callable[[bytes, str, Part | None], Iterator[str]], retries: int = 2, wait: Callable[[int], float] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A parser of a Python function that yields HTML for one source or part.

    A part that fails is tried anew from its start up to ``retries`` times, with growing waits; then
    its row carries the error and the other parts go on. Whole documents are tried once. Empty
    deltas are left out; only the row that ends a source or part is its last.
    """
    pause = wait or (lambda n: min(600 * 2**n, 5000) / 1000)

    def read(r) -> list[tuple]:
        part = None if pd.isna(r.part_index) else Part(int(r.part_index), r.unit, None if pd.isna(r.total) else int(r.total))
        attempts = 1 if part is None else 1 + retries
        for attempt in range(attempts):
            try:
                deltas = [d for d in fn(r.content, r.media_type, part) if d]
                ends = [*((d, False) for d in deltas), ("", True)]
                return [(r.doc_id, part, k, d, None, last) for k, (d, last) in enumerate(ends)]
            except Exception as error:  # noqa: BLE001  a plugin's failure is the part's result
                reason = str(error) or type(error).__name__
                if attempt < attempts - 1:
                    time.sleep(pause(attempt))
        return [(r.doc_id, part, 0, "", reason, False)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            out = [x for r in batch.itertuples() for x in read(r)]
            yield pd.DataFrame(out, columns=columns).astype({"part_index": "Int32", "chunk_seq": "int64"})

    def parse(sources: DataFrame) -> DataFrame:
        missing = {c: F.lit(None).cast(t) for c, t in PART_COLUMNS.items() if c not in sources.columns}
        return sources.withColumns(missing).select("doc_id", "content", "media_type", *PART_COLUMNS).mapInPandas(rows, CHUNKS)

    parse.retrying = lambda n: function_parser(fn, n, wait)
    return parse


def part_address(url: str, part: Part | None) -> str:
    """The address of a source or part at a service (see ``scans.part_url``)."""
    from urllib.parse import quote_plus

    if part is None:
        return url
    return f"{url}{'&' if '?' in url else '?'}unit={quote_plus(part.unit)}&index={int(part)}&total={part.total}"


def http_parser(url: str, token: str | None = None, timeout: float = 90, post: Callable | None = None) -> Callable[[DataFrame], DataFrame]:
    """A parser at a service of one's own: posts the bytes, reads the HTML that comes back.

    ``post(address, content, headers) -> pieces of bytes`` stands for the network, as in tests.
    """
    send = post or posted(timeout)

    def parse(content: bytes, media_type: str, part: Part | None) -> Iterator[str]:
        import codecs

        headers = {"content-type": media_type} | ({"authorization": f"Bearer {token}"} if token else {})
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        for piece in send(part_address(url, part), content, headers):
            yield decode(piece)
        yield decode(b"", True)

    return function_parser(parse)


def posted(timeout: float) -> Callable[[str, bytes, dict], Iterator[bytes]]:
    """Posts over HTTP; an answer that is no success is an error with the start of its text."""

    def send(address: str, content: bytes, headers: dict) -> Iterator[bytes]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(address, bytes(content), headers), timeout=timeout) as answer:
                while piece := answer.read(1 << 16):
                    yield piece
        except urllib.error.HTTPError as error:
            raise RuntimeError(f"The service answered {error.code}: {error.read().decode('utf-8', 'replace')[:300]}") from None

    return send


def model_parser(url: str, request: Callable[[bytes, str, Part | None], str], kind: str, key: str | None = None, layout: bool = False, markdown: bool = False, post: Callable | None = None) -> Callable[[DataFrame], DataFrame]:
    """A parser at a language model that answers with server-sent events.

    ``request`` builds the body; ``kind`` (candidates or choices) says how answers are read. What the
    model writes is HTML, or layout divs, or markdown, and becomes HTML here; divs and markdown blocks are
    buffered until they are whole, wherever the events cut them. Blocks of markdown carry their page's number.
    """
    send = post or posted(90)

    def parse(content: bytes, media_type: str, part: Part | None) -> Iterator[str]:
        if kind == "choices" and not media_type.startswith("image/"):
            raise ValueError(f"This parser reads images, not {media_type}.")
        headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {key}"} if key else {})
        texts = streams.deltas(send(url, request(content, media_type, part).encode(), headers), kind)
        if layout:
            yield from streams.layout_html(texts)
        elif markdown:
            yield from streams.markdown_html(texts, f' data-page="{int(part)}"' if part is not None and part.unit == "page" else "")
        else:
            yield from texts

    return function_parser(parse)


def plain_text(sources: DataFrame, delimiter: str = r"\n\s*\n") -> DataFrame:
    """The plain-text parser: one chunk per paragraph, native all through. Bytes that are no UTF-8 become U+FFFD."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    blocks = sources.select("doc_id", F.posexplode(paragraphs(text, delimiter)).alias("chunk_seq", "delta"))
    return blocks.select("doc_id", F.lit(None).cast("int").alias("part_index"), F.col("chunk_seq").cast("long"), "delta", F.lit(None).cast("string").alias("error"), F.lit(False).alias("is_last"))


def pdf_pages(content: bytes) -> tuple[str, list[bytes]]:
    file = Pdf(content)
    return "page", [file.page(k + 1) for k in range(len(file.pages))]


def split(sources: DataFrame) -> DataFrame:
    """(doc_id, unit, count, part_index, content, media_type, error): a row per part, or one row with nulls or the error.

    Streams row by row; a document's parts are made one after the other.
    """
    splitters = dict(SPLITTERS)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                fn = splitters.get(r.media_type)
                try:
                    unit, parts = fn(bytes(r.content)) if fn else (None, [])
                    out += [(r.doc_id, unit, len(parts), k + 1, p, r.media_type, None) for k, p in enumerate(parts)] or [(r.doc_id, unit, None, None, None, r.media_type, None)]
                except Exception as error:  # noqa: BLE001  a file that a splitter can't read is that document's matter
                    out.append((r.doc_id, None, None, None, None, r.media_type, str(error) or type(error).__name__))
            yield pd.DataFrame(out, columns=["doc_id", "unit", "count", "part_index", "content", "media_type", "error"]).astype({"count": "Int32", "part_index": "Int32"})

    return sources.select("doc_id", "content", "media_type").mapInPandas(rows, "doc_id string, unit string, count int, part_index int, content binary, media_type string, error string")


register_parser("plain_text", plain_text)
register_splitter("application/pdf", pdf_pages)
