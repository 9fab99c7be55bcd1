"""Live conversion: chunks in, numbered events out, with state per document and its parts.

A chunk may end anywhere, in a tag too; what comes out doesn't depend on where. An ``is_last`` chunk
flushes a document's or part's tail and ends it; one that stays silent for too long ends with an error:
a whole document as such, a part in its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions import lexer, sanitizer
from docloom.operators.parts import UNIT, failure, section_html
from docloom.schemas import VERSION
from docloom.session import ship

OUT = "doc_id string, version int, seq long, type string, block_id string, target string, html string, phase string, message string"
COLUMNS = [x.split()[0] for x in OUT.split(", ")]
#: Columns of the chunks that may be missing, and what stands for them.
OPTIONAL = {"part_index": "int", "unit": "string", "total": "int", "attempt": "int", "error": "string"}
FENCE_START = ("`", "``", "```", "```h", "```ht", "```htm", "```html")
TABLE = re.compile(r"<table(?![A-Za-z0-9_])", re.I)
OWN_ID = re.compile(r"""\s+id\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Folders of the log by a hash of the document, so that a reader of one reads one.
SHARDS = 64


class Cutter:
    """The whole-document cutter as a state machine: feed chunks, get finished blocks, flush the tail."""

    def __init__(self, head: str = "", opened: bool = False, scan: list | None = None, handlers: tuple = ()):
        self.head, self.opened, self.scanner, self.handlers = head, opened, lexer.Scanner(*(scan or [])), handlers

    def state(self) -> list:
        return [self.head, self.opened, self.scanner.state()]

    def feed(self, delta: str) -> list[str]:
        if not self.opened:
            self.head += delta
            head = self.head.lstrip(lexer.WS)
            if not head or head.lower() in FENCE_START:
                return []  # it can't be told yet whether a fence opens the document
            delta, self.head, self.opened = lexer.strip_fence(self.head, end=False), "", True
        return self.clean(self.scanner.feed(delta))

    def flush(self) -> list[str]:
        rest = lexer.strip_fence(self.head + self.scanner.rest(), start=not self.opened)
        cut, tail = lexer.cut_blocks(rest)
        self.head, self.opened, self.scanner = "", True, lexer.Scanner()
        return self.clean([*cut, tail] if tail.strip(lexer.WS) else cut)

    def clean(self, parts: list[str]) -> list[str]:
        return [b for part in parts for b in lexer.normalize(sanitizer.sanitize(part, self.handlers))]


def boxed(html: str) -> str:
    """A table in its scroll box; anything else as it is."""
    return f'<div class="table-scroll">{html}</div>' if TABLE.match(html) else html


def numbered(html: str, ident: str) -> str:
    """A block with its id first on the root; a table in its scroll box."""
    html = boxed(html)
    end = lexer.tag_end(html, 0)
    head = lexer.NAME.match(html, 1)
    tag = OWN_ID.sub("", html[:end], count=1)
    return f'{tag[: head.end()]} id="{ident}"{tag[head.end() :]}{html[end:]}'


@dataclass
class Waiting:
    """Chunks in order: those that come early wait, seen ones are ignored."""

    expected: int = 0
    early: dict[int, list] = field(default_factory=dict)

    def put(self, seq: int, *chunk) -> None:
        if seq >= self.expected:
            self.early[seq] = list(chunk)

    def ready(self) -> Iterator[list]:
        while self.expected in self.early:
            self.expected += 1
            yield self.early.pop(self.expected - 1)


@dataclass
class PartState:
    """A part that is being read: its finished blocks and what was last shown of it."""

    attempt: int = 0
    ended: bool = False
    heard: float = 0.0
    children: list[str] = field(default_factory=list)
    size: int = 0
    kids: int = 0
    painted: int = 0
    painted_at: float = 0.0
    cutter: list = field(default_factory=lambda: ["", False, None])
    expected: int = 0
    early: dict = field(default_factory=dict)


class Document:
    """One document's conversion: events come out as chunks go in. ``limits`` are those of ``lexer.should_paint``."""

    def __init__(self, saved: str | None = None, handlers: tuple = (), **limits):
        told = json.loads(saved) if saved else {}
        self.seq, self.blocks, self.done = told.get("seq", 0), told.get("blocks", 0), told.get("done", False)
        self.unit, self.total = told.get("unit"), told.get("total")
        self.parts = {int(k): PartState(**v) for k, v in told.get("parts", {}).items()}
        self.started, self.handlers, self.limits, self.events = bool(saved), handlers, limits, []

    def saved(self) -> str:
        parts = {k: vars(p) for k, p in self.parts.items()}
        return json.dumps({"seq": self.seq, "blocks": self.blocks, "done": self.done, "unit": self.unit, "total": self.total, "parts": parts})

    def emit(self, kind: str, **more) -> None:
        self.seq += 1
        self.done |= kind in ("done", "error")
        self.events.append({"version": VERSION, "seq": self.seq, "type": kind, **more})

    def start(self, unit: str | None, total: int | None) -> None:
        """What a document opens with: a note, or for a split one its empty sections and then the note."""
        self.started = True
        if total is None:
            self.emit("progress", phase="Parsing")
            self.parts[0] = PartState()
            return
        self.unit, self.total = unit if re.fullmatch(UNIT, unit or "") else "part", total
        for k in range(1, total + 1):
            self.parts[k] = PartState()
            self.emit("append", block_id=f"{self.unit}-{k}", html=section_html(self.unit, k, total, []))
        self.emit("progress", phase=f"Converting {total} {self.unit}{'' if total == 1 else 's'}")

    def show(self, k: int, now: float, tail: str = "", error: str | None = None) -> None:
        """Paints a part: its section anew."""
        part = self.parts[k]
        part.painted, part.painted_at = max(part.size, 1), now
        html = section_html(self.unit, k, self.total, [] if error else part.children, error and failure(self.unit, k, error), tail)
        self.emit("replace", target=f"#{self.unit}-{k}", html=html)

    def end_part(self, k: int) -> None:
        self.parts[k].ended = True
        self.parts[k].early, self.parts[k].cutter, self.parts[k].children = {}, ["", True, None], []
        if all(p.ended for p in self.parts.values()):
            self.emit("done")
            self.parts = {}

    def chunk(self, k: int, seq: int, delta: str, last: bool, attempt: int, error: str | None, now: float) -> None:
        """One chunk of a part (0: the whole document). A later attempt starts its part anew; parts end once."""
        part = self.parts.get(k)
        if self.done or part is None or part.ended or attempt < part.attempt:
            return
        if attempt > part.attempt and k:
            part = self.parts[k] = PartState(attempt=attempt)
        part.heard = now
        queue = Waiting(part.expected, {int(x): v for x, v in part.early.items()})
        queue.put(seq, delta, last, error)
        cutter = Cutter(*part.cutter, handlers=self.handlers)
        for delta, last, error in queue.ready():
            if error is not None:
                self.fail(k, error, now)
                return
            made = cutter.feed(delta) + (cutter.flush() if last else [])
            if k:
                self.grow(k, cutter, made, last, now)
            for html in made if not k else ():
                self.blocks += 1
                self.emit("append", block_id=f"block-{self.blocks}", html=numbered(html, f"block-{self.blocks}"))
            if last:
                self.end_part(k)
                return
        part.expected, part.early, part.cutter = queue.expected, queue.early, cutter.state()

    def grow(self, k: int, cutter: Cutter, made: list[str], last: bool, now: float) -> None:
        """New blocks of a part, or new finished children of the list or table that is open; shown when it is time to."""
        part, kids = self.parts[k], cutter.scanner.finished()
        grew = bool(made) or kids > part.kids
        part.kids = kids
        for html in map(boxed, made):
            part.children.append(html)
            part.size += len(html)
        size = part.size + (cutter.scanner.size if kids else 0)
        if last or grew and lexer.should_paint(size, part.painted, now - part.painted_at, **self.limits):
            self.show(k, now, "" if last else self.open_tail(cutter))
            part.painted = max(size, 1)

    def open_tail(self, cutter: Cutter) -> str:
        """The open list or table closed after its finished children, if it is one sound element then."""
        found = lexer.provisional(cutter.scanner.rest()) if cutter.scanner.finished() else None
        blocks, rest = lexer.cut_blocks(sanitizer.sanitize(found[0], self.handlers)) if found else ([], "")
        return boxed(blocks[0]) if len(blocks) == 1 and not rest.strip(lexer.WS) and lexer.is_complete(blocks[0]) else ""

    def fail(self, k: int, reason: str, now: float) -> None:
        if not k:
            self.emit("error", message=reason)
            return
        self.show(k, now, error=reason)
        self.end_part(k)

    def silent(self, now: float, idle_ms: float) -> None:
        """Ends what has not been heard of for too long."""
        for k, part in list(self.parts.items()):
            if not self.done and not part.ended and now - part.heard >= idle_ms:
                who = f"{self.unit} {k}" if k else "The parser"
                self.fail(k, f"{who} produced no output for {round(idle_ms / 1000)}s.", now)

    def next_idle(self, now: float, idle_ms: float) -> int:
        """Milliseconds until a part may have been silent for too long."""
        left = [p.heard + idle_ms - now for p in self.parts.values() if not p.ended]
        return max(1, int(min(left, default=idle_ms)))


def advance(saved: str | None, rows: list[tuple[int, str, bool]], handlers: tuple = ()) -> tuple[str, list[dict]]:
    """State and events of a whole document after chunks (chunk_seq, delta, is_last)."""
    doc = Document(saved, handlers)
    if not doc.started:
        doc.start(None, None)
    for k, delta, last in sorted(rows):
        doc.chunk(0, k, delta, last, 0, None, 0)
    return doc.saved(), doc.events


def live_events(chunks: DataFrame, idle_ms: int | None = 90_000, handlers: tuple = (), **limits) -> DataFrame:
    """A stream of events from a stream of chunks: doc_id, chunk_seq, delta, is_last, and for split documents
    part_index, unit, total; with ``attempt`` a part that is tried anew starts anew, with ``error`` it ends.

    Idle timers need a trigger that goes on; without them (``idle_ms`` None) a run over what there is ends.
    """
    ship(chunks.sparkSession)
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in chunks.columns}

    def whole(x) -> int | None:
        return None if x is None or pd.isna(x) else int(x)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        doc = Document(state.get[0] if state.exists else None, handlers, **limits)
        if state.hasTimedOut:
            doc.silent(now, idle_ms)
        else:
            rows = [r for b in batches for r in b.itertuples(index=False)]
            order = lambda r: (whole(r.attempt) or 0, whole(r.part_index) or 0, int(r.chunk_seq))
            for r in sorted(rows, key=order):
                if not doc.started:
                    doc.start(r.unit, whole(r.total) if whole(r.part_index) is not None else None)
                    for p in doc.parts.values():
                        p.heard = now
                doc.chunk(whole(r.part_index) or 0, int(r.chunk_seq), r.delta or "", bool(r.is_last), whole(r.attempt) or 0, r.error if isinstance(r.error, str) else None, now)
        state.update((doc.saved(),))
        if idle_ms and not doc.done:
            state.setTimeoutDuration(doc.next_idle(now, idle_ms))
        if doc.events:
            yield pd.DataFrame([{"doc_id": key[0], **e} for e in doc.events], columns=COLUMNS)

    timer = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.withColumns(missing).groupBy("doc_id").applyInPandasWithState(run, OUT, "saved string", "append", timer)


def shard(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SHARDS)).cast("int")


def start(chunks: DataFrame, log: str, checkpoint: str, **options):
    """Runs a conversion over all chunks there are into a Parquet event log; readers follow the log on their own."""
    rows = live_events(chunks, **{"idle_ms": None} | options).withColumn("shard", shard(F.col("doc_id")))
    return rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).partitionBy("shard").outputMode("append").trigger(availableNow=True).start()


def follow(spark, log: str, after: int = 0, doc_id: str | None = None) -> DataFrame:
    """Events of the log beyond ``after``, each once, up to and with the terminal one; of one document, from its folder alone."""
    rows = spark.read.schema(f"{OUT}, shard int").parquet(log).filter(F.col("seq") > after)
    if doc_id is not None:
        rows = rows.filter((F.col("shard") == shard(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
    return rows.drop("shard").dropDuplicates(["doc_id", "seq"])


def paints(sizes: list[tuple[float, int]], **limits) -> list[int]:
    """Which of a part's (time in ms, size) states are shown; the last always is."""
    shown, painted, at = [], 0, 0.0
    for k, (now, size) in enumerate(sizes):
        if k == len(sizes) - 1 or lexer.should_paint(size, painted, now - at, **limits):
            shown.append(k)
            painted, at = size, now
    return shown
