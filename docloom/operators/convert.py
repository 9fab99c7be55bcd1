"""Conversion: sources through a parser to events, documents and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import fold as fold_
from docloom.operators import parts as parts_
from docloom.operators.html import clean_blocks, join_chunks, number_blocks
from docloom.schemas import EVENT
from docloom.session import settle, ship
from docloom.sources import registry, sinks


@dataclass(frozen=True)
class Options:
    """What a conversion may be told; times in milliseconds."""

    mode: str = "auto"
    concurrency: int = 4
    idle_ms: int = 90_000
    retries: int = 2
    max_parts: int = 100
    growth: float = 1.25
    least_quiet_ms: int = 120
    most_quiet_ms: int = 1_200


NULL = "cast(null as string)"
#: Events of a document that stand after all others: the error of a whole document, then the end.
LATE, LAST = 1 << 61, 1 << 62


def event(kind: str, pos, doc_id="doc_id", **fields) -> list:
    """The columns of an event; fields that aren't given are null."""
    more = {k: F.expr(NULL) for k in ("id", "html", "phase", "message")} | {k: F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    return [F.col(doc_id).alias("doc_id"), F.lit(pos).cast("long").alias("pos"), F.lit(kind).alias("type"), *(c.alias(k) for k, c in more.items())]


def whole_events(chunks: DataFrame, handlers: tuple = (), first: int = 1) -> DataFrame:
    """A progress note and an append per clean block of each document, from its ordered chunks."""
    rows = number_blocks(join_chunks(chunks).select("doc_id", clean_blocks(F.col("text"), handlers).alias("blocks")))
    appends = rows.select(*event("append", F.col("pos") + first + 1, id=F.col("id"), html=F.col("html")))
    notes = chunks.select("doc_id").distinct().select(*event("progress", first, phase="Parsing"))
    return notes.unionByName(appends)


def ended(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds a done event after each document's last, for those without a terminal one."""
    failed = events.filter(fold_.is_terminal(F.col("type"))).select("doc_id").distinct()
    return events.unionByName(ids.select("doc_id").join(failed, "doc_id", "left_anti").select(*event("done", LAST)))


def convert(sources: DataFrame, parser=None, options: Options = Options(), handlers: tuple = ()) -> DataFrame:
    """Events (see schemas.EVENT) of each source; ``parser`` is a name or a function from sources to chunks.

    Split documents get their scaffold, the progress note, then a replace per part in part order.
    Whole documents are parsed at once. A failure of a part stays in its part; one of a whole
    document, of the part limit, or of the splitter in split mode is the document's error event.

    The parts and what the parser answers are written once to the shared folder and read from there, so
    every source or part is parsed once however often the events are used. The parts of one document
    lie on ``options.concurrency`` tasks at most, those of different documents on any.
    """
    spark = sources.sparkSession
    ship(spark)
    parse = parser if callable(parser) else registry.parser_named(parser)
    parse = parse.retrying(options.retries) if hasattr(parse, "retrying") else parse
    cut = settle(registry.split(sources), "parts")
    heads = cut.groupBy("doc_id").agg(F.first("unit").alias("unit"), F.first("count").alias("count"), F.first("media_type").alias("media_type"), F.first("error").alias("split_error"))
    planned = settle(parts_.plan(heads, options.mode, options.max_parts), "plan")
    failed = planned.filter("path = 'error'").select(*event("error", 1, message=F.col("message")))
    split = planned.filter("path = 'split'").select("doc_id", "unit", "count")
    whole = sources.join(planned.filter("path = 'whole'").select("doc_id"), "doc_id")
    lane = F.col("part_index") % max(1, options.concurrency)
    each = cut.join(split.select("doc_id"), "doc_id").select("doc_id", "content", "media_type", "part_index", "unit", F.col("count").alias("total")).repartition(F.col("doc_id"), lane)
    chunks, pieces = settle(parse(whole), "chunks"), settle(parse(each), "pieces")
    broken = chunks.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("message"))
    out = failed.unionByName(whole_events(chunks.filter("error is null"), handlers))
    out = out.unionByName(broken.select(*event("error", LATE, message=F.col("message"))))
    told = pieces.groupBy("doc_id", "part_index").agg(F.min("error").alias("error"))
    texts = join_chunks(pieces, "doc_id", "part_index").select("doc_id", "part_index", clean_blocks(F.col("text"), handlers).alias("blocks"))
    made = told.join(texts, ["doc_id", "part_index"]).join(split, "doc_id").select("doc_id", "unit", F.col("part_index").alias("index"), F.col("count").alias("total"), "blocks", "error")
    every = out.unionByName(parts_.scaffold(split)).unionByName(parts_.part_events(made))
    return ended(every, sources).selectExpr(*[x.split()[0] for x in EVENT.split(", ")])


def render(sources: DataFrame, parser=None, options: Options = Options(), handlers: tuple = ()) -> DataFrame:
    """One snapshot per source: its events checked (see ``fold.step``) and folded."""
    return fold_.fold(fold_.step(convert(sources, parser, options, handlers)))


def run_sessions(sources: DataFrame, path: str, parser=None, options: Options = Options(), handlers: tuple = ()) -> DataFrame:
    """Converts sources as sessions: a failure is the session's error event, and terminal snapshots are stored.

    A parser that fails as a whole (and not for one source) ends every session of the run with its error.
    Snapshots are stored under ``path`` by the day they finished, and returned.
    """
    try:
        snapshots = settle(render(sources, parser, options, handlers), "sessions")
    except Exception as error:  # noqa: BLE001  a session never raises: it ends
        reason = (str(error).strip().splitlines() or [type(error).__name__])[0]
        snapshots = settle(fold_.fold(sources.select(*event("error", 1, message=reason))), "sessions")
    sinks.save(snapshots, path)
    return snapshots
