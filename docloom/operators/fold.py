"""The document fold: event inputs to numbered events and snapshots, by windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import escape_html
from docloom.schemas import EOF_TYPES, VERSION

LOADING = "loading"
LOADING_HTML = '<p id="loading" class="loading">Reading the document…</p>'
ERROR = "error"


def is_terminal(kind: Column) -> Column:
    return kind.isin(*EOF_TYPES)


def number(events: DataFrame) -> DataFrame:
    """seq from 1 in order of pos, up to and with the first terminal event; later input is left out."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    ended = F.max(is_terminal(F.col("type")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("__ended", ended).filter("coalesce(__ended, 0) = 0").drop("__ended").withColumn("seq", F.row_number().over(order).cast("long"))


def live_events(events: DataFrame) -> DataFrame:
    """The event log: what the inputs become on the wire."""
    n, is_ = number(events), lambda k: F.col("type") == k
    return n.select("doc_id", F.lit(VERSION).alias("version"), "seq", "type", F.when(is_("append"), F.col("id")).alias("block_id"), F.when(is_("replace"), F.concat(F.lit("#"), F.col("id"))).alias("target"), F.when(is_("append") | is_("replace"), F.col("html")).alias("html"), F.when(is_("progress"), F.col("phase")).alias("phase"), F.when(is_("error"), F.col("message")).alias("message"))


def fold(events: DataFrame) -> DataFrame:
    """One snapshot per document: doc_id, seq, status, phase, blocks.

    A block stands where it was appended and shows its last replacement after that; until one is
    appended, the block ``loading`` stands, which can be replaced too. One shuffle, on
    doc_id: the window, the aggregation and the block list share it.
    """
    n = number(events)
    change = F.col("type").isin("append", "replace")
    last = Window.partitionBy("doc_id", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The last change of an id holds for all its blocks that stand before it.
    final = F.last(F.when(F.col("type") == "replace", F.struct("seq", "html")), ignorenulls=True).over(last)
    shown = n.withColumn("__final", F.when(change, final)).withColumn("__html", F.when(F.col("__final.seq") > F.col("seq"), F.col("__final.html")).otherwise(F.col("html")))
    when = lambda c, x: F.max(F.when(c, x))
    kept = F.array_sort(F.collect_list(F.when(F.col("type") == "append", F.struct("seq", "id", F.col("__html").alias("html")))))
    waiting = (F.col("type") == "replace") & (F.col("id") == LOADING)
    out = shown.groupBy("doc_id").agg(
        F.max("seq").alias("seq"),
        when(is_terminal(F.col("type")), F.col("type")).alias("end"),
        F.max_by(F.when(F.col("type") == "progress", F.col("phase")), F.when(F.col("type") == "progress", F.col("seq"))).alias("last"),
        when(F.col("type") == "error", F.col("message")).alias("message"),
        kept.alias("kept"),
        F.max_by(F.when(waiting, F.col("html")), F.when(waiting, F.col("seq"))).alias("waiting"),
    )
    blocks = F.transform("kept", lambda b: F.struct(b.id.alias("id"), b.html.alias("html")))
    error = F.array(F.struct(F.lit(ERROR).alias("id"), F.concat(F.lit('<p id="error" class="error" role="alert">'), escape_html(F.coalesce("message", F.lit(""))), F.lit("</p>")).alias("html")))
    loading = F.array(F.struct(F.lit(LOADING).alias("id"), F.coalesce("waiting", F.lit(LOADING_HTML)).alias("html")))
    return out.select(
        "doc_id", "seq", F.coalesce("end", F.lit("running")).alias("status"),
        F.when(F.col("end") == "done", F.lit("Done")).when(F.col("end") == "error", F.lit("Failed")).otherwise(F.coalesce("last", F.lit("Starting"))).alias("phase"),
        F.when(F.col("end") == "error", F.concat(F.filter(blocks, lambda b: b.id != ERROR), error)).when(F.col("end").isNull() & (F.size("kept") == 0), loading).otherwise(blocks).alias("blocks"),
    )


def judged(events: DataFrame) -> DataFrame:
    """``events`` with ``violation``: what the input breaks in the state before it, or null.

    An append or replace must be one complete element with its id on the root; an appended id must
    be new, a replaced one must be there. A new document shows the block ``loading`` until a block is
    appended; a failed one shows the block ``error``. After the terminal event the state stays, and late
    inputs are judged against it.
    """
    from docloom.operators.html import is_single_block

    change = F.col("type").isin("append", "replace")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("doc_id", "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("__single", F.when(change, is_single_block(F.col("html"), F.col("id"))))
    rows = rows.withColumn("__end", F.first(F.when(is_terminal(F.col("type")), F.col("type")), ignorenulls=True).over(order))
    effective = (F.col("type") == "append") & F.col("__single") & F.col("__end").isNull()
    rows = rows.withColumn("__latest", F.last(F.when(effective, F.col("id")), ignorenulls=True).over(order))
    added = F.coalesce(F.max(F.when(effective, 1)).over(own), F.lit(0)) == 1
    loading = F.col("__end").isNull() & (F.coalesce("__latest", F.lit(LOADING)) == LOADING)
    failed = F.coalesce(F.col("__end") == "error", F.lit(False))
    known = F.when(F.col("id") == LOADING, loading).otherwise(added | ((F.col("id") == ERROR) & failed))
    name = F.concat(F.lit("#"), F.col("id"))
    text = (
        F.when(~change, F.lit(None).cast("string"))
        .when(~F.col("__single"), F.concat(F.col("type"), F.lit(" "), name, F.lit(" must be one complete element whose root id is "), F.col("id")))
        .when((F.col("type") == "append") & F.col("__known"), F.concat(F.lit("duplicate block id "), name))
        .when((F.col("type") == "replace") & ~F.col("__known"), F.concat(F.lit("replace target "), name, F.lit(" does not exist")))
    )
    return rows.withColumn("__known", known).withColumn("violation", text).drop("__single", "__end", "__latest", "__known")


def violations(events: DataFrame) -> DataFrame:
    """(doc_id, pos, violation) of inputs that break the contract (see ``judged``)."""
    return judged(events).filter("violation is not null").select("doc_id", "pos", "violation")


def step(events: DataFrame) -> DataFrame:
    """The inputs up to the first that breaks the contract, which becomes the document's error event."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    bad = F.col("violation").isNotNull()
    seen = F.coalesce(F.max(F.when(bad, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = judged(events).withColumn("__seen", seen).filter("__seen = 0")
    kept = [F.when(~bad, F.col(c)).alias(c) for c in ("id", "html", "phase")]
    return rows.select("doc_id", "pos", F.when(bad, F.lit("error")).otherwise(F.col("type")).alias("type"), *kept, F.coalesce("violation", "message").alias("message"))


def replay(log: DataFrame, after: int | Column = 0) -> DataFrame:
    """Events that a reader who has seen ``after`` still needs."""
    return log.filter(F.col("seq") > after)


def resume_token(last_event_id: Column, after: Column) -> Column:
    """A reader's place: a whole number from either field, else 0."""
    raw = F.coalesce(last_event_id, after)
    number_ = F.when(raw.rlike(r"^\s*[0-9]{1,16}\s*\z"), F.trim(raw).try_cast("long"))
    return F.when(number_ <= (1 << 53) - 1, number_).otherwise(F.lit(0).cast("long"))


def restore(snapshots: DataFrame) -> DataFrame:
    """The log that a stored snapshot replays as: one append per block, then its terminal event."""
    null = F.lit(None).cast("string")
    n = F.size("blocks").cast("long")
    blocks = snapshots.select("doc_id", F.posexplode("blocks").alias("at", "b")).select("doc_id", F.lit(VERSION).alias("version"), (F.col("at") + 1).cast("long").alias("seq"), F.lit("append").alias("type"), F.col("b.id").alias("block_id"), F.col("b.html").alias("html"), null.alias("message"))
    ends = snapshots.select("doc_id", F.lit(VERSION).alias("version"), (n + 1).alias("seq"), F.when(F.col("status") == "done", "done").otherwise("error").alias("type"), null.alias("block_id"), null.alias("html"), F.when(F.col("status") != "done", F.lit("The conversion failed.")).alias("message"))
    return blocks.unionByName(ends)


def gaps(log: DataFrame) -> DataFrame:
    """Places where a reader must reload: an event that doesn't follow its predecessor."""
    before = F.lag("seq").over(Window.partitionBy("doc_id").orderBy("seq"))
    return log.select("doc_id", "seq", before.alias("before")).filter("seq - coalesce(before, 0) <> 1")


def evict(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The sessions that stay when a new one comes: at ``most`` or more, the oldest finished one goes; running ones never do.

    The oldest is found by an aggregation, so no task sees all sessions.
    """
    seen = sessions.agg(F.count("*").alias("__n"), F.min(F.when(F.col("status") != "running", F.struct("created_at", "doc_id"))).alias("__oldest"))
    return sessions.join(F.broadcast(seen)).filter((F.col("__n") < most) | F.col("__oldest").isNull() | (F.col("doc_id") != F.col("__oldest.doc_id"))).drop("__n", "__oldest")
