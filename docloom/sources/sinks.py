"""Sinks: standalone documents, event frames, snapshots, file names, stored sessions."""

from __future__ import annotations

import base64
import hashlib
import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import escape_html

#: Reading styles: a serif column of 70 characters, striped tables without lines, notes by their role.
CSS = "".join(
    (
        "html{background:#fcfcf9}",
        "main{display:block;max-inline-size:70ch;margin-inline:auto;padding-block:3em;font-family:Georgia,'Times New Roman',serif;line-height:1.7;color:#1c1c1a}",
        "h1,h2,h3,h4{line-height:1.2;text-wrap:balance}",
        "thead{background:#ecebe4}tbody tr:nth-child(even){background:#f5f4ee}th,td{padding-inline:.9em;vertical-align:baseline}",
        "pre{white-space:pre-wrap;background:#f0efe9;padding:1em}",
        "img{max-inline-size:100%;block-size:auto}figcaption{font-style:italic;text-align:center}",
        "section:not(:first-child)::before{content:'';display:block;inline-size:30%;margin:3em auto;block-size:1px;background:#c9c7bb}",
        "[role=alert]{border-inline-start:.3em solid #a8321f;padding-inline-start:1em}",
        "div{overflow-x:auto}",
    )
)
# The shape of a document, so that readers of stored pages find title, styles and blocks.
HEAD = '<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'
STYLE = f"</title>\n<style>{CSS}</style>\n</head>\n<body>\n<main class=\"doc\">\n"
FOOT = "</main>\n</body>\n</html>\n"
#: Milliseconds after which a reader reconnects.
RETRY_MS = 2000
#: Days that finished documents are kept.
RETENTION_DAYS = 7


def document_html(title: Column, blocks: Column) -> Column:
    """A self-contained page of the blocks (structs with ``html``), without scripts."""
    body = F.array_join(F.transform(blocks, lambda b: F.concat(b["html"], F.lit("\n"))), "")
    return F.concat(F.lit(HEAD), escape_html(title), F.lit(STYLE), body, F.lit(FOOT))


def event_json(columns=("version", "seq", "type", "block_id", "target", "html", "phase", "message")) -> Column:
    """The event as JSON in this key order, without what is null."""
    return F.to_json(F.struct(*columns))


def sse_frame() -> Column:
    """A server-sent event of a row of the event log."""
    return F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), F.col("type"), F.lit("\ndata: "), event_json(), F.lit("\n\n"))


def sse_stream(log: DataFrame) -> DataFrame:
    """(doc_id, seq, frame): the reconnect hint as row 0 of each document, then its frames."""
    hint = log.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit(f"retry: {RETRY_MS}\n\n").alias("frame"))
    return hint.unionByName(log.select("doc_id", "seq", sse_frame().alias("frame")))


def snapshot_json(info: list[str]) -> Column:
    """A snapshot with its session's fields first."""
    return F.to_json(F.struct(*info, "seq", "status", "phase", "blocks"))


def status_text(status: Column, phase: Column) -> Column:
    return F.when(status == "done", "Done").when(status == "error", "Failed").otherwise(phase)


def viewer_html(title: Column, status: Column, phase: Column, blocks: Column) -> Column:
    """The page of a document that may still grow: its state, then its blocks."""
    body = F.array_join(F.transform(blocks, lambda b: F.concat(b["html"], F.lit("\n"))), "")
    return F.concat(F.lit(HEAD), escape_html(title), F.lit(STYLE), F.lit('<p class="status" data-status="'), status, F.lit('">'), escape_html(status_text(status, phase)), F.lit("</p>\n"), body, F.lit(FOOT))


def save(snapshots: DataFrame, path: str) -> None:
    """Stores terminal snapshots by the day they finished; ``expire`` drops days as folders."""
    done = snapshots.filter(F.col("status") != "running")
    if "finished_on" not in done.columns:
        done = done.withColumn("finished_on", F.current_date())
    done.write.mode("append").partitionBy("finished_on").parquet(path)


def load(spark, path: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Stored snapshots within retention; older days are pruned before the scan."""
    return spark.read.parquet(path).filter(F.col("finished_on") >= F.date_sub(F.current_date(), days))


def expire(spark, path: str, days: int = RETENTION_DAYS) -> int:
    """Deletes the folders of days beyond retention; how many there were."""
    sc = spark.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(sc._jsc.hadoopConfiguration())
    oldest = spark.range(1).select(F.date_sub(F.current_date(), days).cast("string")).first()[0]
    names = [f.getPath() for f in files.listStatus(top) if f.getPath().getName().startswith("finished_on=")]
    old = [x for x in names if x.getName().partition("=")[2] < oldest]
    return sum(files.delete(x, True) for x in old)


def landing_html(title: str, action: str, types: tuple[str, ...]) -> str:
    """A page with a form for uploads, without scripts."""
    kinds = html.escape(",".join(types))
    form = f'<form method="post" action="{html.escape(action)}" enctype="multipart/form-data"><label>File <input type="file" name="file" accept="{kinds}" required></label><label>API key <input type="password" name="api_key" autocomplete="off"></label><button>Convert</button></form>'
    return f"{HEAD}{html.escape(title)}{STYLE}<h1>{html.escape(title)}</h1>\n{form}\n{FOOT}"


def message_html(title: str, message: str) -> str:
    """A page that says what happened."""
    return f'{HEAD}{html.escape(title)}{STYLE}<h1>{html.escape(title)}</h1>\n<p role="alert">{html.escape(message)}</p>\n{FOOT}'


def content_policy() -> str:
    """What the pages may load: their own styles by hash, images, and forms to where they come from."""
    style = STYLE[STYLE.index("<style>") + 7 : STYLE.index("</style>")]
    digest = base64.b64encode(hashlib.sha256(style.encode()).digest()).decode()
    return f"default-src 'none'; style-src 'sha256-{digest}'; img-src https: http:; form-action 'self'; base-uri 'none'; frame-ancestors 'none'"


def write_pages(documents: DataFrame, path: str, title: str = "title") -> None:
    """One HTML file's text per row, as Spark's text format."""
    documents.select(document_html(F.col(title), F.col("blocks")).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
